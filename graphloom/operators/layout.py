"""Closed-form layouts: (id, x, y) from ranks, counts and parent positions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import graph, traverse
from graphloom.operators.ranking import dense_codes, ranked
from graphloom.operators.skew import own_shuffle
from graphloom.session import cut_and_observe, cut_lineage

# Spread of the final coordinates by layout name; 100 for all others.
SPREAD = {"spectral": 500.0, "kamada_kawai": 500.0}
TAU = 2 * math.pi


def scale(positions: DataFrame, layout: str) -> DataFrame:
    factor = F.lit(SPREAD.get(layout.lower(), 100.0))
    return positions.withColumns({c: F.col(c).cast("double") * factor for c in ("x", "y")})


def _numbered(nodes: DataFrame, order=("id",)) -> DataFrame:
    """Nodes with 0-based position i and total n."""
    return ranked(nodes, [], list(order), rn="__rn", n="n").withColumn("i", F.col("__rn") - 1).drop("__rn")


def circular(nodes: DataFrame, edges: DataFrame | None = None, phase: float = 0.0) -> DataFrame:
    angle = F.lit(TAU) * F.col("i") / F.col("n") + F.lit(phase)
    radius = F.when(F.col("n") == 1, 0.0).otherwise(1.0)
    return _numbered(nodes.select("id")).select("id", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))


def shell(nodes: DataFrame, edges: DataFrame | None = None, groups: str | None = None) -> DataFrame:
    """One ring, turned by half a circle; with `groups`, one ring per value of that column."""
    if groups is None:
        return circular(nodes, phase=math.pi)
    values = dense_codes(nodes.withColumn("__g", F.coalesce(F.col(groups).cast("string"), F.lit("Unknown"))), "__g", "ring")
    rows = ranked(values.select("id", "ring"), ["ring"], ["id"], rn="rn", n="n")
    rings = rows.agg(F.struct((F.max("ring") + 1).alias("k"), F.min(F.when(F.col("ring") == 0, F.col("n"))).alias("inner"))).scalar()
    rows = rows.withColumn("__s", rings)
    step = F.lit(1.0) / F.col("__s.k")
    radius = step * (F.col("ring") + F.when(F.col("__s.inner") == 1, 0).otherwise(1))
    angle = F.lit(TAU) * (F.col("rn") - 1) / F.col("n") + F.lit(math.pi) * step * (F.col("ring") + 1)
    return rows.select("id", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))


def spiral(nodes: DataFrame, edges: DataFrame | None = None, resolution: float = 0.35) -> DataFrame:
    """Position i at distance i and angle resolution*i, then centred and scaled into [-1, 1]."""
    angle = F.lit(resolution) * F.col("i")
    raw = _numbered(nodes.select("id")).select("id", (F.col("i") * F.cos(angle)).alias("x"), (F.col("i") * F.sin(angle)).alias("y"))
    raw = raw.withColumn("__m", raw.agg(F.struct(
        F.avg("x").alias("ax"), F.avg("y").alias("ay"), F.min("x").alias("lx"), F.max("x").alias("hx"),
        F.min("y").alias("ly"), F.max("y").alias("hy"))).scalar())
    m = {k: F.col(f"__m.{k}") for k in ("ax", "ay", "lx", "hx", "ly", "hy")}
    limit = F.greatest(m["ax"] - m["lx"], m["hx"] - m["ax"], m["ay"] - m["ly"], m["hy"] - m["ay"])
    limit = F.when(limit > 0, limit).otherwise(1.0)
    return raw.select("id", ((F.col("x") - m["ax"]) / limit).alias("x"), ((F.col("y") - m["ay"]) / limit).alias("y"))


def random(nodes: DataFrame, edges: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Uniform in [0, 1) from the SHA-256 of id, seed and axis: stable whatever the partitioning."""
    def unit(axis: str) -> Column:
        digits = F.left(F.sha2(F.concat_ws("|", "id", F.lit(str(seed)), F.lit(axis)), 256), F.lit(13))
        return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))

    return nodes.select("id", unit("x").alias("x"), unit("y").alias("y"))


def sorted_square(nodes: DataFrame, edges: DataFrame | None = None, kind: str = "kind") -> DataFrame:
    """Square grid filled column by column in order of kind."""
    rows = _numbered(nodes.select("id", F.coalesce(F.col(kind), F.lit("")).alias("k")), ("k", "id"))
    side = F.ceil(F.sqrt("n"))
    return rows.select("id", F.floor(F.col("i") / side).cast("double").alias("x"), (F.col("i") % side).cast("double").alias("y"))


def arc_angle(rn: Column, n: Column) -> Column:
    """Angle of position rn of n on a 300 degree arc that starts at 12 o'clock."""
    return F.lit(-math.pi / 2) + F.coalesce((rn - 1) / F.nullif(n - 1, F.lit(0)), F.lit(0.0)) * F.lit(5 * math.pi / 3)


def orbit_angle(rn: Column, n: Column, turn: float = math.pi / 6) -> Column:
    return F.lit(TAU) * (rn - 1) / F.greatest(n, F.lit(1)) + F.lit(turn)


def symbol_orbit(n: Column) -> Column:
    return F.greatest(F.lit(0.45), F.sqrt(F.greatest(n, F.lit(1))) * 0.28)


def sub_orbit(n: Column) -> Column:
    return F.greatest(F.lit(0.22), F.sqrt(F.greatest(n, F.lit(1))) * 0.14)


def file_orbit(n: Column, widest_child: Column) -> Column:
    return F.greatest(F.lit(1.8), F.sqrt(F.greatest(n, F.lit(1))) * 0.9) + widest_child


def compound_parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, parent) of files, symbols and deeper nodes, from containment, else from the file attribute."""
    depth = nodes.select("id", F.coalesce("depth", F.lit(1)).alias("depth"))
    inside = edges.where(F.col("kind").isin("contains", "field_of"))
    ends = inside.join(depth.select(F.col("id").alias("src"), F.col("depth").alias("sd")), "src").join(
        depth.select(F.col("id").alias("dst"), F.col("depth").alias("dd")), "dst")
    direct = ends.where("(sd = 0 and dd = 1) or (sd = 1 and dd = 2)").groupBy(F.col("dst").alias("id")).agg(F.max("src").alias("parent"))
    deep = traverse.nearest_symbol_ancestor(nodes, inside)
    known = direct.unionByName(deep)
    rest = graph.attach_by_label(nodes.where("depth >= 2").select("id", "depth", "file"), nodes.where("depth = 1"), known)
    return known.unionByName(rest)


def compound(nodes: DataFrame, edges: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Four tiers: directories on an ellipse, files on orbits, symbols and sub-symbols on source-ordered arcs."""
    tiers = nodes.select("id", F.least(F.coalesce("depth", F.lit(1)), F.lit(3)).alias("tier"), F.coalesce("line", F.lit(0)).alias("line"))
    parents = compound_parents(nodes, edges) if parents is None else parents
    above = own_shuffle(tiers.select(F.col("id").alias("parent"), (F.col("tier") + 1).alias("__tier")))
    met = tiers.join(parents, "id", "left").join(above, "parent", "left").withColumn(
        "parent", F.when(F.col("tier") == F.col("__tier"), F.col("parent")))
    # Children of one parent, the directories, and what a tier has without parent are numbered at once.
    has_parent = F.col("parent").isNotNull()
    numbered = ranked(
        met.select("id", "tier", "parent", F.coalesce("parent", F.lit("")).alias("group"), F.when(has_parent & (F.col("tier") >= 2), F.col("line")).otherwise(0).alias("at")),
        ["tier", "group"], ["at", "id"], rn="rn", n="n")
    placed, seen = cut_and_observe(numbered.select("id", "tier", "parent", "rn", "n"), dirs=F.count_if(F.col("tier") == 0))
    n_dirs = seen["dirs"]
    if n_dirs == 0:
        return circular(nodes)
    dirs = placed.where("tier = 0")
    files, symbols, subs = (placed.where((F.col("tier") == t) & has_parent) for t in (1, 2, 3))

    per_file = symbols.groupBy(F.col("parent").alias("id")).agg(F.max("n").alias("syms"))
    widest = files.select("id", "parent", "n").join(per_file, "id", "left").groupBy("parent").agg(
        F.max(symbol_orbit(F.coalesce("syms", F.lit(0)))).alias("widest"), F.max("n").alias("files"))
    reach = widest.agg(F.coalesce(F.max(file_orbit(F.col("files"), F.col("widest"))), F.lit(1.8)).alias("max_file"),
                       F.greatest(F.coalesce(F.max("widest"), F.lit(0.45)), F.lit(0.45)).alias("max_sym")).first()

    spread = math.sqrt(n_dirs) * (reach["max_file"] + reach["max_sym"]) * 1.6 if n_dirs > 1 else 0.0
    around_all = F.lit(TAU) * (F.col("rn") - 1) / F.col("n")
    dir_pos = dirs.select("id", (F.cos(around_all) * spread * 1.6).alias("x"), (F.sin(around_all) * spread * 0.7).alias("y"))

    def around(kids: DataFrame, centres: DataFrame, radius: Column, angle: Column) -> DataFrame:
        at = centres.select(F.col("id").alias("parent"), F.col("x").alias("cx"), F.col("y").alias("cy"))
        return kids.join(at, "parent").select(
            "id", (F.col("cx") + radius * F.cos(angle)).alias("x"), (F.col("cy") + radius * F.sin(angle)).alias("y"))

    def ring(tier: int, radius: Column) -> DataFrame:
        """What a tier has without parent, on a circle."""
        return placed.where((F.col("tier") == tier) & ~has_parent).select(
            "id", (radius * F.cos(around_all)).alias("x"), (radius * F.sin(around_all)).alias("y"))

    file_pos = around(files.join(widest.select("parent", "widest"), "parent"), dir_pos,
                      file_orbit(F.col("n"), F.col("widest")), orbit_angle(F.col("rn"), F.col("n")))
    file_pos = cut_lineage(file_pos.unionByName(ring(1, F.lit(reach["max_file"] * 0.5))))
    arc = arc_angle(F.col("rn"), F.col("n"))
    sym_pos = around(symbols, file_pos, symbol_orbit(F.col("n")), arc)
    sym_pos = cut_lineage(sym_pos.unionByName(ring(2, F.lit(reach["max_sym"] * 0.5))))
    sub_pos = around(subs, sym_pos, sub_orbit(F.col("n")), arc).unionByName(
        ring(3, sub_orbit(F.col("n")) * 0.5))
    return dir_pos.unionByName(file_pos).unionByName(sym_pos).unionByName(sub_pos)


def radial_tree(nodes: DataFrame, edges: DataFrame, root: str, radius: float = 1.0) -> DataFrame:
    """Each node's children split its angle range evenly; the ring is the tree depth."""
    out = None
    for level, frontier in traverse.tree_levels(edges, root):
        r = F.lit(radius * level)
        at = frontier.select("id", (r * F.cos("angle")).alias("x"), (r * F.sin("angle")).alias("y"))
        out = at if out is None else out.unionByName(at)
    return out


def cluster_grid(symbols: DataFrame, spacing: float = 220.0) -> DataFrame:
    """(file, cx, cy): files in order of first arrival (`seq`) on a square grid."""
    first = symbols.groupBy("file").agg(F.min("seq").alias("first_seq"))
    rows = _numbered(first, ("first_seq", "file"))
    cols = F.greatest(F.ceil(F.sqrt("n")), F.lit(1))
    return rows.select("file", ((F.col("i") % cols) * spacing).alias("cx"), (F.floor(F.col("i") / cols) * spacing).alias("cy"))


def ring_slots(symbols: DataFrame, centres: DataFrame) -> DataFrame:
    """Symbols of a file round its centre, on three alternating radii, in order of arrival."""
    rows = ranked(symbols, ["file"], ["seq", "id"], rn="rn", n="n").join(centres, "file")
    i = F.col("rn") - 1
    angle, radius = F.lit(TAU) * i / F.col("n"), 30 + 8 * (i % 3)
    return rows.select("id", (F.col("cx") + radius * F.cos(angle)).alias("x"), (F.col("cy") + radius * F.sin(angle)).alias("y"))


def place_near_file(symbols: DataFrame, file_positions: DataFrame) -> DataFrame:
    """Symbols (id, depth, file_id) round their file's position, or round the origin without one."""
    rows = ranked(symbols, ["file_id"], ["id"], rn="rn", n="n").join(
        file_positions.select(F.col("id").alias("file_id"), F.col("x").alias("cx"), F.col("y").alias("cy")), "file_id", "left")
    angle = F.lit(TAU) * (F.col("rn") - 1) / F.col("n")
    radius = 25 + 12 * F.greatest(F.col("depth") - 2, F.lit(0))
    return rows.select("id", (F.coalesce("cx", F.lit(0.0)) + radius * F.cos(angle)).alias("x"),
                       (F.coalesce("cy", F.lit(0.0)) + radius * F.sin(angle)).alias("y"))


def depth_ring(nodes: DataFrame, width: float = 800.0, height: float = 600.0) -> DataFrame:
    """One ring per depth; the k-th node of a depth sees max(8, k) slots."""
    rows = ranked(nodes.select("id", F.coalesce("depth", F.lit(0)).alias("depth")), ["depth"], ["id"], rn="k")
    radius = 100 + 180 * F.col("depth")
    angle = (F.col("k") - 1) * F.lit(TAU) / F.greatest(F.lit(8), F.col("k"))
    return rows.select("id", (width / 2 + radius * F.cos(angle)).alias("x"), (height / 2 + radius * F.sin(angle)).alias("y"))


def distribute(selection: DataFrame, axis: str) -> DataFrame:
    """Three or more nodes evenly spaced along an axis between its extremes, in their order."""
    at = F.coalesce(F.col(axis), F.lit(0.0))
    ends = selection.agg(F.struct(F.min(at).alias("lo"), F.max(at).alias("hi"))).scalar()
    rows = ranked(selection, [], [("at", at), "id"], rn="__rn", n="__n").withColumn("__e", ends)
    even = F.col("__e.lo") + (F.col("__e.hi") - F.col("__e.lo")) / F.nullif(F.col("__n") - 1, F.lit(0)) * (F.col("__rn") - 1)
    return rows.withColumn(axis, F.when(F.col("__n") >= 3, even).otherwise(F.col(axis))).drop("__rn", "__n", "__e")


# ---- registry -----------------------------------------------------------------------------

Layout = Callable[..., DataFrame]


class Layouts:
    """Layouts by name ('Circular' -> circular_layout); unknown names are an error."""

    def __init__(self) -> None:
        self._layouts: dict[str, tuple[Layout, list[str]]] = {}
        for name, fn in (("circular", circular), ("shell", shell), ("spiral", spiral), ("random", random),
                         ("sorted_square", sorted_square), ("compound", compound)):
            self.add_layout(f"{name}_layout", fn, ["graph", "seed"] if name == "random" else ["graph"])
        self.add_layout("radial_tree_layout", radial_tree, ["graph", "root"])

    def add_layout(self, name: str, function: Layout, params: list[str]) -> None:
        self._layouts[name] = (function, params)

    def get_layout_names(self) -> list[str]:
        return list(self._layouts)

    def get_layout(self, name: str) -> Layout:
        if name not in self._layouts:
            raise ValueError(f"Layout {name} does not exist")
        return self._layouts[name][0]

    def get_layout_params(self, name: str) -> list[str]:
        self.get_layout(name)
        return self._layouts[name][1]

    def positions(self, nodes: DataFrame, edges: DataFrame, layout: str, **params) -> DataFrame:
        """Scaled positions of a layout chosen by its display name."""
        return scale(self.get_layout(f"{layout.lower()}_layout")(nodes, edges, **params), layout)
