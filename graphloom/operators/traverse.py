"""Reachability, paths, components and ancestors: frontier loops over DataFrames.

Each round is cut from its lineage by a checkpoint in the shared folder. The driver only sees
counts. A frontier is broadcast when its counted size allows, so a round does not shuffle the
edges; beyond that it is a shuffle join, where adaptive skew handling splits a hub's edges.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import filters, stats
from graphloom.operators.ranking import ranked
from graphloom.operators.skew import own_shuffle
from graphloom.session import cut_and_observe, cut_lineage

BROADCAST_ROWS = 200_000
HOPS = 16  # layers of a path walked in one job
MERGE_EVERY = 8
LEVELS = 4  # of a tree, walked one by one before pointers are doubled


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _cut_and_count(df: DataFrame) -> tuple[DataFrame, int]:
    out, seen = cut_and_observe(df, n=F.count(F.lit(1)))
    return out, seen["n"]


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge as (src, dst), once each."""
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return edges.select(both.alias("e")).select("e.src", "e.dst").distinct()


def descendants(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Ids reachable along out-edges from any start id, the start ids themselves left out."""
    links = cut_lineage(edges.select("src", "dst"))
    frontier, rows = _cut_and_count(start.select("id").distinct())
    seen, rounds = frontier, 0
    while rows:
        reached = links.join(_small(frontier.withColumnRenamed("id", "src"), rows), "src", "left_semi").select(
            F.col("dst").alias("id")).distinct()
        frontier, rows = _cut_and_count(reached.join(seen, "id", "left_anti"))
        rounds += 1
        seen = seen.unionByName(frontier)
        if rounds % MERGE_EVERY == 0:
            seen = cut_lineage(seen)
    return seen.join(start.select("id").distinct(), "id", "left_anti")


def expand_node(nodes: DataFrame, edges: DataFrame, node_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and metadata of the sub-graph on a node and its descendants; unknown ids give nothing."""
    start = nodes.where(F.col("id") == node_id).select("id")
    ids = cut_lineage(start.unionByName(descendants(edges, start)).distinct())
    sub_nodes = nodes.join(ids, "id", "left_semi")
    sub_edges = filters.known_endpoints(edges, ids)
    return sub_nodes, sub_edges, stats.graph_metadata(sub_nodes, sub_edges, "Spring")


def neighbors(edges: DataFrame, node_id: str) -> DataFrame:
    """Ids one step away in either direction."""
    out = edges.where(F.col("src") == node_id).select(F.col("dst").alias("id"))
    into = edges.where(F.col("dst") == node_id).select(F.col("src").alias("id"))
    return out.union(into).distinct()


def grow_selection(edges: DataFrame, selection: DataFrame) -> DataFrame:
    """The selection and everything one step away from it."""
    ids = selection.select("id").distinct()
    out = edges.join(own_shuffle(ids.withColumnRenamed("id", "src")), "src", "left_semi").select(F.col("dst").alias("id"))
    into = edges.join(own_shuffle(ids.withColumnRenamed("id", "dst")), "dst", "left_semi").select(F.col("src").alias("id"))
    return ids.union(out).union(into).distinct()


def shortest_path(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(step, id) of a shortest undirected path, the least one by its ids; no path or unknown ends, no rows.

    Distances spread from `b`; every node keeps the least of its neighbours that are one step nearer,
    and the path follows these from `a`, HOPS layers in one job. A row holds an id and the next one
    only, whatever the length of the path, and the driver one id.
    """
    spark = edges.sparkSession
    links = cut_lineage(undirected(edges))
    first = links.where(F.col("src") == b).select(F.col("src").alias("id"), F.lit(None).cast("string").alias("next")).limit(1)
    here = (F.col("id") == a).cast("int")

    def layer(df: DataFrame) -> tuple[DataFrame, int, bool]:
        out, seen = cut_and_observe(df, n=F.count(F.lit(1)), there=F.max(here))
        return out, seen["n"], bool(seen["there"])

    frontier, rows, there = layer(first)
    layers, seen = [frontier], frontier.select("id")
    while rows and not there:
        from_ = _small(frontier.select(F.col("id").alias("src")), rows)
        reached = links.join(from_, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("next"))
        frontier, rows, there = layer(reached.join(seen, "id", "left_anti"))
        layers.append(frontier)
        seen = seen.unionByName(frontier.select("id"))
        if len(layers) % MERGE_EVERY == 0:
            seen = cut_lineage(seen)
    path = spark.createDataFrame([], "step int, id string")
    if not rows:
        return path
    at, step = a, 0
    while layers:
        some = [layers.pop() for _ in range(min(HOPS, len(layers)))]
        row = some[0].where(F.col("id") == at).select(F.col("id").alias("h0"), F.col("next").alias("h1"))
        for i, more in enumerate(some[1:], start=1):
            row = more.join(F.broadcast(row), F.col("id") == F.col(f"h{i}")).select(*row.columns, F.col("next").alias(f"h{i + 1}"))
        row = cut_lineage(row)
        n = len(some)
        path = path.unionByName(row.select(F.explode(F.array(*[F.struct(F.lit(step + i).alias("step"), F.col(f"h{i}").alias("id")) for i in range(n)])).alias("p")).select("p.*"))
        at, step = row.select(f"h{n}").first()[0], step + n
    return path


def path_edges(edges: DataFrame, path: DataFrame) -> DataFrame:
    """Edges, of either direction, between consecutive nodes of a path."""
    pairs = path.select(F.col("step").alias("s"), F.col("id").alias("p")).join(
        path.select((F.col("step") - 1).alias("s"), F.col("id").alias("q")), "s")
    steps = pairs.select(F.explode(F.array(F.struct(F.col("p").alias("src"), F.col("q").alias("dst")),
                                           F.struct(F.col("q").alias("src"), F.col("p").alias("dst")))).alias("e")).select("e.*")
    return edges.join(steps.distinct(), ["src", "dst"], "left_semi")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge leads to. The ends of edges are not made distinct first: they hardly repeat, and a split's worth of them is held by one task."""
    return nodes.select("id").join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) with the least id of each weak component.

    Alternating large-star and small-star contraction (Kiveris et al. 2014): a round only
    needs the least neighbour of each node, an aggregate, and a join back to the pairs in which
    adaptive execution can split a hub.
    """
    # Dealt out before they are made distinct: a task then holds its share of the pairs, not those of a whole split of the input.
    pairs = cut_lineage(edges.where(F.col("src") != F.col("dst")).select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).repartition("u", "v").distinct())
    mark = None
    while True:
        pairs, new_mark = cut_and_observe(_small_star(_large_star(pairs)), n=F.count(F.lit(1)), sum=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        if new_mark == mark:
            break
        mark = new_mark
    labels = pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.select("id").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(own_shuffle(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(own_shuffle(least), "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def children_map(*tiers: DataFrame) -> DataFrame:
    """(ancestor, descendant) over parent tables (id, parent) of successive tiers, top tier first."""
    result, below = None, None
    for tier in reversed(tiers):
        direct = tier.select(F.col("parent").alias("ancestor"), F.col("id").alias("descendant"))
        if below is not None:
            deeper = below.join(tier.select(F.col("id").alias("ancestor"), "parent"), "ancestor").select(
                F.col("parent").alias("ancestor"), "descendant")
            direct = direct.unionByName(deeper)
        below = direct
        result = direct if result is None else result.unionByName(direct)
    return result


def nearest_symbol_ancestor(nodes: DataFrame, contains: DataFrame) -> DataFrame:
    """(id, parent): the first depth-2 node above each deeper node, every id once.

    A node with several parents follows the least. Symbols spread downwards a level a round, and only
    nodes they have not reached are joined again. Below LEVELS pointers are doubled, so chains of
    length n need log2(n) rounds more and cycles just never arrive.
    """
    # Depths and parents meet in one aggregate; the hash tells long ids apart at once when they are sorted.
    deep = nodes.where("depth >= 3").select("id", F.lit(None).cast("string").alias("src"), F.lit(True).alias("deep"))
    ends = deep.unionByName(contains.select(F.col("dst").alias("id"), "src", F.lit(False).alias("deep")))
    up = ends.groupBy(F.xxhash64("id").alias("hash"), "id").agg(F.min("src").alias("at"), F.max("deep").alias("deep"))
    left = up.where("deep AND id IS NOT NULL AND at IS NOT NULL").select("id", "at")
    reached, rows = _cut_and_count(nodes.where("depth = 2").select("id", F.col("id").alias("parent")).distinct())
    found = []
    for _ in range(LEVELS):
        above = reached.select(F.col("id").alias("at"), "parent")
        above = F.broadcast(above) if rows <= BROADCAST_ROWS else above.hint("merge")
        met, seen = cut_and_observe(left.join(above, "at", "left").select("id", "at", "parent"), n=F.count(F.lit(1)), there=F.count("parent"))
        reached, left = met.where("parent IS NOT NULL").select("id", "parent"), met.where("parent IS NULL").select("id", "at")
        rows, waiting = seen["there"], seen["n"] - seen["there"]
        found.append(reached)
        if not rows or not waiting:
            break
    else:
        found[-1] = _doubled(left, reached, waiting)
    return reduce(DataFrame.unionByName, found)


def _doubled(left: DataFrame, reached: DataFrame, waiting: int) -> DataFrame:
    """`reached` (id, parent) and all nodes of `left` (id, at) whose pointers lead there."""
    jumps = left.withColumn("parent", F.lit(None).cast("string")).unionByName(reached.withColumn("at", F.lit(None).cast("string")))
    for _ in range(ceil(log2(max(2, waiting))) + 1):
        further = jumps.select(F.col("id").alias("at"), F.col("at").alias("next"), "parent").hint("merge")
        moved = jumps.where("parent IS NULL").select("id", "at").join(further, "at").select("id", F.col("next").alias("at"), "parent")
        jumps, seen = cut_and_observe(jumps.where("parent IS NOT NULL").unionByName(moved), n=F.count(F.lit(1)), there=F.count("parent"))
        if seen["n"] == seen["there"]:
            break
    return jumps.where("parent IS NOT NULL").select("id", "parent")


def tree_levels(edges: DataFrame, root: str):
    """Yield (level, frontier) from a root: frontier(id, parent, rn, n, angle, span) for radial layouts."""
    spark = edges.sparkSession
    order = cut_lineage(ranked(edges.select("src", "dst").distinct(), ["src"], ["dst"], rn="rn", n="n"))
    frontier = spark.createDataFrame([(root, 0.0)], "id string, angle double").withColumn("span", F.lit(2.0) * F.pi())
    seen, rows, level = frontier.select("id"), 1, 0
    while rows:
        yield level, frontier
        child_angle = F.col("angle") - F.col("span") / 2 + (F.col("rn") - 1) * F.col("span") / F.col("n")
        reached = order.join(_small(frontier.withColumnRenamed("id", "src"), rows), "src").select(
            F.col("dst").alias("id"), F.struct("src", child_angle.alias("angle"), (F.col("span") / F.col("n")).alias("span")).alias("s"))
        first = reached.groupBy("id").agg(F.min("s").alias("s")).join(seen, "id", "left_anti")
        frontier = cut_lineage(first.select("id", "s.angle", "s.span"))
        seen, rows, level = seen.unionByName(frontier.select("id")), frontier.count(), level + 1
        if level % MERGE_EVERY == 0:
            seen = cut_lineage(seen)
