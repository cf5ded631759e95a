"""Queries over positions, orders and layouts."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import numbers
from graphloom.operators import filters, layout, nearest, ranking, stats
from graphloom.plans import inputs as I
from graphloom.plans.registry import query, table

W = I.with_inputs
TAU = "6.283185307179586"


def _rounded(positions: DataFrame, places: int = 6) -> DataFrame:
    """Positions for comparison; adding 0 turns a negative zero into zero."""
    return positions.withColumns({c: F.round(c, places) + F.lit(0.0) for c in ("x", "y")})


def _xy(x: str, y: str) -> str:
    return f"round({x}, 6) + 0.0 AS x, round({y}, 6) + 0.0 AS y"


# ---- selections ---------------------------------------------------------------------------

@query(W("points") + "SELECT id FROM points WHERE x BETWEEN -0.05 AND 0.1 AND y BETWEEN -0.1 AND 0.05")
def b22_box_select(spark, sf):
    return filters.box_select(I.points(spark, sf), 0.1, -0.1, -0.05, 0.05).select("id")


POLYGON = [(-0.15, -0.1), (0.2, -0.15), (0.05, 0.0), (0.15, 0.2), (-0.1, 0.12)]


@query(W("points") + "SELECT id FROM points WHERE (" + " + ".join(
    f"CASE WHEN ({ay} > y) <> ({by} > y) AND x < CAST({(bx - ax) / (by - ay)!r} AS DOUBLE) * (y - CAST({ay} AS DOUBLE)) + CAST({ax} AS DOUBLE) THEN 1 ELSE 0 END"
    for (ax, ay), (bx, by) in zip(POLYGON, POLYGON[1:] + POLYGON[:1])) + ") % 2 = 1")
def b23_lasso_select(spark, sf):
    return filters.lasso_select(I.points(spark, sf), POLYGON).select("id")


@query(W("points") + "SELECT id, label FROM points WHERE x > 0 AND label < 5")
def b16_positioned_only(spark, sf):
    placed = I.points(spark, sf).withColumns({"x": F.when(F.col("x") > 0, F.col("x")), "y": F.when(F.col("label") < 5, F.col("y"))})
    return filters.positioned_only(placed).select("id", "label")


@query(W("points") + "SELECT round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round(avg(x), 6) AS avg_x, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y, round(avg(y), 6) AS avg_y FROM points")
def e17_extent(spark, sf):
    found = stats.extent(I.points(spark, sf))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query(W("points") + "SELECT id, " + _xy("(SELECT min(x) FROM points)", "y") + " FROM points")
def e17_align_left(spark, sf):
    return _rounded(stats.align(I.points(spark, sf), "left").select("id", "x", "y"))


@query(W("points") + "SELECT id, " + _xy("x", "(SELECT avg(y) FROM points)") + " FROM points")
def e17_align_middle(spark, sf):
    return _rounded(stats.align(I.points(spark, sf), "middle").select("id", "x", "y"))


@query(W("points") + f"""SELECT 'right' AS form, id, {_xy("(SELECT max(x) FROM points)", "y")} FROM points UNION ALL SELECT 'center', id, {_xy("(SELECT avg(x) FROM points)", "y")} FROM points
    UNION ALL SELECT 'top', id, {_xy("x", "(SELECT min(y) FROM points)")} FROM points UNION ALL SELECT 'bottom', id, {_xy("x", "(SELECT max(y) FROM points)")} FROM points""")
def e17_align_others(spark, sf):
    forms = [_rounded(stats.align(I.points(spark, sf), d).select("id", "x", "y")).select(F.lit(d).alias("form"), "id", "x", "y") for d in ("right", "center", "top", "bottom")]
    return functools.reduce(lambda a, b: a.unionByName(b), forms)


@query(W("points") + "SELECT id, round(floor(x / 0.05 + 0.5) * 0.05, 6) + 0.0 AS x FROM points")
def j_snap_to_grid(spark, sf):
    return I.points(spark, sf).select("id", (F.round(numbers.snap(F.col("x"), 0.05), 6) + F.lit(0.0)).alias("x"))


@query(W("points") + """
    SELECT id, round(lo + (hi - lo) / (n - 1) * (rn - 1), 6) + 0.0 AS x FROM
      (SELECT id, min(x) OVER () AS lo, max(x) OVER () AS hi, count(*) OVER () AS n, row_number() OVER (ORDER BY x, id) AS rn FROM points)""")
def f13_distribute(spark, sf):
    return _rounded(layout.distribute(I.points(spark, sf), "x")).select("id", "x")


# ---- nearest parents ----------------------------------------------------------------------

_NEAR = """
    SELECT id, x, y, parent, dist FROM (SELECT c.id, c.x, c.y, p.id AS parent, sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y)) AS dist,
        row_number() OVER (PARTITION BY c.id ORDER BY sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y)), p.id) AS r FROM points c, point_parents p) WHERE r = 1"""
I.CTE["near"] = (["points", "point_parents"], _NEAR)


@query(W("near") + "SELECT id, parent, round(dist, 6) AS dist FROM near")
def d18_nearest_parent(spark, sf):
    found = nearest.nearest_parent(I.points(spark, sf), I.point_parents(spark, sf))
    return found.select("id", "parent", F.round("dist", 6).alias("dist"))


# The other way: parents are all vectors, children their mirror images, found by descending cells.
@query(W("points") + """
    SELECT c.id, min(sqrt((c.y - p.x) * (c.y - p.x) + (c.x - p.y) * (c.x - p.y))) AS d FROM points c, points p GROUP BY c.id""".replace(
    "SELECT c.id, min(", "SELECT c.id, round(min(").replace(") AS d", "), 6) AS dist"))
def d18_nearest_parent_cells(spark, sf):
    points = I.points(spark, sf)
    mirrored = points.select("id", F.col("y").alias("x"), F.col("x").alias("y"))
    return nearest.nearest_parent(mirrored, points, in_row=64).select("id", F.round("dist", 6).alias("dist"))


@query(W("near") + """, fr AS (SELECT parent AS id, max(dist) + 4 + 20 AS r FROM near GROUP BY 1),
    c AS (SELECT 0 AS one, avg(x) AS x, avg(y) AS y FROM point_parents),
    dr AS (SELECT max(sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)) + coalesce(r, 7.2)) + 40 AS r FROM point_parents p CROSS JOIN c LEFT JOIN fr USING (id))
    SELECT id, CAST(1 AS BIGINT) AS depth, round(r, 6) AS radius FROM fr UNION ALL SELECT 'root', 0, round(r, 6) FROM dr""")
def e16_group_bounds(spark, sf):
    files, root = I.point_parents(spark, sf), I.point_parents(spark, sf).agg(F.avg("x").alias("x"), F.avg("y").alias("y")).withColumn("id", F.lit("root"))
    bounds = stats.group_bounds(files, nearest.nearest_parent(I.points(spark, sf), files), root, nearest.nearest_parent(files, root))
    return bounds.select("id", F.col("depth").cast("long").alias("depth"), F.round("radius", 6).alias("radius"))


# ---- orders -------------------------------------------------------------------------------

@query(W("tree_nodes") + """
    SELECT id, round(-1.5707963267948966 + coalesce((rn - 1) / nullif(n - 1, 0), 0) * 5.235987755982989, 6) AS angle FROM
      (SELECT id, CAST(row_number() OVER w AS DOUBLE) AS rn, CAST(count(*) OVER (PARTITION BY file) AS DOUBLE) AS n FROM tree_nodes WHERE depth = 2 WINDOW w AS (PARTITION BY file ORDER BY line, id))""")
def f3_arc_angle(spark, sf):
    rows = ranking.source_order(I.tree_nodes(spark, sf).where("depth = 2"))
    return rows.select("id", F.round(layout.arc_angle(F.col("rn"), F.col("n")), 6).alias("angle"))


@query(W("tree_edges") + f"""
    SELECT dst AS id, round({TAU} * (row_number() OVER (PARTITION BY src ORDER BY dst) - 1) / count(*) OVER (PARTITION BY src) + 0.5235987755982988, 6) AS angle FROM tree_edges""")
def f4_orbit_index(spark, sf):
    rows = ranking.ranked(I.tree_edges(spark, sf), ["src"], ["dst"], n="n")
    return rows.select(F.col("dst").alias("id"), F.round(layout.orbit_angle(F.col("rn"), F.col("n")), 6).alias("angle"))


@query(W("tree_nodes") + f"""
    SELECT id, {_xy("400 + r * cos(a)", "300 + r * sin(a)")} FROM (SELECT id, 100 + 180 * depth AS r, (k - 1) * {TAU} / greatest(8, k) AS a
      FROM (SELECT id, depth, row_number() OVER (PARTITION BY depth ORDER BY id) AS k FROM tree_nodes))""")
def f17_depth_ring(spark, sf):
    return _rounded(layout.depth_ring(I.tree_nodes(spark, sf)))


I.CTE["grid"] = (["tree_nodes"], """
    SELECT file, CAST(i % g AS DOUBLE) * 220 AS cx, floor(i / g) * 220 AS cy FROM (SELECT file, row_number() OVER (ORDER BY f, file) - 1 AS i, CAST(ceil(sqrt(count(*) OVER ())) AS BIGINT) AS g
      FROM (SELECT file, min(line) AS f FROM tree_nodes WHERE depth = 2 GROUP BY file))""")


@query(W("grid") + "SELECT file, cx, cy FROM grid")
def f15_cluster_grid(spark, sf):
    return layout.cluster_grid(I.tree_nodes(spark, sf).where("depth = 2").withColumn("seq", F.col("line")))


@query(W("grid") + f"""
    SELECT id, {_xy("cx + (30 + 8 * (i % 3)) * cos(a)", "cy + (30 + 8 * (i % 3)) * sin(a)")} FROM
      (SELECT id, file, i, {TAU} * i / n AS a FROM (SELECT id, file, row_number() OVER (PARTITION BY file ORDER BY line, id) - 1 AS i, count(*) OVER (PARTITION BY file) AS n FROM tree_nodes WHERE depth = 2))
    JOIN grid USING (file)""")
def f16_ring_slots(spark, sf):
    symbols = I.tree_nodes(spark, sf).where("depth = 2").withColumn("seq", F.col("line"))
    return _rounded(layout.ring_slots(symbols, layout.cluster_grid(symbols)))


# ---- layouts ------------------------------------------------------------------------------

I.CTE["numbered"] = (["tree_nodes"], "SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM tree_nodes")


@query(W("numbered") + f"SELECT id, {_xy(f'cos({TAU} * i / n)', f'sin({TAU} * i / n)')} FROM numbered")
def i1_circular(spark, sf):
    return _rounded(layout.circular(I.tree_nodes(spark, sf)))


@query(W("numbered") + f"SELECT id, {_xy(f'cos({TAU} * i / n + 3.141592653589793)', f'sin({TAU} * i / n + 3.141592653589793)')} FROM numbered")
def i1_shell(spark, sf):
    return _rounded(layout.shell(I.tree_nodes(spark, sf)))


@query(W("tree_nodes") + f"""
    SELECT id, {_xy("r * cos(a)", "r * sin(a)")} FROM (SELECT id, (ring + CASE WHEN inner_n = 1 THEN 0 ELSE 1 END) / CAST(k AS DOUBLE) AS r, {TAU} * i / n + 3.141592653589793 / k * (ring + 1) AS a
      FROM (SELECT *, max(ring) OVER () + 1 AS k, min(CASE WHEN ring = 0 THEN n END) OVER () AS inner_n
        FROM (SELECT id, dense_rank() OVER (ORDER BY kind) - 1 AS ring, row_number() OVER (PARTITION BY kind ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n FROM tree_nodes)))""")
def i1_shell_by_kind(spark, sf):
    return _rounded(layout.shell(I.tree_nodes(spark, sf), groups="kind"))


@query(W("numbered") + f""", p AS (SELECT id, i * cos(0.35 * i) AS x, i * sin(0.35 * i) AS y FROM numbered), c AS (SELECT avg(x) AS ax, avg(y) AS ay FROM p),
    m AS (SELECT max(greatest(abs(x - ax), abs(y - ay))) AS lim FROM p, c) SELECT id, round((x - ax) / lim, 4) + 0.0 AS x, round((y - ay) / lim, 4) + 0.0 AS y FROM p, c, m""")
def i2_spiral(spark, sf):
    return _rounded(layout.spiral(I.tree_nodes(spark, sf)), 4)


@query(W("tree_nodes") + """
    SELECT id, CAST(('0x' || substr(sha256(id || '|7|x'), 1, 13)) AS BIGINT) / 4503599627370496.0 AS x,
           CAST(('0x' || substr(sha256(id || '|7|y'), 1, 13)) AS BIGINT) / 4503599627370496.0 AS y FROM tree_nodes""")
def i3_random(spark, sf):
    """Positions from a hash of the id and a seed."""
    return layout.random(I.tree_nodes(spark, sf), seed=7)


@query(W("tree_nodes") + """
    SELECT id, CAST(floor(i / g) AS DOUBLE) AS x, CAST(i % g AS DOUBLE) AS y FROM
      (SELECT id, row_number() OVER (ORDER BY kind, id) - 1 AS i, CAST(ceil(sqrt(count(*) OVER ())) AS BIGINT) AS g FROM tree_nodes)""")
def i4_f14_sorted_square(spark, sf):
    return layout.sorted_square(I.tree_nodes(spark, sf))


_SYM_R = "greatest(0.45, sqrt(greatest({n}, 1)) * 0.28)"


@query(W("tree_nodes", "tree_edges") + f""", placed AS (SELECT n.*, e.src AS parent FROM tree_nodes n LEFT JOIN tree_edges e ON e.dst = n.id),
    kids AS (SELECT *, CAST(row_number() OVER (PARTITION BY parent ORDER BY CASE WHEN depth = 1 THEN 0 ELSE line END, id) AS DOUBLE) AS rn, CAST(count(*) OVER (PARTITION BY parent) AS DOUBLE) AS n
             FROM placed WHERE depth > 0),
    wide AS (SELECT f.parent, max({_SYM_R.format(n='coalesce(s.n, 0)')}) AS widest, max(f.n) AS files FROM kids f
             LEFT JOIN (SELECT parent, max(n) AS n FROM kids WHERE depth = 2 GROUP BY 1) s ON s.parent = f.id WHERE f.depth = 1 GROUP BY 1),
    g AS (SELECT max(greatest(1.8, sqrt(greatest(files, 1)) * 0.9) + widest) AS mf, max(widest) AS ms FROM wide),
    d AS (SELECT id, x * s * 1.6 AS x, y * s * 0.7 AS y FROM (SELECT id, cos({TAU} * i / n) AS x, sin({TAU} * i / n) AS y, sqrt(n) * (mf + ms) * 1.6 AS s
          FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM tree_nodes WHERE depth = 0), g)),
    f AS (SELECT k.id, d.x + r * cos(a) AS x, d.y + r * sin(a) AS y FROM (SELECT *, {TAU} * (rn - 1) / n + 0.5235987755982988 AS a FROM kids WHERE depth = 1) k JOIN d ON d.id = k.parent
          JOIN (SELECT parent, greatest(1.8, sqrt(greatest(files, 1)) * 0.9) + widest AS r FROM wide) w ON w.parent = k.parent),
    arcs AS (SELECT *, -1.5707963267948966 + coalesce((rn - 1) / nullif(n - 1, 0), 0) * 5.235987755982989 AS a FROM kids WHERE depth > 1),
    s AS (SELECT k.id, f.x + {_SYM_R.format(n='n')} * cos(a) AS x, f.y + {_SYM_R.format(n='n')} * sin(a) AS y FROM arcs k JOIN f ON f.id = k.parent WHERE depth = 2),
    u AS (SELECT k.id, s.x + greatest(0.22, sqrt(greatest(n, 1)) * 0.14) * cos(a) AS x, s.y + greatest(0.22, sqrt(greatest(n, 1)) * 0.14) * sin(a) AS y FROM arcs k JOIN s ON s.id = k.parent WHERE depth = 3)
    SELECT id, {_xy("x", "y")} FROM (SELECT * FROM d UNION ALL SELECT * FROM f UNION ALL SELECT * FROM s UNION ALL SELECT * FROM u)""")
def i5_compound(spark, sf):
    return _rounded(layout.compound(I.tree_nodes(spark, sf), I.tree_edges(spark, sf)))


@query(W("tree_edges") + f""", o AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS rn, count(*) OVER (PARTITION BY src) AS n FROM tree_edges),
    t AS (SELECT 'dir::EUROPE' AS id, CAST(0 AS DOUBLE) AS angle, CAST({TAU} AS DOUBLE) AS span, 0 AS level
          UNION ALL SELECT o.dst, t.angle - t.span / 2 + (rn - 1) * t.span / n, t.span / n, level + 1 FROM t JOIN o ON o.src = t.id)
    SELECT id, {_xy("level * cos(angle)", "level * sin(angle)")} FROM t""")
def i6_radial_tree(spark, sf):
    return _rounded(layout.radial_tree(I.tree_nodes(spark, sf), I.tree_edges(spark, sf), "dir::EUROPE"))


@query(W("numbered") + f"SELECT id, {_xy(f'100 * cos({TAU} * i / n)', f'100 * sin({TAU} * i / n)')} FROM numbered")
def i7_scaled_layout_by_name(spark, sf):
    return _rounded(layout.Layouts().positions(I.tree_nodes(spark, sf), I.tree_edges(spark, sf), "Circular"))


@query(W("tree_nodes") + f"""
    SELECT s.id, {_xy("coalesce(f.label * 10, 0) + 25 * cos(a)", "coalesce(f.label * 20, 0) + 25 * sin(a)")} FROM
      (SELECT id, file, {TAU} * (row_number() OVER (PARTITION BY file ORDER BY id) - 1) / count(*) OVER (PARTITION BY file) AS a FROM tree_nodes WHERE depth = 2) s
    LEFT JOIN (SELECT n_name AS file, n_nationkey AS label FROM nation) f USING (file)""")
def i8_place_near_file(spark, sf):
    symbols = I.tree_nodes(spark, sf).where("depth = 2").select("id", "depth", F.col("file").alias("file_id"))
    files = table(spark, sf, "nation").select(
        F.col("n_name").alias("id"), (F.col("n_nationkey") * F.lit(10.0)).alias("x"), (F.col("n_nationkey") * F.lit(20.0)).alias("y"))
    return _rounded(layout.place_near_file(symbols, files))


