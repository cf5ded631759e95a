import math

import pytest
from pyspark.sql import functions as F

from graphloom.functions import numbers
from graphloom.operators import layout, stats


@pytest.fixture(scope="module")
def tree(spark):
    nodes = [("d1", 0, 0, ""), ("d2", 0, 0, ""), ("f1", 1, 0, "f1"), ("f2", 1, 0, "f2"), ("lost", 1, 0, ""), ("s1", 2, 9, "x"), ("s2", 2, 3, "x"),
             ("s3", 2, 5, "x/f2.py"), ("q", 2, 1, ""), ("u1", 3, 1, ""), ("u2", 3, 2, "")]
    edges = [("d1", "f1"), ("d1", "f2"), ("f1", "s1"), ("f1", "s2"), ("s1", "u1")]
    df = spark.createDataFrame(nodes, "id string, depth int, line int, file string").withColumn("label", F.col("id"))
    return df, spark.createDataFrame(edges, "src string, dst string").withColumn("kind", F.lit("contains"))


def at(df):
    return {r["id"]: (r["x"], r["y"]) for r in df.collect()}


def test_compound_places_every_node_once(tree):
    nodes, edges = tree
    got = layout.compound(nodes, edges)
    assert got.count() == nodes.count() and got.select("id").distinct().count() == nodes.count()
    pos = at(got)
    # Symbols of a file start at 12 o'clock in source order: s2 (line 3) before s1 (line 9).
    fx, fy = pos["f1"]
    assert pos["s2"] == pytest.approx((fx, fy - 0.45)) and math.dist(pos["s1"], pos["f1"]) == pytest.approx(0.45)
    assert math.dist(pos["u1"], pos["s1"]) == pytest.approx(0.22)
    # s3 has no containment edge but names its file.
    assert math.dist(pos["s3"], pos["f2"]) == pytest.approx(0.45)
    assert math.hypot(*pos["q"]) == pytest.approx(0.225)


def test_compound_without_directories_is_a_circle(tree):
    nodes, edges = tree
    got = at(layout.compound(nodes.where("depth > 0"), edges))
    assert all(math.hypot(*p) == pytest.approx(1) for p in got.values())


def test_arc_angle(spark):
    df = spark.createDataFrame([(1, 1), (1, 3), (3, 3)], "rn long, n long").select(layout.arc_angle(F.col("rn"), F.col("n")).alias("a"))
    assert [r["a"] for r in df.collect()] == pytest.approx([-math.pi / 2, -math.pi / 2, -math.pi / 2 + 5 * math.pi / 3])


def test_circle_spiral_and_square(tree):
    nodes, _ = tree
    n = nodes.count()
    ids = sorted(r["id"] for r in nodes.collect())
    circle = at(layout.circular(nodes))
    assert all(circle[v] == pytest.approx((math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n))) for i, v in enumerate(ids))
    assert at(layout.circular(nodes.where("id = 'd1'"))) == {"d1": (0.0, 0.0)}
    spiral = at(layout.spiral(nodes))
    assert max(max(abs(x), abs(y)) for x, y in spiral.values()) == pytest.approx(1)
    assert sum(x for x, _ in spiral.values()) == pytest.approx(0, abs=1e-9)
    square = at(layout.sorted_square(nodes.withColumn("kind", F.col("depth").cast("string"))))
    assert sorted(square.values()) == [(float(i // 4), float(i % 4)) for i in range(n)]


def test_random_is_stable_under_partitioning(tree):
    nodes, _ = tree
    assert at(layout.random(nodes, seed=3)) == at(layout.random(nodes.repartition(5), seed=3)) != at(layout.random(nodes, seed=4))
    assert all(0 <= v < 1 for p in at(layout.random(nodes)).values() for v in p)


def test_radial_tree(spark):
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c"), ("c", "r")], "src string, dst string")
    got = at(layout.radial_tree(edges.select(F.col("src").alias("id")), edges, "r"))
    assert got["r"] == pytest.approx((0, 0)) and math.hypot(*got["a"]) == pytest.approx(1) and math.hypot(*got["c"]) == pytest.approx(2)
    assert got["a"] == pytest.approx((math.cos(-math.pi), math.sin(-math.pi)), abs=1e-9) and got["b"] == pytest.approx((1, 0), abs=1e-9)


def test_registry(tree):
    nodes, edges = tree
    layouts = layout.Layouts()
    with pytest.raises(ValueError, match="does not exist"):
        layouts.get_layout("spring_layout")
    assert "compound_layout" in layouts.get_layout_names() and layouts.get_layout_params("random_layout") == ["graph", "seed"]
    layouts.add_layout("origin_layout", lambda n, e: n.select("id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y")), ["graph"])
    assert set(at(layouts.positions(nodes, edges, "Origin")).values()) == {(100.0, 200.0)}
    assert at(layout.scale(nodes.select("id", F.lit(1).alias("x"), F.lit(1).alias("y")), "Spectral"))["d1"] == (500.0, 500.0)


def test_distribute_and_align(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("b", 9.0, 2.0), ("c", 10.0, 6.0)], "id string, x double, y double")
    assert {k: v[0] for k, v in at(layout.distribute(df, "x")).items()} == {"a": 0.0, "b": 5.0, "c": 10.0}
    assert at(layout.distribute(df.where("id <> 'b'"), "x")) == {"a": (0.0, 1.0), "c": (10.0, 6.0)}
    assert {v[1] for v in at(stats.align(df, "middle")).values()} == {3.0} and {v[0] for v in at(stats.align(df, "right")).values()} == {10.0}


def test_snap(spark):
    df = spark.createDataFrame([(24.0,), (25.0,), (-25.0,), (-26.0,)], "v double").select(numbers.snap(F.col("v"), 50.0).alias("s"))
    assert [r["s"] for r in df.collect()] == [0.0, 50.0, 0.0, -50.0]


def test_category_slots(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None), ("d", "z")], "id string, kind string")
    assert {r["id"]: r["slot"] for r in stats.category_code(df, "kind", 2).collect()} == {"a": 0, "b": 1, "c": None, "d": 0}
