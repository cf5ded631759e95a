import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import nearest, traverse


@pytest.fixture(scope="module")
def random_graph(spark):
    rng = random.Random(5)
    n = 120
    pairs = [(f"n{rng.randrange(n):03}", f"n{rng.randrange(n):03}") for _ in range(90)]
    nodes = spark.createDataFrame([(f"n{i:03}",) for i in range(n)], "id string")
    return nodes, spark.createDataFrame(pairs, "src string, dst string"), pairs, n


def test_components_against_union_find(random_graph):
    nodes, edges, pairs, n = random_graph
    parent = {f"n{i:03}": f"n{i:03}" for i in range(n)}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert {r["id"]: r["component"] for r in traverse.components(nodes, edges).collect()} == {i: find(i) for i in parent}


def test_long_chain_is_one_component(spark):
    chain = spark.range(300).select(F.format_string("c%04d", "id").alias("src"), F.format_string("c%04d", F.col("id") + 1).alias("dst"))
    nodes = spark.range(301).select(F.format_string("c%04d", "id").alias("id"))
    assert traverse.components(nodes, chain).select("component").distinct().count() == 1


def reach(pairs, start):
    seen, todo = set(), [start]
    while todo:
        a = todo.pop()
        for s, d in pairs:
            if s == a and d not in seen:
                seen.add(d)
                todo.append(d)
    return seen - {start}


def test_descendants_with_cycles(spark, random_graph):
    nodes, edges, pairs, _ = random_graph
    start = pairs[0][0]
    got = {r["id"] for r in traverse.descendants(edges, nodes.where(F.col("id") == start)).collect()}
    assert got == reach(pairs, start)


def test_expand_unknown_node(random_graph):
    nodes, edges, _, _ = random_graph
    sub_nodes, sub_edges, meta = traverse.expand_node(nodes, edges, "nope")
    assert sub_nodes.count() == 0 and sub_edges.count() == 0 and tuple(meta.first()[:2]) == (0, 0)


def test_shortest_path(spark):
    edges = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "a2"), ("z", "y")], "src string, dst string")
    path = traverse.shortest_path(edges, "a", "e")
    assert [r["id"] for r in path.orderBy("step").collect()] == ["a", "b", "d", "e"]
    assert {(r["src"], r["dst"]) for r in traverse.path_edges(edges, path).collect()} == {("a", "b"), ("b", "d"), ("d", "e")}
    assert [r["id"] for r in traverse.shortest_path(edges, "e", "a").orderBy("step").collect()] == ["e", "d", "b", "a"]
    assert traverse.shortest_path(edges, "a", "z").count() == 0
    assert [r["id"] for r in traverse.shortest_path(edges, "a", "a").collect()] == ["a"]


def test_long_paths_are_walked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(traverse, "HOPS", 3)
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(10)] + [(f"n{i:02}", f"m{i + 1:02}") for i in range(0, 10, 2)] + [(f"m{i:02}", f"n{i + 1:02}") for i in range(1, 10, 2)]
    edges = spark.createDataFrame(chain, "src string, dst string")
    rows = traverse.shortest_path(edges, "n00", "n10").orderBy("step").collect()
    want = ["n00"]
    for i in range(1, 11):
        want.append(f"m{i:02}" if i % 2 else f"n{i:02}")
    assert [r["step"] for r in rows] == list(range(11))
    assert [r["id"] for r in rows] == want
    back = traverse.shortest_path(edges, "n10", "n00").orderBy("step").collect()
    assert [r["id"] for r in back] == want[::-1]


def test_cells_stay_small_in_a_dense_spot(spark):
    rng = random.Random(4)
    spots = {(rng.random(), rng.random()) for _ in range(400)}
    spots |= {(0.5 + rng.random() * 1e-9, 0.5 + rng.random() * 1e-9) for _ in range(1600)}
    parents = [(f"p{i:04}", x, y) for i, (x, y) in enumerate(sorted(spots))]
    df = spark.createDataFrame([(x, y, p) for p, x, y in parents], "px double, py double, parent string")
    levels, leaves = nearest.cell_levels(df)
    held = leaves.groupBy("cell").count()
    assert held.agg(F.max("count")).first()[0] <= nearest.LEAF and len(levels) <= 4
    for (cells, n), (_, more) in zip(levels, levels[1:], strict=False):
        assert cells.count() == n <= more
    kids = [(f"k{i:03}", 0.5 + rng.uniform(-1e-9, 2e-9), 0.5 + rng.uniform(-1e-9, 2e-9)) for i in range(60)]
    got = nearest.nearest_parent(spark.createDataFrame(kids, "id string, x double, y double"), df.select(F.col("parent").alias("id"), F.col("px").alias("x"), F.col("py").alias("y")))
    want = {k: min(math.hypot(x - px, y - py) for _, px, py in parents) for k, x, y in kids}
    assert {r["id"]: r["dist"] for r in got.collect()} == pytest.approx(want, abs=1e-18)


def test_selection_growth(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "a"), ("d", "e")], "src string, dst string")
    assert {r["id"] for r in traverse.neighbors(edges, "a").collect()} == {"b", "c"}
    grown = traverse.grow_selection(edges, spark.createDataFrame([("a",), ("e",)], "id string"))
    assert {r["id"] for r in grown.collect()} == {"a", "b", "c", "d", "e"}


def test_nearest_symbol_ancestor(spark):
    nodes = spark.createDataFrame([("s", 2)] + [(f"d{i}", 3) for i in range(9)] + [("x", 3), ("y", 3), ("orphan", 3)], "id string, depth int")
    links = [("s", "d0")] + [(f"d{i}", f"d{i + 1}") for i in range(8)] + [("x", "y"), ("y", "x")]
    got = {r["id"]: r["parent"] for r in traverse.nearest_symbol_ancestor(nodes, spark.createDataFrame(links, "src string, dst string")).collect()}
    assert got == {f"d{i}": "s" for i in range(9)}


def test_nearest_symbol_ancestor_joins_only_what_waits(spark, monkeypatch):
    rounds, cut = [], traverse.cut_and_observe

    def counted(df, **metrics):
        out, seen = cut(df, **metrics)
        rounds.append(seen["n"])
        return out, seen

    monkeypatch.setattr(traverse, "cut_and_observe", counted)
    lines = [(f"line{i}", 4) for i in range(40)]
    nodes = spark.createDataFrame([("s", 2), ("t", 2)] + [(f"sub{i}", 3) for i in range(10)] + lines + lines[:5], "id string, depth int")
    links = [("st"[i % 2], f"sub{i}") for i in range(10)] + [(f"sub{i % 10}", f"line{i}") for i in range(40)] + [("sub0", "line0")]
    got = traverse.nearest_symbol_ancestor(nodes, spark.createDataFrame(links, "src string, dst string")).collect()
    assert sorted(got) == sorted([(f"sub{i}", "st"[i % 2]) for i in range(10)] + [(f"line{i}", "st"[i % 2]) for i in range(40)])
    assert rounds == [2, 50, 40]


@pytest.mark.parametrize("levels, broadcast", [(4, 200_000), (1, 200_000), (2, 0)])
def test_nearest_symbol_ancestor_is_exact(spark, monkeypatch, levels, broadcast):
    monkeypatch.setattr(traverse, "LEVELS", levels)
    monkeypatch.setattr(traverse, "BROADCAST_ROWS", broadcast)
    rng = random.Random(levels)
    depth = {f"n{i:03}": rng.choice([1, 2, 2] + [3, 4, 5, 6] * 8) for i in range(200)}
    links = {(rng.choice([f"n{j:03}" for j in range(max(0, i - 2), i)] or ["gone"]), f"n{i:03}") for i in range(200) for _ in range(rng.choice([1, 1, 2]))}
    links |= {("n150", "n140"), ("gone", "n060"), ("n010", "unknown")}
    least = {}
    for src, dst in sorted(links, reverse=True):
        least[dst] = src
    want = {}
    for node in depth:
        at, seen = node, set()
        while depth.get(at, 0) >= 3 and at not in seen:
            seen.add(at)
            at = least.get(at)
        if depth[node] >= 3 and depth.get(at) == 2:
            want[node] = at
    got = traverse.nearest_symbol_ancestor(spark.createDataFrame(list(depth.items()), "id string, depth int"), spark.createDataFrame(list(links), "src string, dst string"))
    assert sorted(got.collect()) == sorted(want.items()) and len(want) > 50


@pytest.mark.parametrize("shape", ["uniform", "clustered", "line"])
def test_nearest_parent_by_cells_is_exact(spark, shape):
    rng = random.Random(3)

    def spot():
        if shape == "line":
            return (rng.random(), 0.5)
        if shape == "clustered" and rng.random() < 0.7:
            return (0.9 + rng.random() * 1e-4, 0.1 + rng.random() * 1e-4)
        return (rng.random(), rng.random())

    parents = [(f"p{i:03}", *spot()) for i in range(300)] + [("p900", 0.25, 0.25), ("p901", 0.25, 0.25)]
    kids = [(f"k{i:03}", rng.uniform(-1, 2), rng.uniform(-1, 2)) for i in range(100)] + [("k900", 0.25, 0.25)]
    schema = "id string, x double, y double"
    p_df, k_df = spark.createDataFrame(parents, schema), spark.createDataFrame(kids + [("none", None, 1.0)], schema)
    want = {k: min((math.hypot(x - px, y - py), p) for p, px, py in parents) for k, x, y in kids}
    for in_row in (10, 1000):
        got = {r["id"]: (r["dist"], r["parent"]) for r in nearest.nearest_parent(k_df, p_df, in_row).collect()}
        assert got.keys() == want.keys()
        assert all(got[k][0] == pytest.approx(want[k][0], abs=1e-12) for k in want)
        assert got["k900"][1] == "p900"


def test_ends_are_dealt_out_before_they_are_made_distinct(spark, monkeypatch):
    nodes, edges = spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), spark.createDataFrame([("a", "b"), ("a", "b")], "src string, dst string")
    roots = traverse.roots(nodes, edges)
    assert sorted(r["id"] for r in roots.collect()) == ["a", "c"]
    assert "Aggregate" not in roots._jdf.queryExecution().optimizedPlan().toString()
    cut, plans = traverse.cut_lineage, []
    monkeypatch.setattr(traverse, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    assert sorted(map(tuple, traverse.components(nodes, edges).collect())) == [("a", "a"), ("b", "a"), ("c", "c")]
    assert "RepartitionByExpression" in plans[0]
