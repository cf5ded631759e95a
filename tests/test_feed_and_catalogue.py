import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators import catalogue, feed
from graphloom.sources import documents


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame([("fn::a.foo", 2, "foo"), ("file::a.py", 1, "a.py"), ('odd "id"', None, "q")], "id string, depth int, label string")
    edges = spark.createDataFrame([("file::a.py", "fn::a.foo", "contains"), ("file::a.py", 'odd "id"', "contains")], "src string, dst string, kind string")
    return nodes, edges


def test_feed_order_and_counts(small):
    events = feed.event_feed(*small, "Spring").orderBy("seq").collect()
    assert [e["event"] for e in events] == ["meta", "node", "node", "node", "edge", "edge", "done"]
    assert [json.loads(e["payload"])["id"] for e in events[1:4]] == ["file::a.py", "fn::a.foo", 'odd "id"']
    assert json.loads(events[0]["payload"]) == {"nodeCount": 3, "edgeCount": 2, "layout": "Spring"}


def test_empty_graph_feed(small):
    nodes, edges = small
    assert [e["event"] for e in feed.event_feed(nodes.where("false"), edges.where("false"), "x").orderBy("seq").collect()] == ["meta", "done"]


def test_fold_gives_the_graph_back(small):
    nodes, edges = small
    got_nodes, got_edges = feed.fold_feed(feed.encode_events(feed.event_feed(nodes, edges, "Spring")))
    assert {(r["id"], r["depth"], r["label"]) for r in got_nodes.collect()} == {tuple(r) for r in nodes.collect()}
    assert {(r["src"], r["dst"], r["kind"]) for r in got_edges.collect()} == {tuple(r) for r in edges.collect()}


def test_malformed_frames_are_ignored(spark):
    frames = [(1, 'event: node\ndata: {"id":"a","label":"old"}\n\n'), (2, "event: node\ndata: {oops\n\n"), (3, 'event: node\ndata: {"label":"no id"}\n\n'),
              (4, 'event: node\ndata: {"id":"a","label":"new"}\n\n'), (5, "event: edge\n\n"), (6, 'data: {"x":1}\n\n')]
    df = spark.createDataFrame(frames, "seq long, frame string")
    nodes, edges = feed.fold_feed(df)
    assert [(r["id"], r["label"]) for r in nodes.collect()] == [("a", "new")] and edges.count() == 0
    assert {r["seq"]: r["event"] for r in feed.decode_events(df).collect()}[6] == "message"


@pytest.mark.parametrize("shape, nodes_of, edges_key", [
    ("gjgf", lambda d: set(d["graph"]["nodes"]), ("graph", "edges")), ("node_link", lambda d: {n["id"] for n in d["nodes"]}, ("links",)),
    ("listing", lambda d: {n["id"] for n in d["nodes"]}, ("edges",))])
def test_written_parts_are_one_json_document(spark, small, tmp_path, shape, nodes_of, edges_key):
    nodes, edges = small
    documents.write_graph_json(nodes.repartition(3), edges, str(tmp_path / "doc"), shape, name='my "graph"')
    text = "".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*")))
    doc = json.loads(text)
    assert nodes_of(doc) == {r["id"] for r in nodes.collect()}
    for key in edges_key:
        doc = doc[key]
    assert {(e["source"], e["target"]) for e in doc} == {(r["src"], r["dst"]) for r in edges.collect()}


def test_read_graph_shapes(spark):
    docs = [("map", '{"nodes":{"a":{"label":"A","size":0,"metadata":{"size":7,"color":"red"}},"b":"skip"},"edges":[{"source":{"id":"a"},"target":"b"},{"source":"a"}]}'),
            ("list", '{"nodes":[{"id":"n","color":"blue","metadata":{"color":"red"}},{"label":"x"},3],"edges":[]}'), ("bad", "{")]
    df = spark.createDataFrame(docs, "name string, document string")
    got = {(r["name"], r["id"]): (r["label"], r["color"], r["size"]) for r in feed.read_graph_nodes(df).collect()}
    assert got == {("map", "a"): ("A", "red", 7.0), ("list", "n"): ("n", "blue", 10.0), ("list", "1"): ("x", "#00ff41", 10.0)}
    assert [(r["name"], r["src"], r["dst"]) for r in feed.read_graph_edges(df).collect()] == [("map", "a", "b")]


def ts(seconds):
    return F.timestamp_seconds(F.lit(seconds))


def test_run_store(spark, small, tmp_path):
    nodes, edges = small
    store = catalogue.RunStore(spark, str(tmp_path))
    assert store.list(ts(0)).count() == 0 and store.get("o-r::1", ts(0)) is None
    store.put(nodes, edges, "o-r::1", ts(1000), "first")
    store.put(nodes.where("depth = 1"), edges, "o-r::1", ts(2000), "second")
    store.put(nodes, edges, "o-r::2", ts(1500), "other")
    store.put(nodes, edges, "x-y::1", ts(1600), "elsewhere")
    store.put(nodes, edges, "nohash", ts(1600), "ignored")
    assert [(r["key"], r["label"], r["age_seconds"]) for r in store.list(ts(3000)).collect()] == [
        ("o-r::1", "second", 1000), ("x-y::1", "elsewhere", 1400), ("o-r::2", "other", 1500)]
    got_nodes, got_edges = store.get("o-r::1", ts(3000))
    assert got_nodes.count() == 1 and got_edges.count() == 2
    assert store.get("o-r::1", ts(2000 + 86_401)) is None and store.get("o-r::1", ts(2000 + 86_400)) is not None
    assert store.list(ts(2000 + 90_000)).where("is_stale").count() == 3
    assert store.evict("o-r::2", ts(3000)) and not store.evict("o-r::2", ts(3001)) and not store.evict("gone::1", ts(3000))
    assert store.evict_repo("o-r", ts(3000)) and store.get("o-r::1", ts(3000)) is None and store.get("x-y::1", ts(3000)) is not None
    store.put(nodes, edges, "o-r::2", ts(4000), "again")
    assert {r["key"] for r in store.list(ts(5000)).collect()} == {"x-y::1", "o-r::2"}


def test_tree_cache_and_bookmarks(spark, tmp_path):
    store = catalogue.RunStore(spark, str(tmp_path))
    files = spark.createDataFrame([("a.py", "")], "path string, folder string")
    folders = spark.createDataFrame([("", None)], "path string, parent_path string")
    store.put_tree(files, folders, "o-r", ts(1000))
    store.put_tree(files.where("false").unionByName(files).unionByName(files), folders, "o-r", ts(2000))
    assert store.get_tree("o-r", ts(2500))[0].count() == 2 and store.get_tree("o-r", ts(200_000)) is None and store.get_tree("none", ts(1)) is None
    mark = spark.createDataFrame([("home", "u1")], "name string, url string")
    store.log_change("bookmarks", mark, ts(1))
    store.log_change("bookmarks", mark.withColumn("url", F.lit("u2")), ts(2))
    store.log_change("bookmarks", mark.withColumn("name", F.lit("other")), ts(2))
    store.log_change("bookmarks", mark.withColumn("name", F.lit("other")), ts(3), deleted=True)
    assert [(r["name"], r["url"]) for r in store.current("bookmarks", "name string, url string", ["name"]).collect()] == [("home", "u2")]


def test_count_mismatches(spark, small):
    runs = spark.createDataFrame([("a", 2, 1), ("b", 5, 0)], "key string, node_count int, edge_count int")
    nodes = spark.createDataFrame([("a",), ("a",), ("b",)], "key string")
    assert [r["key"] for r in catalogue.count_mismatches(runs, nodes, nodes.where("key = 'a'").limit(1)).collect()] == ["b"]


def test_replay_shows_one_changed_attribute_and_one_doubled_edge(spark):
    nodes = spark.createDataFrame([("k1", f"n{i}", i, {"a": "1", "b": str(i)}, 0.5) for i in range(20)] + [("k2", "n0", None, None, -0.0)], "key string, id string, depth int, meta map<string,string>, size double")
    edges = spark.createDataFrame([("k1", f"n{i}", f"n{i + 1}") for i in range(19)] + [("k2", "n0", "n0")], "key string, src string, dst string")
    stored = {"nodes": nodes, "edges": edges}
    again = {"nodes": nodes.orderBy(F.rand(1)).withColumn("meta", F.map_from_entries(F.reverse(F.map_entries("meta")))).withColumn("size", F.abs("size")).withColumn("extra", F.lit(1)),
             "edges": edges.repartition(5)}
    assert catalogue.replay_mismatches(stored, again, ["key"]).count() == 0
    changed = {"nodes": nodes.withColumn("depth", F.when(F.col("key") == "k1", F.col("depth")).otherwise(0)), "edges": edges.unionByName(edges.where("key = 'k1' AND src = 'n3'"))}
    found = {tuple(r) for r in catalogue.replay_mismatches(stored, changed, ["key"]).collect()}
    assert found == {("nodes", "k2", 1, 1), ("edges", "k1", 19, 20)}
    gone = {"nodes": nodes.where("key = 'k1'"), "edges": edges}
    assert [tuple(r) for r in catalogue.replay_mismatches(stored, gone, ["key"]).collect()] == [("nodes", "k2", 1, 0)]
    # A swap between two rows keeps every column's values but not the rows.
    swapped = edges.withColumn("dst", F.when(F.col("src") == "n1", "n3").when(F.col("src") == "n2", "n2").otherwise(F.col("dst")))
    assert catalogue.replay_mismatches({"edges": edges}, {"edges": swapped}, ["key"]).count() == 1


def test_snapshots_are_saved_listed_loaded_and_deleted(spark, small, tmp_path):
    nodes, edges = small
    store = catalogue.RunStore(spark, str(tmp_path))
    at = lambda d: F.lit(f"2025-01-0{d} 00:00:00+00:00").cast("timestamp")
    assert store.load_snapshot("mine") is None
    store.save_snapshot("mine", nodes.limit(1), edges.limit(0), at(1))
    store.save_snapshot("a/b :: c", nodes, edges, at(1))
    store.save_snapshot("mine", nodes, edges, at(2))
    assert {(r["name"], r["node_count"], r["edge_count"]) for r in store.snapshots().collect()} == {("mine", nodes.count(), edges.count()), ("a/b :: c", nodes.count(), edges.count())}
    back_nodes, back_edges = store.load_snapshot("mine")
    assert catalogue.replay_mismatches({"n": nodes.withColumn("k", F.lit(1)), "e": edges.withColumn("k", F.lit(1))}, {"n": back_nodes.withColumn("k", F.lit(1)), "e": back_edges.withColumn("k", F.lit(1))}, ["k"]).count() == 0
    store.delete_snapshot("mine", at(3))
    assert store.load_snapshot("mine") is None and [r["name"] for r in store.snapshots().collect()] == ["a/b :: c"]


def test_feeds_numbered_in_ranges_are_replayed(spark, monkeypatch):
    """As with a feed of more rows than one window takes."""
    import functools

    from graphloom.operators import ranking
    from graphloom.plans import catalog

    sf = "/root/testdata/sf0.001"
    whole = {n: sorted(map(tuple, catalog.QUERIES[n](spark, sf).collect())) for n in ("m10_replay_mismatches", "k8_fold_whole_feed")}
    monkeypatch.setattr(feed, "ranked", functools.partial(ranking.ranked, task_rows=100))
    for name, rows in whole.items():
        assert sorted(map(tuple, catalog.QUERIES[name](spark, sf).collect())) == rows
