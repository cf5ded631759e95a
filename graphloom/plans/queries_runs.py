"""Queries over graph documents, feeds and the run catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import keys, times
from graphloom.operators import catalogue, feed, filters
from graphloom.plans import inputs as I
from graphloom.plans.registry import query, table
from graphloom.session import cut_lineage, run_dir
from graphloom.sources import documents, files as tree

W = I.with_inputs
NOW_SQL = f"TIMESTAMP '{I.NOW}'"

# ---- documents and feeds ------------------------------------------------------------------


def _small_nodes(spark, sf):
    nodes = I.tree_nodes(spark, sf)
    return nodes.select("id", "depth", F.lit("tree").alias("language"), "kind", "label", "file", "line")


@query(W("tree_nodes", "tree_edges") + """
    SELECT seq, event, key FROM (SELECT row_number() OVER (ORDER BY rank, a, b, c) AS seq, event, key FROM (
      SELECT 0 AS rank, 0 AS a, '' AS b, '' AS c, 'meta' AS event, (SELECT count(*) FROM tree_nodes) || '/' || (SELECT count(*) FROM tree_edges) AS key
      UNION ALL SELECT 1, depth, id, '', 'node', id FROM tree_nodes UNION ALL SELECT 2, 0, src, dst, 'edge', src || '>' || dst FROM tree_edges UNION ALL SELECT 3, 0, '', '', 'done', ''))""")
def k7_event_feed(spark, sf):
    events = feed.event_feed(_small_nodes(spark, sf), I.tree_edges(spark, sf), "Spring")
    j = lambda k: F.get_json_object("payload", f"$.{k}")
    key = F.when(F.col("event") == "meta", F.concat_ws("/", j("nodeCount"), j("edgeCount"))).when(F.col("event") == "node", j("id")).when(
        F.col("event") == "edge", F.concat_ws(">", j("source"), j("target"))).otherwise("")
    return events.select("seq", "event", key.alias("key"))


# Frames of low value are broken or have no id; the last frame of an id wins.
@query("""
    SELECT 'u' || user_id AS id, arg_max(event_type, event_id) AS kind FROM events WHERE value >= 5 GROUP BY 1""")
def a12_k8_fold_feed(spark, sf):
    payload = F.to_json(F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), F.col("event_type").alias("kind")))
    broken = F.when(F.col("value") < 2, F.lit("{broken")).when(F.col("value") < 5, F.lit('{"kind":"x"}')).otherwise(payload)
    frames = feed.encode_events(table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.lit("node").alias("event"), broken.alias("payload")))
    return feed.fold_feed(frames)[0].select("id", "kind")


@query("""SELECT event_id AS seq, event_type AS event, CAST(value AS VARCHAR) AS v FROM events WHERE value >= 5""".replace("CAST(value AS VARCHAR)", "round(value, 4)"))
def a12_decode_events(spark, sf):
    payload = F.when(F.col("value") < 5, F.lit("not json")).otherwise(F.to_json(F.struct(F.col("value").alias("v"))))
    frames = feed.encode_events(table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("event"), payload.alias("payload")))
    return feed.decode_events(frames).select("seq", "event", F.round(F.get_json_object("payload", "$.v").cast("double"), 4).alias("v"))


# One small document per part: nodes as a map for even sizes, else as an array.
@query("""
    SELECT p_partkey, p_brand AS id, p_name AS label, CASE WHEN p_size > 25 THEN '#' || p_size ELSE '#00ff41' END AS color, CAST(p_size AS DOUBLE) AS size FROM part
    UNION ALL SELECT p_partkey, 'plain', 'plain', '#00ff41', 10.0 FROM part""")
def a14_read_graph_nodes(spark, sf):
    return feed.read_graph_nodes(_documents(spark, sf)).select("p_partkey", "id", "label", "color", "size")


def _documents(spark, sf):
    attrs = [F.col("p_size").alias("size"), F.when(F.col("p_size") > 25, F.concat(F.lit("#"), F.col("p_size").cast("string"))).alias("color"),
             F.struct(F.col("p_name").alias("label"), F.lit("#meta").alias("unused")).alias("metadata")]
    by_id = F.map_from_arrays(F.array("p_brand", F.lit("plain"), F.lit("skipped")), F.array(
        F.to_json(F.struct(*attrs)), F.lit("{}"), F.lit('"not-a-node"')))
    as_map = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(by_id), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ","), F.lit("}"))
    as_list = F.concat(F.lit("["), F.to_json(F.struct(F.col("p_brand").alias("id"), *attrs)), F.lit(',{"id":"plain"},7]'))
    nodes = F.when(F.col("p_size") % 2 == 0, as_map).otherwise(as_list)
    ends = F.concat(F.lit('[{"source":"'), F.col("p_brand"), F.lit('","target":{"id":"plain"},"label":"uses"},{"source":"x"},3]'))
    return table(spark, sf, "part").select("p_partkey", F.concat(F.lit('{"nodes":'), nodes, F.lit(',"edges":'), ends, F.lit("}")).alias("document")).select(
        "p_partkey", "document")


@query(W("tree_nodes") + "SELECT id, coalesce(nullif(label, ''), id) AS label FROM tree_nodes")
def a14_read_pieces_nodes(spark, sf):
    """A document written in pieces and read back from them, of any size."""
    path = run_dir(spark, "document")
    documents.write_graph_json(I.tree_nodes(spark, sf).select("id", "label", "depth"), I.tree_edges(spark, sf), path, "gjgf")
    return documents.read_graph_json(spark, path)[0].select("id", "label")


@query(W("tree_edges") + "SELECT src, dst FROM tree_edges")
def a14_read_pieces_edges(spark, sf):
    path = run_dir(spark, "document")
    documents.write_graph_json(I.tree_nodes(spark, sf).select("id", "label", "depth"), I.tree_edges(spark, sf), path, "listing")
    return documents.read_graph_json(spark, path)[1].select("src", "dst")


@query("SELECT p_partkey, p_brand AS src, 'plain' AS dst, 'uses' AS label FROM part")
def a14_read_graph_edges(spark, sf):
    return feed.read_graph_edges(_documents(spark, sf)).select("p_partkey", "src", "dst", "label")


@query(W("tree_nodes", "tree_edges") + """
    SELECT section, count(*) AS pieces, count(*) FILTER (WHERE lead) AS with_comma FROM (
      SELECT 0 AS section, FALSE AS lead UNION ALL SELECT 2, FALSE UNION ALL SELECT 4, FALSE
      UNION ALL SELECT 1, id <> (SELECT min(id) FROM tree_nodes) FROM tree_nodes
      UNION ALL SELECT 3, (src, dst) <> (SELECT min((src, dst)) FROM tree_edges) FROM tree_edges) GROUP BY section""")
def a11_graph_document(spark, sf):
    pieces = feed.graph_document(_small_nodes(spark, sf), I.tree_edges(spark, sf))
    return pieces.where(F.col("text").isNotNull()).groupBy("section").agg(
        F.count(F.lit(1)).alias("pieces"), F.count_if(F.col("text").startswith(",")).alias("with_comma"))


@query(W("tree_nodes", "tree_edges") + "SELECT 'node' AS part, id, label AS other, kind FROM tree_nodes UNION ALL SELECT 'edge', src, dst, kind FROM tree_edges")
def a11_graph_document_rows(spark, sf):
    """What the pieces of a document hold, node by node and edge by edge."""
    pieces = feed.graph_document(_small_nodes(spark, sf), I.tree_edges(spark, sf), "listing")
    text = F.ltrim(F.col("text"), F.lit(","))
    held = pieces.where("section IN (1, 3)").select("section", *[F.get_json_object(text, f"$.{k}").alias(k) for k in ("id", "label", "source", "target", "kind")])
    node = F.col("section") == 1
    return held.select(F.when(node, "node").otherwise("edge").alias("part"), F.when(node, F.col("id")).otherwise(F.col("source")).alias("id"),
                       F.when(node, F.col("label")).otherwise(F.col("target")).alias("other"), "kind")


@query(W("tree_nodes", "tree_edges") + "SELECT 'node' AS part, id, label AS other, kind FROM tree_nodes UNION ALL SELECT 'edge', src, dst, kind FROM tree_edges")
def k8_fold_whole_feed(spark, sf):
    """Nodes and edges that a feed gives back, each of them."""
    # Numbered once; nodes and edges are both read from it.
    frames = cut_lineage(feed.encode_events(feed.event_feed(_small_nodes(spark, sf), I.tree_edges(spark, sf), "Spiral")))
    nodes, edges = feed.fold_feed(frames)
    return nodes.select(F.lit("node").alias("part"), "id", F.col("label").alias("other"), "kind").unionByName(
        edges.select(F.lit("edge").alias("part"), F.col("src").alias("id"), F.col("dst").alias("other"), "kind"))


# ---- catalogue ----------------------------------------------------------------------------

@query("""
    SELECT c_custkey, substr(sha256('https://example.org/' || c_nationkey), 1, 16) || '::' ||
           substr(sha256('https://example.org/' || c_nationkey || '::ast::' || c_mktsegment || '::[''.c'', ''.h'', ''.py'']'), 1, 16) AS key FROM customer""")
def m1_run_key(spark, sf):
    url = F.concat(F.lit("https://example.org/"), F.col("c_nationkey").cast("string"))
    exts = F.array(F.lit(".py"), F.lit(".c"), F.lit(".h"))
    return table(spark, sf, "customer").select("c_custkey", keys.run_key(url, F.lit("ast"), F.col("c_mktsegment"), exts).alias("key"))


@query("""SELECT o_orderkey, strlen('{"id":"' || o_orderkey || '","kind":"' || o_orderpriority || '"}') AS size_bytes FROM orders""")
def m2_payload_size(spark, sf):
    row = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("kind")))
    return table(spark, sf, "orders").select("o_orderkey", F.octet_length(row).cast("long").alias("size_bytes"))


@query(W("tree_nodes", "tree_edges") + "SELECT 'node' AS part, kind, count(*) AS n FROM tree_nodes GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM tree_edges GROUP BY kind")
def m2_m3_put_and_get_run(spark, sf):
    """A graph stored twice under one key and read back: the newest version is served."""
    store = catalogue.RunStore(spark, run_dir(spark, "runs"))
    nodes, edges = I.tree_nodes(spark, sf), I.tree_edges(spark, sf)
    store.put(nodes.where("depth = 0"), edges.where("false"), "owner-repo::a1", F.lit("2001-12-30 00:00:00+00:00").cast("timestamp"), "old")
    store.put(nodes, edges, "owner-repo::a1", F.lit("2001-12-31 23:00:00+00:00").cast("timestamp"), "new")
    got_nodes, got_edges = store.get("owner-repo::a1", I.now())
    return got_nodes.groupBy(F.lit("node").alias("part"), "kind").agg(F.count(F.lit(1)).alias("n")).unionByName(
        got_edges.groupBy(F.lit("edge").alias("part"), "kind").agg(F.count(F.lit(1)).alias("n")))


I.CTE["newest_runs"] = (["run_rows"], "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC) AS r FROM run_rows) WHERE r = 1")


@query(W("newest_runs") + f"SELECT key, label, epoch(ts) AS ts, size_bytes FROM newest_runs WHERE epoch({NOW_SQL}) - epoch(ts) <= 31536000")
def m3_fresh_runs(spark, sf):
    return catalogue.fresh_runs(I.run_rows(spark, sf), I.now(), ttl=31_536_000).select("key", "label", times.epoch(F.col("ts")).alias("ts"), "size_bytes")


@query(W("newest_runs") + f"""
    SELECT key, CAST(floor(epoch({NOW_SQL}) - epoch(ts)) AS BIGINT) AS age_seconds, epoch({NOW_SQL}) - epoch(ts) >= 86401 AS is_stale FROM newest_runs ORDER BY ts DESC, key LIMIT 50""")
def m4_f9_list_runs(spark, sf):
    return catalogue.list_runs(I.run_rows(spark, sf), I.now()).select("key", "age_seconds", "is_stale")


# A repository is evicted at one moment, single runs at another; later runs stay.
@query(W("newest_runs") + """
    SELECT key FROM newest_runs WHERE NOT (starts_with(key, 'repo-3::') AND ts <= TIMESTAMP '2001-06-01') AND NOT (string_split(key, '::')[2] IN
      (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'MACHINERY') AND ts <= TIMESTAMP '1999-01-01')""")
def m5_evict(spark, sf):
    customer = table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'")
    single = customer.select(F.concat(F.lit("repo-"), F.col("c_nationkey").cast("string"), F.lit("::"), F.col("c_custkey").cast("string")).alias("scope"),
                             F.lit("1999-01-01 00:00:00+00:00").cast("timestamp").alias("ts"))
    repo = table(spark, sf, "nation").where("n_nationkey = 3").select(F.lit("repo-3").alias("scope"), F.lit("2001-06-01 00:00:00+00:00").cast("timestamp").alias("ts"))
    return catalogue.live_runs(I.run_rows(spark, sf), single.unionByName(repo)).select("key")


@query(W("page_folders") + """, h AS (SELECT min(repo) AS h FROM page_files)
    SELECT name, path, FALSE AS is_file FROM page_folders, h WHERE parent_path = h UNION ALL SELECT name, path, TRUE FROM page_files, h WHERE folder = h""")
def m6_tree_cache(spark, sf):
    """A stored listing, served one level below a path."""
    store = catalogue.RunStore(spark, run_dir(spark, "trees"))
    files = I.page_files(spark, sf).drop("raw")
    store.put_tree(files, I.page_folders(spark, sf), "web", I.now())
    stored_files, stored_folders = store.get_tree("web", I.now())
    return tree.list_level(stored_folders, stored_files, stored_files.agg(F.min("repo")).first()[0])


# Orders are changes of their customer's bookmark; status 'F' deletes it.
_CHANGES = """(SELECT o_custkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)"""


def _changes(spark, sf):
    return table(spark, sf, "orders").select(
        F.concat(F.lit("bookmark "), F.col("o_custkey").cast("string")).alias("name"), F.col("o_orderpriority").alias("url"),
        F.struct("o_orderdate", "o_orderkey").alias("at"), (F.col("o_orderstatus") == "F").alias("deleted"))


@query(f"SELECT 'bookmark ' || o_custkey AS name, o_orderpriority AS url FROM {_CHANGES} WHERE r = 1 AND o_orderstatus <> 'F'")
def m7_bookmarks(spark, sf):
    return catalogue.live_changes(_changes(spark, sf), ["name"]).select("name", "url")


@query("""SELECT 'snap ' || c_mktsegment AS name, count(*) AS node_count FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY 1""")
def m8_snapshots(spark, sf):
    """Snapshots logged by name, one of them deleted later; the listing reads no payload column."""
    store = catalogue.RunStore(spark, run_dir(spark, "snapshots"))
    snaps = table(spark, sf, "customer").groupBy(F.concat(F.lit("snap "), F.col("c_mktsegment")).alias("name")).agg(F.count(F.lit(1)).alias("node_count"))
    store.log_change("snapshots", snaps, F.lit("2001-01-01 00:00:00+00:00").cast("timestamp"))
    store.log_change("snapshots", snaps.where("name = 'snap MACHINERY'"), F.lit("2001-01-02 00:00:00+00:00").cast("timestamp"), deleted=True)
    return store.current("snapshots", "name string, node_count bigint", ["name"]).select("name", "node_count")


@query(W("run_rows") + "SELECT substr(sha256(url), 1, 16) AS url_hash, count(*) AS captures, epoch(max(ts)) AS latest FROM run_rows GROUP BY 1")
def m9_history(spark, sf):
    rows = I.run_rows(spark, sf).withColumn("url_hash", catalogue.url_hash(F.col("url")))
    return rows.groupBy("url_hash").agg(F.count(F.lit(1)).alias("captures"), times.epoch(F.max("ts")).alias("latest"))


@query(W("run_rows") + "SELECT substr(sha256(url), 1, 16) AS url_hash, epoch(ts) AS captured, label FROM run_rows WHERE url NOT LIKE '%/3'")
def m9_history_rows(spark, sf):
    """Captures logged by (url hash, time); those of one address are deleted later."""
    store = catalogue.RunStore(spark, run_dir(spark, "history"))
    rows = I.run_rows(spark, sf).select(catalogue.url_hash(F.col("url")).alias("url_hash"), F.col("ts").alias("captured_at"), "label", "url")
    store.log_change("history", rows.drop("url"), F.col("captured_at"))
    store.log_change("history", rows.where(F.col("url").endswith("/3")).drop("url"), F.lit("2002-01-01 00:00:00+00:00").cast("timestamp"), deleted=True)
    kept = store.current("history", "url_hash string, captured_at timestamp, label string", ["url_hash", "captured_at"])
    return kept.select("url_hash", times.epoch(F.col("captured_at")).alias("captured"), "label")


@query("""
    SELECT o_orderkey AS key, CAST(floor(o_totalprice / 70000) AS BIGINT) AS node_count, coalesce(n, 0) AS nodes_found FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
    WHERE CAST(floor(o_totalprice / 70000) AS BIGINT) <> coalesce(n, 0)""")
def m10_count_mismatches(spark, sf):
    """Declared against stored counts: every order declares a count, its lines are what was stored."""
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.floor(F.col("o_totalprice") / 70000).cast("long").alias("node_count"), F.lit(0).alias("edge_count"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"))
    found = catalogue.count_mismatches(runs, lines, lines.where(F.col("key").isNull()))
    return found.select("key", "node_count", "nodes_found")


# What the feed carries, folded back; one label is changed and one edge comes twice, which is all that may show.
@query(W("tree_nodes", "tree_edges") + """
    SELECT 'nodes' AS part, split_part(id, '::', 1) AS key, count(*) AS stored_rows, count(*) AS rebuilt_rows FROM tree_nodes
    WHERE split_part(id, '::', 1) = (SELECT split_part(max(id), '::', 1) FROM tree_nodes) GROUP BY 2
    UNION ALL SELECT 'edges', split_part(src, '::', 1), count(*), count(*) + 1 FROM tree_edges
    WHERE split_part(src, '::', 1) = (SELECT split_part(min(src), '::', 1) FROM tree_edges) GROUP BY 2""")
def m10_replay_mismatches(spark, sf):
    nodes, edges = _small_nodes(spark, sf), I.tree_edges(spark, sf)
    # The feed is read several times. Cut, it also takes no look-up of its own into those below.
    back_nodes, back_edges = feed.fold_feed(cut_lineage(feed.encode_events(feed.event_feed(nodes, edges, "Spiral"))))
    changed = back_nodes.withColumn("label", F.when(F.col("id") == back_nodes.agg(F.max("id")).scalar(), "other").otherwise(F.col("label")))
    first = back_edges.agg(F.min(F.struct("src", "dst"))).scalar()
    doubled = back_edges.unionByName(back_edges.where(F.struct("src", "dst") == first))
    key = lambda df, c: df.withColumn("key", F.split(c, "::")[0])
    stored = {"nodes": key(nodes, "id"), "edges": key(edges, "src")}
    return catalogue.replay_mismatches(stored, {"nodes": key(changed, "id"), "edges": key(doubled, "src")}, ["key"])


@query(W("tree_nodes", "tree_edges") + """SELECT 'node' AS part, id, label AS other FROM tree_nodes UNION ALL SELECT 'edge', src, dst FROM tree_edges
    UNION ALL SELECT 'listed', 'tree', (SELECT count(*) FROM tree_nodes) || '/' || (SELECT count(*) FROM tree_edges)""")
def m8_snapshot_payload(spark, sf):
    """A snapshot saved twice and another deleted: the listing, and what loading gives back."""
    store = catalogue.RunStore(spark, run_dir(spark, "snapshots"))
    nodes, edges = _small_nodes(spark, sf), I.tree_edges(spark, sf)
    day = lambda d: F.lit(f"2001-01-0{d} 00:00:00+00:00").cast("timestamp")
    store.save_snapshot("tree", nodes.where("depth < 2"), edges, day(1))
    store.save_snapshot("folders", nodes.where("depth = 0"), edges.where("false"), day(2))
    store.save_snapshot("tree", nodes, edges, day(3))
    store.delete_snapshot("folders", day(4))
    back_nodes, back_edges = store.load_snapshot("tree")
    listed = store.snapshots().select(F.lit("listed").alias("part"), F.col("name").alias("id"), F.concat_ws("/", "node_count", "edge_count").alias("other"))
    return back_nodes.select(F.lit("node").alias("part"), "id", F.col("label").alias("other")).unionByName(
        back_edges.select(F.lit("edge").alias("part"), F.col("src").alias("id"), F.col("dst").alias("other"))).unionByName(listed)


@query(W("run_rows") + "SELECT key, count(*) AS n, max(CASE WHEN CAST(string_split(url, '/')[4] AS INTEGER) IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN 1 ELSE 0 END) = 1 AS is_saved FROM run_rows GROUP BY key")
def b24_is_saved(spark, sf):
    marks = table(spark, sf, "nation").where("n_regionkey = 1").select(F.concat(F.lit("https://example.org/"), F.col("n_nationkey").cast("string")).alias("url"))
    return filters.is_saved(I.run_rows(spark, sf), marks).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bool_or("is_saved").alias("is_saved"))
