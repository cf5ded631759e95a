"""Ordered event feeds of a graph, their text frames, and folding them back."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ranking import last_wins, ranked
from graphloom.schemas import NODES


def encode_frame(event: Column, payload: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), payload, F.lit("\n\n"))


def encode_events(events: DataFrame) -> DataFrame:
    """(seq, event, payload) -> (seq, frame)."""
    return events.select("seq", encode_frame(F.col("event"), F.col("payload")).alias("frame"))


def decode_events(frames: DataFrame, event: str | None = None) -> DataFrame:
    """(seq, frame) -> (seq, event, payload), of one event only if named; frames without data or with malformed JSON are ignored."""
    rows = F.split(F.trim("frame"), "\n")

    def last_after(prefix: str) -> Column:
        row = F.try_element_at(F.filter(rows, lambda r: r.startswith(prefix)), F.lit(-1))
        return F.trim(F.substring(row, len(prefix) + 1, 1 << 30))

    decoded = frames.select("seq", F.coalesce(last_after("event: "), F.lit("message")).alias("event"),
                            last_after("data: ").alias("payload"))
    return (decoded if event is None else decoded.where(F.col("event") == event)).where(F.try_parse_json("payload").isNotNull())


def event_feed(nodes: DataFrame, edges: DataFrame, layout: str) -> DataFrame:
    """meta, nodes by (depth, id), edges, done, numbered from 1; the counts stand in meta.

    Rows are numbered as columns and written as JSON afterwards, so no text rides through the order.
    """
    out = [F.col("src").alias("source"), F.col("dst").alias("target")]
    out += [F.col(c) for c in edges.columns if c not in ("src", "dst")]
    whole = {"node": F.struct(*nodes.columns), "edge": F.struct(*out)}
    counts = nodes.agg(F.count(F.lit(1)).alias("nodeCount")).withColumn("edgeCount", edges.agg(F.count(F.lit(1))).scalar()).withColumn(
        "layout", F.lit(layout))

    def rows(df: DataFrame, rank: int, event: str, payload: Column, a: Column, b: Column, c: Column) -> DataFrame:
        return df.select(F.lit(rank).alias("rank"), a.alias("a"), b.alias("b"), c.alias("c"), F.lit(event).alias("event"), payload.alias(event))

    none, zero = F.lit(""), F.lit(0)
    edge_key = F.concat_ws("\u0001", "dst", *[c for c in ("kind",) if c in edges.columns])
    parts = [
        rows(counts, 0, "meta", F.struct("nodeCount", "edgeCount", "layout"), zero, none, none),
        rows(nodes, 1, "node", whole["node"], F.coalesce("depth", F.lit(9)), F.col("id"), none),
        rows(edges, 2, "edge", whole["edge"], zero, F.col("src"), edge_key),
        rows(counts, 3, "done", F.lit("{}"), zero, none, none),
    ]
    stacked = functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    payload = F.coalesce("done", *[F.to_json(c) for c in ("meta", "node", "edge")])
    return ranked(stacked, [], ["rank", "a", "b", "c"], rn="seq").select("seq", "event", payload.alias("payload"))


def fold_feed(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (the last frame of an id wins, frames without an id dropped) and edges of a feed."""
    node = decode_events(frames, "node").select("seq", F.from_json("payload", NODES).alias("n")).select("seq", "n.*")
    nodes = last_wins(node.where(F.coalesce("id", F.lit("")) != ""), ["id"], "seq").drop("seq")
    shape = "source string, target string, kind string, weight double"
    edges = decode_events(frames, "edge").select(F.from_json("payload", shape).alias("e")).select(
        F.col("e.source").alias("src"), F.col("e.target").alias("dst"), "e.kind", "e.weight")
    return nodes, edges


# ---- graph documents ----------------------------------------------------------------------

def _first_of(*options: Column) -> Column:
    """First value that is set: neither NULL, '', '0' nor 'false'."""
    return F.coalesce(*[F.when(~o.isin("", "0", "0.0", "false"), o) for o in options])


def _attribute(row: Column, name: str) -> list[Column]:
    return [F.try_variant_get(row, f"$.{name}", "string"), F.try_variant_get(row, f"$.metadata.{name}", "string")]


def read_graph_nodes(documents: DataFrame, column: str = "document", position: str | None = None) -> DataFrame:
    """Nodes of JSON documents: a map by id or an array; top-level attributes before metadata ones.

    A listed node without id is known by its place, which `position` holds if a document is only a part.
    """
    nodes = F.try_variant_get(F.try_parse_json(column), "$.nodes", "variant")
    rest = [c for c in documents.columns if c != column]
    by_id = F.transform(F.map_entries(F.try_variant_get(nodes, "$", "map<string,variant>")), lambda e: F.struct(
        e["key"].alias("id"), e["value"].alias("v")))
    listed = F.transform(F.try_variant_get(nodes, "$", "array<variant>"), lambda v, i: F.struct(
        F.coalesce(F.try_variant_get(v, "$.id", "string"), (F.col(position) if position else i).cast("string")).alias("id"), v.alias("v")))
    rows = documents.select(*rest, F.inline(F.coalesce(by_id, listed)))
    rows = rows.where(F.schema_of_variant("v").startswith("OBJECT"))
    return rows.select(
        *rest, "id", _first_of(*_attribute(F.col("v"), "label"), F.col("id")).alias("label"),
        F.coalesce(_first_of(*_attribute(F.col("v"), "color")), F.lit("#00ff41")).alias("color"),
        F.coalesce(_first_of(*_attribute(F.col("v"), "size")), F.lit("10")).cast("double").alias("size"),
        *[_first_of(*_attribute(F.col("v"), a)).alias(a) for a in ("label_color", "label_size", "border_color", "border_size")])


def read_graph_edges(documents: DataFrame, column: str = "document") -> DataFrame:
    """Edges whose ends are given as ids or as node objects; edges without both ends are dropped."""
    rest = [c for c in documents.columns if c != column]
    listed = F.try_variant_get(F.try_parse_json(column), "$.edges", "array<variant>")
    rows = documents.select(*rest, F.explode(listed).alias("v"))
    rows = rows.where(F.schema_of_variant("v").startswith("OBJECT"))

    def end(name: str) -> Column:
        as_object = F.try_variant_get("v", f"$.{name}", "map<string,variant>").isNotNull()
        return F.when(as_object, F.try_variant_get("v", f"$.{name}.id", "string")).otherwise(F.try_variant_get("v", f"$.{name}", "string"))

    return rows.select(*rest, end("source").alias("src"), end("target").alias("dst"),
                       F.coalesce(_first_of(*_attribute(F.col("v"), "label")), F.lit("")).alias("label"),
                       _first_of(*_attribute(F.col("v"), "color")).alias("color")).where(
        (F.coalesce("src", F.lit("")) != "") & (F.coalesce("dst", F.lit("")) != ""))


def graph_document(nodes: DataFrame, edges: DataFrame, shape: str = "gjgf", name: str = "graph", kind: str = "ast") -> DataFrame:
    """A JSON document as ordered pieces (section, key, text), so no task ever holds it whole.

    Sorted and written as text, the parts in order are the document. Shapes: 'gjgf' (nodes by
    id), 'node_link' (nodes and links), 'listing' (name, type, nodes, edges).
    """
    opening, middle, closing, node_text = {
        "gjgf": (F.lit('{"graph":{"directed":true,"nodes":{'), '},"edges":[', "]}}", F.concat(
            F.expr("substring(to_json(array(id)), 2, length(to_json(array(id))) - 2)"), F.lit(":"),
            F.to_json(F.struct(*[c for c in nodes.columns if c != "id"])))),
        "node_link": (F.lit('{"directed":true,"multigraph":false,"graph":{},"nodes":['), '],"links":[', "]}", F.to_json(F.struct(*nodes.columns))),
        "listing": (F.concat(F.lit('{"name":'), F.expr("substring(to_json(array(n)), 2, length(to_json(array(n))) - 2)"), F.lit(',"type":"'),
                             F.lit(kind), F.lit('","nodes":[')), '],"edges":[', "]}", F.to_json(F.struct(*nodes.columns))),
    }[shape]
    out = [F.col("src").alias("source"), F.col("dst").alias("target"), *[c for c in edges.columns if c not in ("src", "dst")]]
    edge_key = F.concat_ws("\u0001", "src", "dst", *[c for c in ("kind",) if c in edges.columns])

    def body(rows: DataFrame, section: int, key: Column, text: Column) -> DataFrame:
        pieces = rows.select(F.lit(section).alias("section"), key.alias("key"), text.alias("text"))
        first = rows.agg(F.min(key)).scalar()
        return pieces.withColumn("text", F.concat(F.when(F.col("key") == first, "").otherwise(","), F.col("text")))

    frame = nodes.sparkSession.createDataFrame([(0, ""), (2, ""), (4, "")], "section int, key string").withColumn("n", F.lit(name))
    marks = frame.select("section", "key", F.when(F.col("section") == 0, opening).when(
        F.col("section") == 2, middle).otherwise(closing).alias("text"))
    return marks.unionByName(body(nodes, 1, F.col("id"), node_text)).unionByName(
        body(edges, 3, edge_key, F.to_json(F.struct(*out)))).orderBy("section", "key")
