import json
import random

import numpy as np
import pytest

from graphloom.operators import feed, pieces
from graphloom.sources import documents

NASTY = ['plain', 'a"b', "back\\slash", 'both\\"', "[{,:}]", "ünï", "", "\\", '\\\\"', '","nodes":[{"id":"no"}]', "tab\tnew\nline"]


def graph(rng, n, m):
    name = lambda i: f"{rng.choice(NASTY)}{i}"
    ids = [name(i) for i in range(n)]
    nodes = []
    for i in ids:
        node = {"id": i, "label": rng.choice(NASTY), "size": rng.randint(0, 3), "metadata": {"color": rng.choice(NASTY), "deep": [[1, {"nodes": []}], "]"]}}
        if rng.random() < 0.2:
            del node["id"]
        nodes.append(node)
    edges = [{"source": rng.choice(ids), "target": {"id": rng.choice(ids)} if rng.random() < 0.3 else rng.choice(ids), "label": rng.choice(NASTY)} for _ in range(m)]
    return nodes, edges


def cut(text, rng, longest):
    out = []
    while text:
        n = rng.randint(1, longest)
        out.append(text[:n])
        text = text[n:]
    return list(enumerate(out))


def rows(df):
    return sorted(map(str, df.collect()))


def both(spark, text, some, merge=1):
    one = spark.createDataFrame([(text,)], "document string")
    nodes, edges = pieces.read_pieces(spark.createDataFrame(some, "seq long, text string"), merge)
    want_nodes, want_edges = feed.read_graph_nodes(one), feed.read_graph_edges(one)
    assert rows(nodes.select(want_nodes.columns)) == rows(want_nodes)
    assert rows(edges.select(want_edges.columns)) == rows(want_edges)
    return want_nodes.count(), want_edges.count()


@pytest.mark.parametrize("longest", [1, 3, 40, 10_000])
def test_pieces_of_any_size_equal_one_row(spark, longest):
    rng = random.Random(longest)
    nodes, edges = graph(rng, 12, 14) if longest == 1 else graph(rng, 25, 30)
    text = json.dumps({"name": 'a "graph": {[', "type": "ast", "nodes": nodes, "extra": {"nodes": [1]}, "edges": edges}, ensure_ascii=False, indent=rng.choice([None, 2]))
    assert both(spark, text, cut(text, rng, longest), merge=1 if longest < 100 else pieces.MERGED) == (len(nodes), len(edges))


def test_nodes_by_id_and_many_groups(spark, monkeypatch):
    monkeypatch.setattr(pieces, "GROUP", 7)
    rng = random.Random(5)
    nodes, edges = graph(rng, 12, 9)
    text = json.dumps({"edges": edges, "nodes": {f"{i}{n['label']}": n for i, n in enumerate(nodes)}})
    assert both(spark, text, cut(text, rng, 20)) == (12, 9)
    # Some neighbours merge, some do not.
    assert both(spark, text, cut(text, rng, 9), merge=50) == (12, 9)


def test_documents_without_lists_and_empty_ones(spark):
    for text in ("", "[1, 2]", '{"nodes": [], "edges": 3}', '  {"other": {"nodes": [{"id": "a"}]}}'):
        some = [(0, text)] if text else []
        nodes, edges = pieces.read_pieces(spark.createDataFrame(some, "seq long, text string"))
        assert nodes.count() == edges.count() == 0


@pytest.mark.parametrize("shape", ["gjgf", "node_link", "listing"])
def test_reads_what_is_written(spark, tmp_path, shape):
    nodes = spark.createDataFrame([(f"n{i}", f'label "{i}" [', i % 3) for i in range(200)], "id string, label string, depth int")
    edges = spark.createDataFrame([(f"n{i}", f"n{(i * 7) % 200}", "calls", 0.5) for i in range(150)], "src string, dst string, kind string, weight double")
    documents.write_graph_json(nodes.repartition(5), edges.repartition(3), str(tmp_path / "g"), shape, name='odd "name": {')
    got_nodes, got_edges = documents.read_graph_json(spark, str(tmp_path / "g"))
    assert rows(got_nodes.select("id", "label")) == rows(nodes.select("id", "label"))
    assert rows(got_edges.select("src", "dst")) == rows(edges.select("src", "dst"))


def test_sums_of_pieces_are_the_sum_of_the_text():
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choices(['"é"', '"\\\\"', '"\\""', '"[,"', '"\\\\\\""', "[", "]", "{", "}", ",", "a"], k=rng.randint(0, 15)))
        raw = np.frombuffer(text.encode(), np.uint8)[: rng.randint(0, 40)]
        at = rng.randint(0, len(raw))
        whole = pieces.summed(raw)
        # The text starts outside a string; the other starts of it are not JSON.
        assert pieces.joined(pieces.summed(raw[:at]), pieces.summed(raw[at:]))[pieces.OUT] == whole[pieces.OUT]


def test_a_worker_gives_out_elements_piece_by_piece(spark):
    import pandas as pd

    start = {"state": 0, "depth": 2, "opened2": 1, "commas2": 0, "opened3": 0, "commas3": 0}
    batch = pd.DataFrame([{"seq": i, "text": f"{i},{i}", **start} for i in range(3)])
    assert [len(found) for found in pieces._cut(2, {0: ("nodes", "[")})(iter([batch]))] == [2, 2, 2]
    with pieces._few_at_once(spark):
        most = spark.range(100, numPartitions=1).mapInPandas(lambda bs: (pd.DataFrame({"n": [len(b)]}) for b in bs), "n int").agg({"n": "max"}).first()[0]
    assert most <= pieces.AT_ONCE
