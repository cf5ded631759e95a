import random
import re

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import decontaminate as d


def words(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def multiset(w, k):
    out = {}
    for i in range(max(len(w) - k, 0) + 1 if w else 0):
        s = " ".join(w[i : i + k])
        out[s] = out.get(s, 0) + 1
    return out


def brute(docs, items, similarity=0.8):
    """Every window of every document against every item."""
    best = {}
    for i, t in docs:
        w = words(t)
        for j, x in items:
            v = words(x)
            if not v:
                continue
            k = min(5, len(v))
            if len(w) < k:
                continue
            b = multiset(v, k)
            if b.keys().isdisjoint(multiset(w, k)):
                continue  # nothing in common: every window has similarity zero
            for start in range(max(1, len(w) - len(v) + 1)):
                a = multiset(w[start : start + len(v)], k)
                low = sum(min(n, b.get(s, 0)) for s, n in a.items())
                s = low / (sum(a.values()) + sum(b.values()) - low)
                if s >= similarity and s > best.get((i, j), (0,))[0]:
                    best[i, j] = (s, start)
    return {(i, j, round(s, 9), start) for (i, j), (s, start) in best.items()}


def corpus(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(500)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(draw(rng.choice([12, 20, 35, 50])))) for i in range(15)] + [(90, "one two"), (91, ""), (92, None), (93, "x x x x x x x x x x x x"), (94, "one two")]
    docs = []
    for i in range(60):
        w = draw(rng.randrange(0, 150))
        if i % 3 == 0:
            item = words(items[rng.randrange(15)][1])
            for _ in range(rng.randrange(3)):
                item[rng.randrange(len(item))] = rng.choice(vocabulary)
            if i % 2:
                item.insert(rng.randrange(len(item)), "extra")
            at = rng.randrange(len(w) + 1)
            w[at:at] = item
        docs.append((i, " ".join(x.upper() if rng.random() < 0.1 else x + rng.choice(["", "", ",", "."]) for x in w)))
    docs += [(100, None), (101, ""), (102, "say one, TWO!"), (103, "x " * 30), (104, " ".join(words(items[0][1])[:-1])), (105, items[1][1] + " " + items[2][1])]
    return docs, items


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def got(df):
    return {(r.doc_id, r.item_id, round(r.similarity, 9), r.start_word) for r in df.collect()}


def test_hits_equal_brute_force(spark):
    docs, items = corpus()
    want = brute(docs, items)
    assert len(want) > 10
    assert got(d.hits(*tables(spark, docs, items))) == want


def test_joins_without_broadcast(spark, monkeypatch):
    docs, items = corpus()
    monkeypatch.setattr(d, "BROADCAST_ROWS", 0)
    assert got(d.hits(*tables(spark, docs, items))) == brute(docs, items)


def test_clean_documents_stay_with_all_columns(spark):
    docs, items = corpus()
    df, marks = tables(spark, docs, items)
    df = df.withColumn("n", F.lit(1)).withColumn("item_id", F.lit("clash")).withColumn("w", F.lit(2))
    kept = d.clean(df, marks)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, *_ in brute(docs, items)}


def test_empty_tables_and_repeated_rows(spark):
    docs, items = tables(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")], [(7, "a b c d e f"), (7, "a b c d e f")])
    assert sorted(((r.doc_id or 0), r.item_id) for r in d.hits(docs, items).collect()) == [(0, 7), (1, 7)]
    assert d.hits(docs.limit(0), items).count() == 0 and d.hits(docs, items.limit(0)).count() == 0
    assert d.clean(docs, items).count() == 0 and d.clean(docs, items.limit(0)).count() == 3


def test_blocks_miss_no_fingerprint_within_the_radius(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        a = int(rng.integers(-(2**63), 2**63 - 1))
        flips = rng.choice(64, size=int(rng.integers(0, d.RADIUS + 1)), replace=False)
        b = a
        for f in flips:
            b ^= 1 << int(f) if f < 63 else -(1 << 63)
        rows.append((i, a, b))
    df = spark.createDataFrame(rows, "i long, a long, b long")
    left = df.select("i", F.explode(d._block_values(F.col("a"), d.BLOCK_RADIUS)).alias("x"))
    right = df.select("i", F.explode(d._block_values(F.col("b"), 0)).alias("x"))
    assert left.join(right, ["i", "x"]).select("i").distinct().count() == 300
