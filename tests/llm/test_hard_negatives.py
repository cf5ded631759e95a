import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, is_anchor, k=5, percent=80):
    """All pairs in whole numbers."""
    fit = [(i, la, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, la in rows
           if i is not None and la is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, la, v in fit:
        if is_anchor(i):
            anchors[i] = min(anchors.get(i, (la, v)), (la, v))
    out = []
    for a, (la, v) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, lb) for i, lb, w in fit if i != a and len(w) == len(v)]
        for ps, p, _ in sorted(s for s in scored if s[2] == la)[:k]:
            admitted = sorted(s for s in scored if s[2] != la and percent * -ps <= 100 * -s[0] <= 100 * -ps)[:k]
            out += [(a, p, r + 1, n, -ps, -ns) for r, (ns, n, _) in enumerate(admitted)]
    return sorted(out)


def vectors(seed, n, d, labels):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(labels, d))
    return [(i, [float(x) for x in (0.4 * centre[i % labels] + rng.normal(size=d)).astype(np.float32)], i % labels) for i in range(n)]


def found(spark, rows, schema=SCHEMA, every=10, **sizes):
    whole = hard_negatives.whole_vectors(spark.createDataFrame(rows, schema))
    df = hard_negatives.mine(whole, F.col("vec_id") % every == 0, **sizes)
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("d", [3, 64, 70])
def test_many_shards_equal_brute_force(spark, d):
    rows = vectors(d, 300, d, 4)
    want = brute(rows, lambda i: i % 10 == 0)
    assert want
    assert found(spark, rows, shard_rows=60) == want


def test_ties_repeated_rows_and_equal_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(0, 2, 4)], int(rng.integers(0, 3))) for i in range(120)]
    rows += rows[:15] + [(20, [1.0, 0.0, 1.0, 1.0], 2)]
    assert found(spark, rows, shard_rows=40) == brute(rows, lambda i: i % 10 == 0)


def test_nulls_odd_lengths_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(3, 60, 5, 3) + [(100, None, 1), (110, [], 1), (120, [1.0, None, 0.0, 0.0, 0.0], 1), (130, [nan] * 5, 0), (140, [inf] * 5, 0), (150, [1.0] * 5, None), (None, [1.0] * 5, 0)]
    rows += [(200 + i, [1.0 + i / 64, 0.5], i % 2) for i in range(15)]
    wide = [(*r, "x", 1, 2) for r in rows]
    assert found(spark, wide, SCHEMA + ", vec string, shard int, dim int", shard_rows=20) == brute(rows, lambda i: i % 10 == 0)


def test_empty_table_and_anchors_without_partners(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0, 2.0], 0), (1, [1.0, 2.0], 1)]) == []
    assert found(spark, [(0, [1.0, 0.0], 0), (1, [-1.0, 0.0], 0), (2, [-1.0, 0.0], 1)]) == []


def test_huge_components_do_not_fail(spark):
    rows = [(i, [3.0e38 if i % 2 else -3.0e38, float(i)], i % 2) for i in range(30)]
    assert all(r[4] >= r[5] for r in found(spark, rows))


def test_intervals_hold_every_score_and_spare_candidates():
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(size=(4000, 64)))
    near = np.floor(x[:40] + 20 * rng.normal(size=(40, 64)))
    codes = hard_negatives.Codes(np.arange(4000), np.zeros(4000, int), x)
    low, high = codes.intervals(near)
    score = near @ x.T
    assert (low <= score).all() and (score <= high).all()
    spared = high < score[np.arange(40), np.arange(40)][:, None] * 0.9
    assert spared.mean() > 0.8


def test_zero_vectors():
    codes = hard_negatives.Codes(np.arange(3), np.zeros(3, int), np.array([[0.0, 0.0], [1.0, 2.0], [-3.0, 1.0]]))
    low, high = codes.intervals(np.array([[0.0, 0.0], [5.0, -1.0]]))
    score = np.array([[0, 0, 0], [0, 3, -16]])
    assert (low <= score).all() and (score <= high).all()
    assert hard_negatives.least_admitted(101, 80) == 81 and hard_negatives.least_admitted(-100, 80) == -80
