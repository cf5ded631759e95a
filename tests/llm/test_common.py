import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm.common import bounded_sample, by_group, shingles, word_hashes, words_of
from graphloom.llm.components import components

pd = pytest.importorskip("pandas")


@given(st.text(alphabet="ab \t\n\x0b\x0c\ré\x85", max_size=60))
@settings(max_examples=200, deadline=None)
def test_words_are_runs_without_ascii_white_space(text):
    data = text.encode()
    starts, ends = words_of(data)
    assert [data[a:b].decode() for a, b in zip(starts, ends)] == re.findall(r"[^\x20\x09-\x0D]+", text)


def test_equal_words_have_equal_hashes():
    h = word_hashes(b"one two  one three two")
    assert h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 3
    s = shingles(word_hashes(b"a b c d a b c"), 3)
    assert s[0] == s[4] and len(set(s.tolist())) == 4
    assert len(shingles(h, 6)) == 0 and len(word_hashes(b"")) == 0


def test_groups_stay_whole_over_batches():
    frame = pd.DataFrame({"k": [1] * 5 + [2] * 1 + [3] * 7 + [4], "x": range(14)})
    for size in (1, 2, 3, 5, 14):
        parts = list(by_group((frame.iloc[i : i + size] for i in range(0, 14, size)), ["k"]))
        assert pd.concat(parts)["x"].tolist() == list(range(14))
        seen = [set(p["k"]) for p in parts]
        assert sum(len(s) for s in seen) == 4


def test_sample_is_bounded_for_every_label(spark):
    df = spark.range(5000).selectExpr("id", "CASE WHEN id % 100 = 0 THEN 'rare' WHEN id % 7 = 3 THEN NULL ELSE 'often' END AS l")
    got = {r[0]: r[1] for r in bounded_sample(df, "l", "id", 60).groupBy("l").count().collect()}
    assert got["rare"] == 50 and got["often"] == 60 and None not in got
    assert bounded_sample(df.limit(0), "l", "id", 5).count() == 0


def test_components_of_chains_stars_and_cycles(spark):
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame([(int(a), int(b)) for a, b in edges], "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160))
    assert got[200] == got[201] == got[202] == 200 and 300 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
