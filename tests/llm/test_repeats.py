import collections
import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import repeats


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, window):
    seen = collections.Counter(tuple(w[j : j + window]) for _, t in rows for w in [words(t)] for j in range(len(w) - window + 1))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def corpus(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [draw(n) for n in (34, 35, 36, 60, 120)]
    rows = []
    for i in range(60):
        text = draw(rng.randrange(0, 120))
        for p in rng.sample(passages, rng.randrange(3)):
            cut = rng.randrange(0, 8)
            at = rng.randrange(len(text) + 1)
            text[at:at] = p[cut:]
        rows.append((i, " ".join(text)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "a " * 200), (103, None), (104, ""), (105, " ".join(draw(35)) + "\n"), (106, "é " + "b c " * 40)]
    return rows


def test_equals_brute_force(spark, documents):
    rows = corpus()
    assert got(repeats.remove(documents(rows), shard_bytes=3000)) == brute(rows, 35)


def test_digest(spark, documents):
    rows = corpus()
    want = [(i, n, r, hashlib.sha256(k.encode()).hexdigest()) for i, n, r, k in brute(rows, 35)]
    assert got(repeats.remove(documents(rows), digest=True)) == want


@given(st.lists(st.text(alphabet="ab \n", max_size=60), min_size=2, max_size=12), st.integers(3, 6))
@settings(max_examples=5, deadline=None)
def test_small_alphabets(spark, texts, window):
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(repeats.remove(df, window=window, phrase=2, shard_bytes=50)) == brute(rows, window)


def test_repeated_rows_clashing_columns_and_empty_table(spark):
    text = " ".join(f"x{i}" for i in range(40))
    df = spark.createDataFrame([(1, text, 7, 7), (1, text, 7, 7), (2, "short", 7, 7)], "doc_id long, text string, shard int, row int")
    assert got(repeats.remove(df)) == [(1, 40, 40, ""), (1, 40, 40, ""), (2, 1, 0, "short")]
    assert repeats.remove(df.limit(0)).count() == 0
