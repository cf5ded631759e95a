import random
import re

import numpy as np
import pytest

from graphloom.llm import near_copies


def shingle_texts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    k = min(5, len(w))
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, similarity=0.8):
    sets = [shingle_texts(t) for _, t in rows]
    n, root = len(rows), list(range(len(rows)))
    links = [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if shared >= similarity * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
                    links[a] += 1
                    links[b] += 1
                    ra, rb = find(a), find(b)
                    root[max(ra, rb)] = min(ra, rb)
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], least[find(i)] if sets[i] else rows[i][0], links[i]) for i in range(n))


def corpus(seed=5, base=12, copies=14, words=90):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, doc = [], 0
    passage = [rng.choice(vocabulary) for _ in range(40)]
    for b in range(base):
        text = [rng.choice(vocabulary) for _ in range(words + 30 * (b % 3))] + (passage if b % 2 else [])
        rows.append((doc, " ".join(text)))
        doc += 1
        for _ in range(copies):
            near = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            rows.append((doc, " ".join(near)))
            doc += 1
    rng.shuffle(rows)
    return rows


def got(df):
    return sorted((r.doc_id, r.class_id, r.n_links) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    extra = [(900, None), (901, ""), (902, "  \n"), (903, "one two"), (904, "One  two"), (905, "one two three"), (906, "word " * 3000), (907, "word " * 2999)]
    return corpus() + extra


def test_links_and_classes_equal_brute_force(spark, documents, rows):
    assert got(near_copies.join(documents(rows))) == brute(rows)


def test_groups_are_cut_into_blocks_without_loss(spark, documents, rows, monkeypatch):
    monkeypatch.setattr(near_copies, "CHUNK", 4)
    monkeypatch.setattr(near_copies, "CHUNK_SHINGLES", 500)
    assert got(near_copies.join(documents(rows))) == brute(rows)


def test_one_document_of_each_class_stays(spark, documents, rows):
    docs = documents(rows)
    kept = near_copies.one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in brute(rows)}) and kept.columns == docs.columns


def test_repeated_rows_and_clashing_columns(spark):
    text = " ".join(f"x{i}" for i in range(50))
    df = spark.createDataFrame([(1, text, b"a", 1), (1, text, b"a", 1), (2, text, b"a", 1), (3, "other words are here now", b"a", 1)], "doc_id long, text string, cid binary, pair int")
    assert got(near_copies.join(df)) == [(1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 3, 0)]


def test_repeated_rows_with_a_near_partner(spark):
    words = [f"x{i}" for i in range(60)]
    text, near = " ".join(words), " ".join([*words[:-1], "other"])
    lone, same = " ".join(f"y{i}" for i in range(50)), " ".join([*words[1:], "more"])
    rows = [(1, text), (1, text), (2, near), (2, lone), (2, lone), (7, None), (None, same), (None, same)]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, pair int")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    out = sorted(((r.doc_id, r.class_id, r.n_links) for r in near_copies.join(df).collect()), key=key)
    assert out == [(None, 1, 4), (None, 1, 4), (1, 1, 4), (1, 1, 4), (2, 1, 4), (2, 2, 1), (2, 2, 1), (7, 7, 0)]
    first = [(1, text), (1, text), (2, near)]
    assert got(near_copies.join(spark.createDataFrame(first, "doc_id long, text string"))) == [(1, 1, 2), (1, 1, 2), (2, 1, 2)]
    kept = near_copies.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((i or 0, t or "") for i, t in rows if t != near)


def test_near_copies_without_ids(spark):
    words = [f"x{i}" for i in range(60)]
    rows = [(None, " ".join(words)), (None, " ".join([*words[:-1], "other"])), (None, "alone here")]
    assert sorted(r.n_links for r in near_copies.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [0, 1, 1]


def test_empty_table(spark, documents):
    assert near_copies.join(documents([])).count() == 0


def test_prefix_length_reaches_the_recall():
    for recall in (0.9, 0.99, 0.9999):
        d = near_copies.prefix_length(0.8, recall)
        assert 1 - (1 - 0.8**d) ** near_copies.TREES >= recall
        assert d == near_copies.DEPTH or 1 - (1 - 0.8 ** (d + 1)) ** near_copies.TREES < recall


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[:320], rng.integers(0, 2**63, 80, dtype=np.uint64)])
    same = (near_copies.signature(np.unique(a)) == near_copies.signature(np.unique(b))).mean()
    assert abs(same - 320 / 480) < 0.15
