"""Language identification, quality network and the language model."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import language_id, pitman_yor, quality
from graphloom.llm.common import crc_mod

SF = "/root/testdata/sf0.001"


def naive_bits(train: dict[str, list[bytes]], text: bytes, order: int) -> list[float]:
    """Code length under each language, walking the contexts byte by byte."""
    out = []
    for lang in sorted(train):
        after = collections.defaultdict(collections.Counter)
        for t in train[lang]:
            padded = b"\0" * order + t
            for i in range(len(t)):
                for k in range(order + 1):
                    after[padded[i + order - k : i + order]][padded[i + order]] += 1
        total, padded = 0.0, b"\0" * order + text
        for i in range(len(text)):
            sym = padded[i + order]
            for k in range(order, -1, -1):
                seen = after.get(padded[i + order - k : i + order])
                if not seen:
                    continue
                n, q = sum(seen.values()), len(seen)
                if sym in seen:
                    total -= math.log2(seen[sym] / (n + q))
                    break
                total -= math.log2(q / (n + q))
            else:
                total += 8
        out.append(total)
    return out


def test_code_lengths_equal_a_walk_over_the_trees():
    rng = random.Random(1)
    train = {"aa": [bytes(rng.choice(b"abc ") for _ in range(80)) for _ in range(3)], "bb": [bytes(rng.choice(b"bcd.") for _ in range(60)) for _ in range(2)], "cc": [b"x"]}
    model = language_id.Ppm(train)
    texts = [b"abcabc", b"zzz", b"", b"b", bytes(rng.choice(b"abcdx. z") for _ in range(300)), "é".encode()]
    got = model.code_lengths_of(texts)
    for t, bits in zip(texts, got):
        assert np.allclose(bits, naive_bits(train, t, language_id.ORDER), rtol=1e-5)
        assert np.allclose(model.code_lengths(t), bits, rtol=1e-5)


def test_texts_longer_than_a_chunk(monkeypatch):
    model = language_id.Ppm({"a": [b"abababab"], "b": [b"bcbcbc"]})
    text = b"abcb" * 50
    whole = model.code_lengths(text)
    monkeypatch.setattr(language_id, "CHUNK", 7)
    assert np.allclose(model.code_lengths(text), whole) and np.allclose(model.code_lengths_of([text, b"ab"])[0], whole)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs.filter(crc_mod("doc_id", 4) != 2))
    got = language_id.identify(docs.filter(crc_mod("doc_id", 4) == 2), model).join(docs, "doc_id")
    right = got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97


def test_language_edges(spark):
    model = language_id.Ppm({"en": [b"the cat and the dog"], "fr": [b"le chat et le chien"]})
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the the"), (4, "the the"), (5, "ß"), (6, "le " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("_x", F.lit(1))
    got = collections.defaultdict(list)
    for r in language_id.identify(df, model).collect():
        got[r.doc_id].append((r.lang_pred, r.score))
    assert got[1] == got[2] == got[3] == [("und", 0.0)]
    assert [x for x, _ in got[4]] == ["en", "en"] and got[6][0][0] == "fr" and got[5][0][0] in ("en", "fr")
    assert all(0 <= s <= 1 for v in got.values() for _, s in v)
    assert language_id.identify(df.limit(0), model).count() == 0
    untaught = language_id.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language_id.identify(df, untaught).collect()} == {"und"}


def test_pooling_covers_the_whole_text(monkeypatch):
    net = quality.Net.fresh()
    raw = np.random.default_rng(0).integers(0, 256, 5000, dtype=np.uint8)
    windows = np.lib.stride_tricks.sliding_window_view(raw, quality.WIDTH)
    want = (net.embed[windows].reshape(len(windows), -1) @ net.filters + net.bias).max(axis=0)
    for chunk in (100, 997, 4096):
        monkeypatch.setattr(quality, "CHUNK", chunk)
        assert np.allclose(net.pooled(raw)[0], want, atol=1e-5)


def test_network_learns_a_byte_pattern():
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts, labels = [], []
    for i in range(300):
        w = [word() for _ in range(30)]
        if i % 2:
            w[rng.randrange(30)] += "%%%"
        texts.append(" ".join(w).encode())
        labels.append(1 - i % 2)
    net = quality.fit(texts[:200], labels[:200])
    right = [(net.probability(t) >= 0.5) == bool(y) for t, y in zip(texts[200:], labels[200:])]
    assert sum(right) >= 95


def test_quality_of_held_out_documents(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    learnt = crc_mod("doc_id", 3) != 1
    net = quality.train(docs.filter(learnt), labels.filter(learnt))
    got = quality.score(docs.filter(~learnt), net).join(labels, "doc_id")
    right = got.select(F.avg(((F.col("score") >= 0.5) == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right > 0.9


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "x" * 300_000, 0.5), (3, "x", 0.5)], "doc_id long, text string, score double").drop("score")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(3, 1, None), (3, 0, 1), (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    assert all(r.score > 0.9 for r in quality.score(docs, quality.train(docs, one)).collect())
    assert quality.score(docs.limit(0), quality.Net.fresh()).count() == 0


def test_language_model_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(9001, None), (9002, ""), (9003, "A a \t É"), (9003, "A a \t É")], docs.schema))
    rows = pitman_yor.score(docs, crc_mod("doc_id", 7) == 2, block_bytes=100_000).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [(r[0], [*re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(lower)), "\0"]) for r in docs.collect()]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in tokens}
    count = collections.Counter(x for i, w in tokens if not held[i] for x in w)
    n, v = sum(count.values()), len(count)
    want = collections.Counter((i, held[i], len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in tokens)
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert all(r.score < 0 for r in rows)


def test_language_model_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pitman_yor.score(empty, F.lit(False)).count() == 0
    unlearnt = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = pitman_yor.score(unlearnt, F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens) for r in rows} == {(0, 0)} and all(math.isfinite(r.score) for r in rows)


def test_probabilities_of_a_context_add_up():
    rng = np.random.default_rng(4)
    words, contexts = 50, 6
    word, ctx = np.divmod(np.arange(words * contexts), contexts)
    count = rng.poisson(1.2, len(word)) * rng.integers(1, 9, len(word))
    t, upper, upper_tables = pitman_yor.sample(word, ctx, count, words, 1.0, rng)
    v = len(np.unique(word[count > 0]))
    parent = (upper - pitman_yor.PARENT_DISCOUNT * upper_tables + (1 + pitman_yor.PARENT_DISCOUNT * upper_tables.sum()) / (v + 1)) / (1 + upper.sum())
    unknown = (1 + pitman_yor.PARENT_DISCOUNT * upper_tables.sum()) / (v + 1) / (1 + upper.sum())
    assert abs(parent[np.bincount(word, count, words) > 0].sum() + unknown - 1) < 1e-9
    assert (t <= count).all() and ((t > 0) == (count > 0)).all()


def test_a_dish_is_seated_among_the_dishes_of_all_shards(spark):
    with pytest.raises(ValueError):
        pitman_yor.sample(np.zeros(1, int), np.zeros(1, int), np.ones(1, int), 1, 0.5, np.random.default_rng(1))
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"w{i}" for i in range(8000)])
    texts = [" ".join(vocabulary[np.minimum(rng.zipf(1.3, 400) - 1, 7999)]) for _ in range(400)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    one, many = (pitman_yor.score(docs, F.lit(False), size).agg(F.sum("score") / F.sum("n_tokens")).first()[0] for size in (1 << 30, 16_000))
    assert abs(one - many) < 0.0005  # what is left is the luck of the draws


def test_seating_matches_a_run_customer_by_customer():
    rng = np.random.default_rng(9)
    for n, c, base, d, k in ((4000, 30, 0.02, 0.5, 1.0), (3000, 600, 0.05, 0.8, 1.0), (3000, 400, 0.001, 0.9, 2.0)):
        fast, _ = pitman_yor.seat(np.full(n, c), np.full(n, base), np.full(n, 10), d, k, rng)
        slow = np.ones(n, int)
        for i in range(1, c):
            new = (k + d * (10 + slow)) * base
            slow += rng.random(n) < new / (i - d * slow + new)
        assert abs(fast.mean() - slow.mean()) < 0.1 + 0.02 * slow.mean() and abs(fast.std() - slow.std()) < 0.1 + 0.1 * slow.std()
    x = np.array([16.0, 100.0, 1e6])
    assert np.allclose(pitman_yor._lgamma(x), [math.lgamma(y) for y in x], atol=1e-5)
