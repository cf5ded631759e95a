import hashlib
import random
import re
import time

import numpy as np

from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import pii

# The contract's patterns as given.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 13 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15)
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def base_of(row):
    return [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in row["base"]]


EDGES = [
    None, "", " ", "a@b.c_d@e.f", "a@b.c.d@e.f", "x@y", "a..b@-.-.x", "1.2.3.4.5.6.7.8", "256.1.1.1 010.0.0.1", "1.2.3.4444444444444444444", "4111 1111 1111 1111", "4111-1111-1111-1111-2",
    "+1 (523) 555-1055", "+12", "++12345678901", "+1(((((2", "é😀 mail a@b.cd ü😀 4111111111111111", "4111111111111112", "1" * 3000, "1 " * 3000, "a" * 3000 + "@b." + "c." * 2000 + "d", "+1" + " " * 3000,
    "%+-._@a.b", "a@b.c@d.e.f", "10.0.0.1.", "0.0.0.0", "+1 800 555 1234 4111111111111111", "9" * 13, "79927398713", "ip 192.168.1.1, card 5500-0000-0000-0004.",
]


def check(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(rows, ("doc_id", "text")).collect():
        assert base_of(r) == brute(r["text"]), r["text"]
        assert all(s in r["all"] for s in r["base"])


def test_edges_match_the_contract(spark):
    check(spark, EDGES)


@given(st.lists(st.text(alphabet="a1.@+ -(_%é2", max_size=40), min_size=30, max_size=60))
@settings(max_examples=6, deadline=None)
def test_random_texts_match_the_contract(spark, texts):
    check(spark, texts)


def test_digest_and_counts(spark):
    text = "write a@b.cd or 10.0.0.1 or +1 (523) 555-1055"
    r = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("*", pii.digest("all").alias("d")).first()
    assert r["d"].split(",") == [f"{k}:{a}:{b}" for k, a, b in brute(text)]
    assert hashlib.sha256(r["d"].encode()).hexdigest()


def test_em_finds_the_reliable_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.4
    votes = np.stack([np.where(rng.random(20000) < acc, truth, ~truth).astype(int) for acc in (0.95, 0.8, 0.8, 0.55, 0.85)], 1)
    votes[rng.random(votes.shape) < 0.3] = pii.ABSTAIN
    pattern, of, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, table = pii.em(np.zeros(len(pattern), int), pattern, n)
    said = table[:, 1, 1] / (table[:, 1, 0] + table[:, 1, 1])
    assert abs(said[0] - 0.95) < 0.03 and abs(said[3] - 0.55) < 0.05
    assert ((post[of.reshape(-1)] > 0.5) == truth).mean() > 0.9


def test_near_misses_are_added_and_numbers_of_other_kinds_are_not(spark):
    good = [(i, f"please call me on my phone 555-0{i:02d}-1234 or mail me at joe{i} (at) shop.com soon") for i in range(60)]
    base = [(100 + i, f"mail joe{i}@shop.com or call +1 (523) 555-1{i:03d} now") for i in range(60)]
    bad = [(200 + i, f"version 1.2.{300 + i}.4 build id={1234567890123456 + i}x") for i in range(60)]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(good + base + bad, "doc_id long, text string")).collect()}
    assert sum(len(got[i]["all"]) for i in range(60)) >= 60
    assert all(len(got[200 + i]["all"]) == len(got[200 + i]["base"]) for i in range(60))


def test_redaction(spark, documents):
    docs = documents([(1, "é mail a@b.cd, card 4111111111111111!"), (2, None), (3, "clean"), (4, "")])
    got = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert got[1]["text"] == "é mail [EMAIL], card [CARD]!" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] is None and got[3]["text"] == "clean" and got[4]["text"] == ""
    assert pii.redact(docs).columns == docs.columns
    assert pii.redact(docs.limit(0)).count() == 0


def test_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a@b.cd", 1, 2, 3), (1, "a@b.cd", 1, 2, 3), (None, "x", 0, 0, 0)], "doc_id long, text string, found int, base int, kind int")
    assert [len(r["base"]) for r in pii.find(df).orderBy(pii.F.desc_nulls_last("doc_id")).collect()] == [1, 1, 0]


def test_tens_of_thousands_of_matches_in_one_text(spark, documents):
    rng = random.Random(21)
    parts = [str(rng.randint(0, 10**6)) for _ in range(60_000)]
    for at, extra in ((100, "bob@example.com"), (30_000, "4111 1111 1111 1111"), (59_999, "10.1.2.3")):
        parts[at] = extra
    text = ", ".join(parts)
    begin = time.monotonic()
    row = pii.find(documents([(1, text)])).first()
    assert time.monotonic() - begin < 60
    base = sorted((s["kind"], s["start"], s["end"]) for s in row["base"])
    want = [(k, text.index(x), text.index(x) + len(x)) for k, x in ((0, "bob@example.com"), (1, "10.1.2.3"), (2, "4111 1111 1111 1111"))]
    assert base == want


def test_blocks_of_matches_join(spark, documents, monkeypatch):
    monkeypatch.setattr(pii, "FOLDED", 3)
    text = " ".join(f"u{i}@example.com é" for i in range(20))
    row = pii.find(documents([(1, text), (2, "a@b.co")])).orderBy("doc_id").first()
    assert [text[s["start"] : s["end"]] for s in row["base"]] == [f"u{i}@example.com" for i in range(20)]
