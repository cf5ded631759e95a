"""Removal of repeated word windows by repeated-phrase automata.

A window is WINDOW consecutive words; every word of a window that starts anywhere else too goes.

1. Anchors: of the phrases (PHRASE words) inside a window the one with the least hash is its anchor,
   so equal windows have equal anchors, while only about one phrase in fourteen is one. Anchors are
   counted; those met once drop out, with all windows they anchor.
2. Recurring passages are confirmed: windows with a recurring anchor are hashed whole (64 bits) and
   counted over all documents; those met twice are the recurring ones.
3. Documents are dealt to shards of about SHARD_BYTES. Each shard compiles an Aho-Corasick automaton
   of the recurring phrases its documents hold, every word being a few small characters, and streams
   all its documents through it; around each phrase found the windows are looked up among the confirmed.
Counts are added up before any shuffle, so a passage in a third of all documents is one row a shard.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import BASES, BYTE_CODE, release, runs, shingles, stored, words_of

WINDOW = 35  # words
PHRASE = 8  # words of a phrase
LETTERS = 3  # characters a word is written with for the automata
SHARD_BYTES = 8_000_000
PACKED = 1_000_000  # window hashes a task packs at once


def _sliding(x: np.ndarray, width: int, reduce) -> np.ndarray:
    """reduce over every `width` consecutive values, by doubling."""
    have, step = x, 1
    while step * 2 <= width:
        have, step = reduce(have[:-step], have[step:]), step * 2
    n = len(x) - width + 1
    return reduce(have[:n], have[width - step : width - step + n])


class Words:
    """A text's words as hashes, and the hashes of its phrases and windows."""

    def __init__(self, text: str | None, window: int, phrase: int):
        self.data = text.encode() if isinstance(text, str) else b""
        self.starts, self.ends = words_of(self.data)
        self.window, self.phrase, self.n = window, phrase, len(self.starts)
        self.hashes = runs(BYTE_CODE[np.frombuffer(self.data, np.uint8)], self.starts, self.ends, BASES[0]) if self.n else np.zeros(0, np.uint64)

    def windows(self) -> np.ndarray:
        return shingles(self.hashes, self.window, BASES[2]).astype(np.int64)

    def phrases(self) -> np.ndarray:
        return shingles(self.hashes, self.phrase)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All phrase hashes, whether each is an anchor, and the anchor's hash of every window."""
        grams, span = self.phrases(), self.window - self.phrase + 1
        if len(grams) < span:
            return grams, np.zeros(len(grams), bool), np.zeros(0, np.uint64)
        least = _sliding(grams, span, np.minimum)
        edge = np.zeros(span - 1, np.uint64)
        return grams, _sliding(np.concatenate([edge, least, edge]), span, np.maximum) == grams, least

    def characters(self) -> str:
        """LETTERS characters for each word, 7 bits of its hash each.

        The first has a range of its own, so a phrase is only found where a word starts. An automaton
        looks through a node's children one by one; no node has more than 128 of them.
        """
        parts = [(self.hashes >> np.uint64(64 - 7 * (i + 1))) & np.uint64(127) for i in range(LETTERS)]
        parts[0] = parts[0] + np.uint64(128)
        return (np.stack(parts, axis=1) + np.uint64(1)).astype("<u2").tobytes().decode("utf-16-le")


def _counted(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often each occurs, two standing for more."""
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    distinct, n = np.unique(flat, return_counts=True)
    return distinct, np.minimum(n, 2).astype(np.int32)


def _anchors(window: int, phrase: int):
    def run(batches):
        for pdf in batches:
            for shard, part in pdf.groupby("shard"):
                found = []
                for t in part["text"]:
                    grams, chosen, _ = Words(t, window, phrase).anchors()
                    found.append(grams[chosen].astype(np.int64))
                h, n = _counted(found)
                yield pd.DataFrame({"shard": np.full(len(h), shard, np.int32), "h": h, "n": n})

    return run


def _candidates(window: int, phrase: int):
    """Rows of windows with a recurring anchor (phrase null), and of the recurring phrases themselves (n 0)."""

    def run(key, docs, anchors):
        recurring = np.sort(anchors["h"].to_numpy(np.int64).astype(np.uint64))
        found, phrases = [], {}
        if len(recurring):
            for t in docs["text"]:
                words = Words(t, window, phrase)
                grams, chosen, least = words.anchors()
                hit = _in(least, recurring)
                if hit.any():
                    found.append(words.windows()[hit])
                    at = np.flatnonzero(chosen & _in(grams, recurring))
                    letters = words.characters()
                    for i, h in zip(at.tolist(), grams[at].tolist(), strict=True):
                        if h not in phrases:
                            phrases[h] = letters[LETTERS * i : LETTERS * (i + phrase)]
        w, n = _counted(found)
        texts = sorted(set(phrases.values()))
        return pd.DataFrame({
            "shard": np.full(len(w) + len(texts), key[0], np.int32), "w": np.concatenate([w, np.zeros(len(texts), np.int64)]),
            "n": np.concatenate([n, np.zeros(len(texts), np.int32)]), "phrase": pd.Series([None] * len(w) + texts, dtype=object),
        })

    return run


def _in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def covered(words: Words, automaton, confirmed: np.ndarray) -> np.ndarray:
    """Which words lie in a confirmed window; the automaton says where to look."""
    out = np.zeros(words.n, bool)
    if automaton is None or words.n < words.window:
        return out
    ends = np.fromiter((end for end, _ in automaton.iter(words.characters())), np.int64) // LETTERS
    if not len(ends):
        return out
    first, last = ends - words.window + 1, ends - words.phrase + 1
    near = np.zeros(words.n + 1, np.int64)
    np.add.at(near, np.maximum(first, 0), 1)
    np.add.at(near, np.minimum(last + 1, words.n), -1)
    starts = np.flatnonzero(np.cumsum(near[: words.n - words.window + 1]) > 0)
    starts = starts[_in(words.windows()[starts], confirmed)]
    edge = np.zeros(words.n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + words.window, -1)
    return np.cumsum(edge[:-1]) > 0


def _packed(batches):
    """Window hashes of a task as one array a shard, PACKED rows at a time: few rows to hand on."""

    def pack(held):
        shards, values = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("shard", "w"))
        order = np.argsort(shards, kind="stable")
        own, at = np.unique(shards[order], return_index=True)
        arrays = pa.ListArray.from_arrays(pa.array(np.append(at, len(order)).astype(np.int32)), pa.array(values[order]))
        return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), arrays, pa.nulls(len(own), pa.string())], names=["shard", "ws", "phrase"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= PACKED:
            yield pack(held)
            held, rows = [], 0
    if rows:
        yield pack(held)


def _removed(window: int, phrase: int):
    def run(key, docs, told):
        import ahocorasick

        texts = told["phrase"].dropna()
        automaton = None
        if len(texts):
            automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for x in texts:
                automaton.add_word(x)
            automaton.make_automaton()
        confirmed = np.sort(np.concatenate([np.zeros(0, np.int64), *told.loc[told["phrase"].isna(), "ws"]]))
        rows = []
        for row, t in zip(docs["row"], docs["text"], strict=True):
            words = Words(t, window, phrase)
            gone = covered(words, automaton, confirmed)
            if gone.any():
                kept = b" ".join(words.data[a:b] for a, b in zip(words.starts[~gone].tolist(), words.ends[~gone].tolist(), strict=True))
            else:
                kept = b" ".join(words.data.split())
            rows.append((row, words.n, int(gone.sum()), kept.decode()))
        return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept"])

    return run


def _digested(window: int, phrase: int):
    whole = _removed(window, phrase)

    def run(key, docs, told):
        out = whole(key, docs, told)
        out["kept_sha256"] = [hashlib.sha256(x.encode()).hexdigest() for x in out.pop("kept")]
        return out

    return run


def remove(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, shard_bytes: int = SHARD_BYTES, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of every document row.

    With `digest`, kept_sha256 takes the place of kept. Null texts have no words; texts of fewer words
    than a window keep them all. Rows that repeat an id are documents of their own, so a repeated
    text of `window` words loses them all; other columns are not carried. Windows are judged on the
    input. Two different windows are taken for one with a chance of 2**-64 a pair.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(1, -(-size // shard_bytes))
    own = docs.select(F.col("doc_id").alias("row"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_shards)).cast("int").alias("shard"))
    anchors = stored(own.select("shard", "text").mapInPandas(_anchors(window, phrase), "shard int, h long, n int"), "anchors")
    recurring = anchors.groupBy("h").agg(F.sum("n").alias("_n")).filter("_n > 1").select(F.col("h").alias("_h"))
    there = stored(anchors.join(recurring, F.col("h") == F.col("_h"), "left_semi").select("shard", "h").distinct(), "recurring")
    release(spark, anchors)
    by_shard = own.groupBy("shard")
    found = by_shard.cogroup(there.groupBy("shard")).applyInPandas(_candidates(window, phrase), "shard int, w long, n int, phrase string")
    found = stored(found, "windows")
    release(spark, there)
    windows = found.filter("phrase IS NULL").select("shard", "w", "n")
    twice = windows.groupBy("w").agg(F.sum("n").alias("_n")).filter("_n > 1").select(F.col("w").alias("_w"))
    confirmed = windows.join(twice, F.col("w") == F.col("_w"), "left_semi").select("shard", "w").mapInArrow(_packed, "shard int, ws array<long>, phrase string")
    phrases = found.filter("phrase IS NOT NULL").select("shard", F.lit(None).cast("array<long>").alias("ws"), "phrase")
    told = stored(confirmed.union(phrases), "confirmed")
    release(spark, found)
    last, tail = (_digested, "kept_sha256 string") if digest else (_removed, "kept string")
    return own.groupBy("shard").cogroup(told.groupBy("shard")).applyInPandas(last(window, phrase), f"doc_id {kind}, n_words long, n_removed long, {tail}")
