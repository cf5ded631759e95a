"""Language identification by prediction by partial matching (PPM).

Every language has a tree of byte contexts up to `order` bytes. In a context seen n times with q
different following bytes, a byte seen c times costs -log2(c / (n + q)) bits and the escape to the
next shorter context -log2(q / (n + q)) (escape method C); below order 0 every byte costs 8 bits.
The statistics are frozen after training, so the bits of a gram are constants: they are worked out
once for every gram that any language knows, and a text is scored by table look-ups in numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_sample

ORDER = 4
PER_LANGUAGE = 400  # sampled training texts of a language
LONGEST = 65_536  # characters; longer texts are not sampled for training
CHUNK = 1 << 20  # bytes scored at a time

_PRIME = np.uint64(0x9E3779B97F4A7C15)


class HashTable:
    """Keys to consecutive row numbers by open addressing, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(10, int(np.ceil(np.log2(3 * len(keys) + 1))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        at, left = self.home(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] == -1
            spot, first = np.unique(at[free], return_index=True)
            put = left[free][first]
            self.keys[spot], self.rows[spot] = keys[put], put
            rest = ~np.isin(left, put)
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _PRIME) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 for unknown keys."""
        at = self.home(keys)
        out, there = self.rows[at], self.keys[at]
        left = np.flatnonzero((there != keys) & (there != -1))
        out[(there != keys)] = -1
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.rows[at[hit]]
            go = ~hit & (there != -1)
            left, at = left[go], at[go]
        return out


def _grams(raw: np.ndarray, length: int) -> np.ndarray:
    """Keys of the `length` bytes that end at each byte; `raw` starts with ORDER padding bytes."""
    keys = np.zeros(len(raw) - ORDER, np.int64)
    for back in range(length - 1, -1, -1):
        keys = (keys << 8) | raw[ORDER - back : len(raw) - back]
    return keys


class Ppm:
    """Frozen context trees of all languages as one table of bits for each order."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.languages = sorted(texts)
        n_lang = len(self.languages)
        padded = [[np.frombuffer(b"\0" * ORDER + t, np.uint8).astype(np.int64) for t in texts[x] if t] for x in self.languages]
        below_keys, below_bits = None, None
        self.tables, self.bits, self.escape_tables, self.escapes = [], [], [], []
        for order in range(ORDER + 1):
            counted = [np.unique(np.concatenate([_grams(r, order + 1) for r in rows] or [np.zeros(0, np.int64)]), return_counts=True) for rows in padded]
            keys = np.unique(np.concatenate([k for k, _ in counted] or [np.zeros(0, np.int64)]))
            contexts, of = np.unique(keys >> 8, return_inverse=True)
            bits = np.full((len(keys), n_lang), 8.0) if below_keys is None else below_bits[np.searchsorted(below_keys, keys & ((1 << 8 * order) - 1))]
            escapes = np.zeros((len(contexts), n_lang))
            for i, (mine, count) in enumerate(counted):
                at = np.searchsorted(keys, mine)
                total, kinds = np.bincount(of[at], count, len(contexts)), np.bincount(of[at], minlength=len(contexts))
                seen = total > 0
                escapes[seen, i] = -np.log2(kinds[seen] / (total + kinds)[seen])
                bits[:, i] += escapes[of, i]
                bits[at, i] = -np.log2(count / (total + kinds)[of[at]])
            self.tables.append(HashTable(keys))
            self.bits.append(bits.astype(np.float32))
            self.escape_tables.append(HashTable(contexts))
            self.escapes.append(escapes.astype(np.float32))
            below_keys, below_bits = keys, bits

    def code_lengths(self, text: bytes) -> np.ndarray:
        """Bits of the text under each language."""
        total = np.zeros(len(self.languages))
        for start in range(0, len(text), CHUNK):
            before = text[max(0, start - ORDER) : start]
            raw = np.frombuffer(b"\0" * (ORDER - len(before)) + before + text[start : start + CHUNK], np.uint8).astype(np.int64)
            total += self._bits(raw).sum(axis=0, dtype=np.float64)
        return total

    def _bits(self, raw: np.ndarray) -> np.ndarray:
        out = np.zeros((len(raw) - ORDER, len(self.languages)), np.float32)
        keys, left = _grams(raw, ORDER + 1), None
        for order in range(ORDER, -1, -1):
            known = self.tables[order].find(keys)
            if left is None:
                hit = known >= 0
                out[hit] = self.bits[order][known[hit]]
                left = np.flatnonzero(~hit)
            else:
                hit = known >= 0
                out[left[hit]] += self.bits[order][known[hit]]
                left = left[~hit]
            if not len(left):
                return out
            keys = keys[~hit]
            context = self.escape_tables[order].find(keys >> 8)
            seen = context >= 0
            out[left[seen]] += self.escapes[order][context[seen]]
            keys = keys & ((1 << 8 * order) - 1)
        out[left] += 8.0
        return out

    def code_lengths_of(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language; short texts are scored together."""
        out = np.zeros((len(texts), len(self.languages)))
        batch, size = [], 0
        for i, t in enumerate(texts):
            if len(t) >= CHUNK:
                out[i] = self.code_lengths(t)
            elif t:
                batch.append(i)
                size += len(t)
            if batch and (size >= CHUNK or i == len(texts) - 1):
                raw = np.frombuffer(b"".join(b"\0" * ORDER + texts[j] for j in batch), np.uint8).astype(np.int64)
                bits = self._bits(raw)
                ends = np.cumsum([len(texts[j]) + ORDER for j in batch])
                starts = np.concatenate([[0], ends[:-1]])
                edges = np.empty(2 * len(batch) - 1, np.int64)  # text, padding of the next, text ...
                edges[0::2], edges[1::2] = starts, ends[:-1] - ORDER
                out[batch] = np.add.reduceat(bits, edges, axis=0, dtype=np.float64)[0::2]
                batch, size = [], 0
        return out


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, longest: int = LONGEST) -> Ppm:
    """Context trees from a bounded sample: at most `per_language` whole texts of at most `longest` characters a language."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= longest) & (F.length("text") > 0))
    texts: dict[str, list[bytes]] = {}
    for r in bounded_sample(known.select("doc_id", "lang", "text"), "lang", "doc_id", per_language).select("lang", "text").toLocalIterator():
        texts.setdefault(r[0], []).append(r[1].encode())
    return Ppm(texts)


def identify(docs: DataFrame, model: Ppm, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` with lang_pred, score (posterior of that language, even priors) and bits_per_byte.

    A null text, one without a letter, and any text if nothing was learnt give `und`, score 0 and
    null bits. Equal code lengths go to the first language in alphabetical order. One row for each
    input row; other columns are not carried.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = docs.select(*keep, F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("_text"))
    fields = [*kept.drop("_text").schema.fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string", "score double", "bits_per_byte double"])

    def score(batches):
        ppm = shared.value
        names = np.array([*ppm.languages, "und"], object)
        for pdf in batches:
            texts = [t.encode() if isinstance(t, str) else b"" for t in pdf.pop("_text")]
            size = np.array([len(t) for t in texts], float)
            told = (size > 0) & bool(ppm.languages)
            pick, prob, per_byte = np.full(len(texts), len(ppm.languages)), np.zeros(len(texts)), np.full(len(texts), np.nan)
            if told.any():
                bits = ppm.code_lengths_of(texts)[told]
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(best)), best]
                pick[told], per_byte[told] = best, least / size[told]
                prob[told] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
            yield pdf.assign(lang_pred=names[pick], score=prob, bits_per_byte=pd.Series(per_byte, pdf.index).astype("Float64"))

    return kept.mapInPandas(score, schema)
