"""Secrets in texts: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Base spans come from three patterns. The models add spans of kind `random`: runs of key characters,
LONG or more of them, that random strings explain better than ordinary identifiers do, by at least
MARGIN bits of log-likelihood.

Labelled samples train the models. `ordinary`: the distinct identifiers of a sample of texts, outside
their base spans, whose parts between + / _ . = - are shorter than LONG or all digits (others may be
secrets without a label); sequences of three characters are counted (order 2, absolute discounting,
so what one string alone shows counts for little). `random`: for every alphabet generated strings
and the distinct secret values that the base patterns labelled in the sample; one chain of order 1
an alphabet, the likeliest counts.
Transition counts are added up in Spark; a model is at most as large as its alphabet to the third.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
SAMPLE_TEXTS = 20_000  # texts that labelled strings are taken from, on average
GENERATED = 2_000  # random strings generated for each alphabet
LONG = 16  # characters of a run that the models judge
SHORT = 4  # characters of an ordinary identifier to learn from
MARGIN = 24.0  # bits by which random must be likelier
BACKOFF = 4.0  # weight of single symbols behind pairs
DISCOUNT = 0.9  # taken off each count of three symbols for the shorter context

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = DIGITS + LOWER + UPPER + "+/_.=-"
#: Alphabets of random strings, each by itself before those that hold it.
ALPHABETS = (DIGITS + "abcdef", DIGITS + "ABCDEF", DIGITS + LOWER, DIGITS + UPPER, DIGITS + LOWER + UPPER, DIGITS + LOWER + UPPER + "+/_=-")

ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_HINTS = (b"passw", b"secret", b"token", b"key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")

_START = len(SYMBOLS)
_CODE = np.full(256, -1, np.int16)
_CODE[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(len(SYMBOLS))
_HEX = np.zeros(256, bool)
_HEX[np.frombuffer(ALPHABETS[0].encode(), np.uint8)] = True


def _runs(inside: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Start and end of every run of at least `least` true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def base_spans(data: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) in bytes, by start, then kind."""
    out = []
    lower = data.lower()
    if any(h in lower for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end(), m.start(1)) for m in ASSIGN.finditer(data) if m.end(1) - m.start(1) >= 8]
    if b"AKIA" in data:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(data)]
    out += [(a, 2, b, a) for a, b in _runs(_HEX[np.frombuffer(data, np.uint8)], 32)]
    return sorted(out)


def identifiers(data: bytes, least: int, taken: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Runs of key characters, without dots and dashes around them, that touch no letter of another script and no span of `taken`."""
    raw = np.frombuffer(data, np.uint8)
    out = []
    for a, b in _runs(_CODE[raw] >= 0, least):
        if (a and data[a - 1] >= 128) or (b < len(data) and data[b] >= 128):
            continue
        run = data[a:b]
        a, b = a + len(run) - len(run.lstrip(b".-_")), b - (len(run) - len(run.rstrip(b".-_")))
        if b - a >= least and not any(s < b and a < e for s, _, e, _ in taken):
            out.append((a, b))
    return out


def _texts(column) -> list[bytes]:
    """The column's texts as bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_PARTS = re.compile(rb"[+/_.=-]+")


def _known_kind(word: bytes) -> bool:
    return len(word) < LONG or all(len(p) < LONG or p.isdigit() for p in _PARTS.split(word))


def _labelled(batches):
    for batch in batches:
        ordinary, secret = set(), set()
        for data in _texts(batch.column("text")):
            base = base_spans(data)
            ordinary.update(w for w in (data[a:b] for a, b in identifiers(data, SHORT, base)) if _known_kind(w))
            secret.update(data[v:e] for _, _, e, v in base)
        words = sorted(ordinary) + sorted(secret)
        labels = [0] * len(ordinary) + [1] * len(secret)
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array([w.decode() for w in words], pa.string())], names=["label", "word"])


def _coded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every character of all words: the two before it (the start symbol before the first) and itself."""
    flat = np.frombuffer((b"\0\0" + b"\0\0".join(words)) if words else b"", np.uint8)
    code = np.where(flat == 0, _START, _CODE[flat]).astype(np.int64)
    at = np.flatnonzero(code != _START)
    return code[at - 2], code[at - 1], code[at]


def alphabet_of(word: str) -> int:
    """The first alphabet that holds the word, the last if none does."""
    return next((i for i, a in enumerate(ALPHABETS) if not set(word) - set(a)), len(ALPHABETS) - 1)


def _transitions(batches):
    """Counts of (model, two before, before, symbol); model 0 is ordinary, 1 + i the i-th alphabet."""
    size = _START + 1
    for batch in batches:
        words = {}
        for label, word in zip(batch.column("label").to_pylist(), batch.column("word").to_pylist(), strict=True):
            words.setdefault(0 if label == 0 else 1 + alphabet_of(word), []).append(word.encode())
        for model, some in words.items():
            a, b, c = _coded(some)
            code, n = np.unique((a * size + b) * size + c, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), model, np.int32)), pa.array(code), pa.array(n.astype(np.int64))], names=["model", "code", "n"])


@dataclass(frozen=True)
class Model:
    """Bits (log2 probabilities) of a symbol after its context."""

    ordinary: np.ndarray  # two before, before, symbol
    random: np.ndarray  # alphabet, before, symbol

    def margins(self, words: list[bytes]) -> np.ndarray:
        """Bits by which the best chain of random strings explains each word better than the ordinary model."""
        if not words:
            return np.zeros(0)
        a, b, c = _coded(words)
        first = np.cumsum([0] + [len(w) for w in words[:-1]])
        random = np.stack([np.add.reduceat(chain[b, c], first) for chain in self.random]).max(axis=0)
        return random - np.add.reduceat(self.ordinary[a, b, c], first)


def _generated() -> list[list[bytes]]:
    rng = np.random.Generator(np.random.PCG64(12))
    return [["".join(rng.choice(list(a), rng.integers(LONG, 65))).encode() for _ in range(GENERATED)] for a in ALPHABETS]


def fit(counts: list[tuple[int, int, int]]) -> Model:
    """The model of counted transitions (model, code, n), with the generated strings counted in."""
    size = _START + 1
    n = np.zeros((1 + len(ALPHABETS), size, size, size))
    for model, code, times in counts:
        n[model].reshape(-1)[code] += times
    for i, words in enumerate(_generated()):
        np.add.at(n[1 + i], _coded(words), 1)
    n = n[..., :_START]
    single = n[0].sum(axis=(0, 1)) + 1
    single = single / single.sum()
    pair = n[0].sum(axis=0)
    pair = (pair + BACKOFF * single) / (pair.sum(axis=1, keepdims=True) + BACKOFF)
    seen, taken = n[0].sum(axis=2, keepdims=True), DISCOUNT * (n[0] > 0).sum(axis=2, keepdims=True)
    triple = np.where(seen > 0, (np.maximum(n[0] - DISCOUNT, 0) + taken * pair) / np.maximum(seen, 1), pair)
    chains = n[1:].sum(axis=1) + 0.01
    return Model(np.log2(triple).astype(np.float32), np.log2(chains / chains.sum(axis=2, keepdims=True)).astype(np.float32))


def train(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> Model:
    """The models from the labelled strings of about `sample_texts` whole texts, chosen by the hash of doc_id.

    Every distinct string counts once, so a string in a third of all texts teaches no more than
    another. An empty table leaves the ordinary model even and the random one as generated.
    """
    n = docs.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("secrets")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = docs.select("doc_id", "text").filter(draw < min(1.0, sample_texts / max(n, 1))).select("text")
    words = some.mapInArrow(_labelled, "label int, word string").distinct()
    counts = words.mapInArrow(_transitions, "model int, code long, n long").groupBy("model", "code").agg(F.sum("n").alias("n"))
    return fit([tuple(r) for r in counts.collect()])


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())])


def _scan(model: Model):
    def run(batches):
        for batch in batches:
            every, words, where = [], [], []
            texts = _texts(batch.column("text"))
            for i, data in enumerate(texts):
                base = base_spans(data)
                every.append([(a, k, b, None) for a, k, b, _ in base])
                for a, b in identifiers(data, LONG, base):
                    words.append(data[a:b])
                    where.append((i, a, b))
            for (i, a, b), bits in zip(where, model.margins(words).tolist(), strict=True):
                if bits >= MARGIN:
                    every[i].append((a, 3, b, bits))
            spans = []
            for data, found in zip(texts, every, strict=True):
                if found:
                    point = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
                spans.append([{"kind": KINDS[k], "start": int(point[a]), "end": int(point[b]), "bits": x} for a, k, b, x in sorted(found, key=lambda s: s[:2])])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "spans"])

    return run


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, end exclusive, bits of margin for `random`) of every row, by start, then kind.

    Whole texts are read; a null or empty text has no spans; repeated rows and null ids give rows of
    their own; an empty table gives none; other columns are not read. Spans of patterns may overlap
    each other, added ones overlap none. Patterns and models know ASCII letters only, and a run that
    touches a letter of another script is part of a word.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan(model), f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,bits:double>>")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
