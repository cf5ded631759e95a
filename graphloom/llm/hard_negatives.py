"""Exact hard negatives by rotated one-bit codes with residual intervals.

Vectors of whole numbers are dealt to shards by the hash of their id. A shard rotates its vectors by
one fixed random rotation and keeps of each the sign bits s, the alignment <y, s> / d of the rotated
vector y with its code, and the length of the residual y - alignment * s, which is orthogonal to s.

For an anchor p, rotated and cut into bit planes, popcounts of code and planes give <p, s>, up to the
known rounding of the planes. The inner product is alignment * <p, s> + <p, residual>, and by
Cauchy-Schwarz the second term is at most |residual| times the length of p's part orthogonal to s.
So every score lies surely in an interval: candidates whose interval cannot meet what is asked for
are left out, the others are scored in whole numbers. Nothing is lost and no score is an estimate.

Two rounds: an anchor's positives over all shards, then the negatives that their scores admit. A
task reads its shard once, builds the codes once, and streams all anchors past them in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import stored

SHARD_ROWS = 25_000  # vectors of a shard, on average
ANCHOR_BLOCK = 128  # anchors compared at once
PLANES = 8  # bits of an anchor's component
EXACT = 2.0**53
_LONG = np.iinfo(np.int64)


def rotation(d: int) -> np.ndarray:
    """The same random rotation of d dimensions everywhere."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(d)).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=-1)
    pad = -packed.shape[-1] % 8
    return np.concatenate([packed, np.zeros((*packed.shape[:-1], pad), np.uint8)], axis=-1).view(np.uint64)


class Codes:
    """One-bit codes of a shard's rotated vectors, with their alignments and residuals."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.d = vectors.shape[1]
        self.turn = rotation(self.d).T
        y = vectors @ self.turn
        self.code = _words(y >= 0)
        self.ones = np.bitwise_count(self.code).sum(axis=1)
        self.align = np.abs(y).sum(axis=1) / self.d
        self.size = np.sqrt((vectors**2).sum(axis=1))
        self.residual = np.sqrt(np.maximum((y**2).sum(axis=1) - self.d * self.align**2, 0)) + 1e-9 * self.size

    def intervals(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible inner product of each anchor (rows) with each vector."""
        p = anchors @ self.turn
        least = p.min(axis=1, keepdims=True)
        step = np.maximum((p.max(axis=1, keepdims=True) - least) / (2**PLANES - 1), 1e-300)
        level = np.clip(np.round((p - least) / step), 0, 2**PLANES - 1)
        cut = least + step * level
        error = np.abs(p - cut).sum(axis=1, keepdims=True)
        weight = np.zeros((len(p), len(self.ids)))
        for k in range(PLANES):
            plane = _words((level.astype(np.int64) >> k) & 1 == 1)
            for w in range(plane.shape[1]):
                weight += np.bitwise_count(plane[:, w : w + 1] & self.code[None, :, w]) * float(1 << k)
        along = 2 * (least * self.ones + step * weight) - cut.sum(axis=1, keepdims=True)
        size = np.sqrt((anchors**2).sum(axis=1, keepdims=True))
        across = np.sqrt(np.maximum(size**2 - np.maximum(np.abs(along) - error, 0) ** 2 / self.d, 0))
        middle, half = self.align * along, self.align * error + self.residual * across + 1e-9 * size * self.size
        return middle - half, middle + half

    def scores(self, anchors: np.ndarray, chosen: np.ndarray) -> list[np.ndarray]:
        """For each anchor the whole-number scores of its chosen vectors."""
        rows = [np.flatnonzero(c) for c in chosen]
        if self.size.max(initial=0) * np.sqrt((anchors**2).sum(axis=1)).max(initial=0) >= EXACT:
            whole = [self.vectors[r].astype(object) @ a.astype(object) for r, a in zip(rows, anchors, strict=True)]
            whole = [[min(max(int(x), _LONG.min), _LONG.max) for x in np.atleast_1d(s)] for s in whole]
            return [np.array(s, np.int64) for s in whole]
        if chosen.mean() > 1 / 8:
            dense = anchors @ self.vectors.T
            return [d[r].astype(np.int64) for d, r in zip(dense, rows, strict=True)]
        return [(self.vectors[r] @ a).astype(np.int64) for r, a in zip(rows, anchors, strict=True)]


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    at = np.arange(len(score))
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def _kth(lower: np.ndarray, k: int) -> float:
    return np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) >= k else -np.inf


def positives(codes: Codes, ids, labels, vectors, k: int):
    """(anchor id, vec_id, score) of each anchor's best vectors of its label, at most k a shard."""
    low, high = codes.intervals(vectors)
    chosen = np.zeros(low.shape, bool)
    for i in range(len(ids)):
        same = (codes.labels == labels[i]) & (codes.ids != ids[i])
        chosen[i] = same & (high[i] >= _kth(low[i, same], k))
    for i, score in enumerate(codes.scores(vectors, chosen)):
        there = codes.ids[chosen[i]]
        for x in _best(score, there, k).tolist():
            yield ids[i], there[x], score[x]


def least_admitted(score: int, percent: int) -> int:
    """The least whole number n with percent * score <= 100 * n."""
    return -(-percent * score // 100)


def negatives(codes: Codes, ids, labels, vectors, wanted, k: int, percent: int):
    """(anchor id, positive's place, vec_id, score) of each positive's best admitted vectors of other labels, at most k a shard.

    `wanted` holds for each anchor the scores of its positives.
    """
    low, high = codes.intervals(vectors)
    chosen = np.zeros(low.shape, bool)
    for i, scores in enumerate(wanted):
        other = (codes.labels != labels[i]) & (codes.ids != ids[i])
        for top in set(scores):
            least = least_admitted(top, percent)
            sure = other & (low[i] >= least) & (high[i] <= top)
            chosen[i] |= other & (low[i] <= top) & (high[i] >= max(least, _kth(low[i, sure], k)))
    for i, score in enumerate(codes.scores(vectors, chosen)):
        there = codes.ids[chosen[i]]
        for place, top in enumerate(wanted[i]):
            fit = np.flatnonzero((score >= least_admitted(top, percent)) & (score <= top))
            for x in fit[_best(score[fit], there[fit], k)].tolist():
                yield ids[i], place, there[x], score[x]


def _pieces(batches):
    """((dim, shard), kind, rows): slices of neighbouring rows that agree in all three."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in ("dim", "shard", "kind")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            dim, shard, kind = keys[:, a].tolist()
            yield (dim, shard), kind, batch.slice(a, b - a)


def _arrays(piece: pa.RecordBatch, dim: int):
    flat = piece.column("vec").flatten().to_numpy().reshape(-1, dim)
    return piece.column("vec_id").to_numpy(), piece.column("label").to_numpy(), flat


def _streamed(compare, names: list[str]):
    """Run `compare(codes, ids, labels, vectors, wanted)` for every block of anchors that follows its shard's vectors."""

    def run(batches):
        now, held, codes = None, [], None
        for key, kind, piece in _pieces(batches):
            if kind == 0:
                if key != now:
                    now, held, codes = key, [], None
                held.append(_arrays(piece, key[0]))
                continue
            if key != now:
                continue  # no vectors of this length in the shard
            if codes is None:
                codes, held = Codes(*[np.concatenate(x) for x in zip(*held, strict=True)]), []
            for at in range(0, piece.num_rows, ANCHOR_BLOCK):
                block = piece.slice(at, ANCHOR_BLOCK)
                out = list(compare(codes, *_arrays(block, key[0]), block.column("wanted").to_pylist()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*out, strict=True)], names=names)

    return run


def whole_vectors(df: DataFrame, scale: int = 256, label: Column | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, label and vec (floor(scale * x) as double); rows with a null in any of them, an empty vector or a non-finite component are left out."""
    kept = df.select(F.col(key).cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.col(vector).alias("_v"))
    kept = kept.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("_v").isNotNull() & (F.size("_v") > 0))
    kept = kept.filter(~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    return kept.select("vec_id", "label", F.transform("_v", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("vec"))


def mine(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, percent: int = 80, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    `vectors` is a vec_id, label, vec table as `whole_vectors` gives it; every row is a candidate. For
    each anchor and each of its best rows of the same label, the best rows of other labels that score
    at least `percent` per cent of the positive and no more than it. Higher scores come first, ties
    go to the smaller vec_id. Rows with the anchor's id are not its candidates; an id that repeats
    among anchors is mined once, with its smallest label and vector; repeated candidate rows count
    once each. Only vectors of one length meet. A positive of negative score admits nothing. Scores
    beyond a long are its ends. An empty table gives no rows.
    """
    shards = max(1, -(-vectors.count() // shard_rows))
    dim, none = F.size("vec").alias("dim"), F.lit(None).cast("array<long>").alias("wanted")
    there = vectors.select(dim, F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.lit(0).alias("kind"), "vec_id", "label", "vec", none)
    anchors = vectors.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("_a")).select("vec_id", "_a.*")
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))

    def met(asked: DataFrame, compare, names: list[str]) -> DataFrame:
        asked = asked.select(F.size("vec").alias("dim"), everywhere.alias("shard"), F.lit(1).alias("kind"), "vec_id", "label", "vec", "wanted")
        dealt = there.union(asked).repartition(shards, "dim", "shard").sortWithinPartitions("dim", "shard", "kind")
        return dealt.mapInArrow(_streamed(compare, names), ", ".join(f"{n} long" for n in names))

    first = met(anchors.withColumn("wanted", none), lambda c, i, la, v, _: positives(c, i, la, v, n_positives), ["anchor_id", "positive_id", "positive_score"])
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    first = first.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= n_positives)
    found = first.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("_place", "positive_id", "positive_score"))).alias("_found"))
    found = stored(found, "positives")  # read by the second round and by the answer
    asked = anchors.join(found, F.col("vec_id") == F.col("anchor_id")).withColumn("wanted", F.col("_found.positive_score"))

    names = ["anchor_id", "_place", "negative_id", "negative_score"]
    second = met(asked, lambda c, i, la, v, w: negatives(c, i, la, v, w, n_negatives, percent), names)
    order = Window.partitionBy("anchor_id", "_place").orderBy(F.desc("negative_score"), "negative_id")
    second = second.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_negatives)
    whole = second.join(found, "anchor_id").withColumn("_p", F.element_at("_found", (F.col("_place") + 1).cast("int")))
    return whole.select("anchor_id", "_p.positive_id", "rank", "negative_id", "_p.positive_score", "negative_score")
