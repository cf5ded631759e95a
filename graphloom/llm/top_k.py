"""Exact top-k inner-product search with ball trees, branch and bound.

Vectors are dealt to shards by the hash of their row. Each shard's ball tree is built once and stored
as arrays: a node holds the ball around a range of vectors, inner nodes have two children, leaves at
most LEAF vectors. The queries of a block descend together, best-first: of all open nodes the one
with the greatest upper bound <q, centre> + |q| * radius is next, for those queries whose bound
reaches their kth score, so no query opens a branch that cannot hold a better vector for it.
The kth score is shared in two rounds: a probe of the most promising leaf of every shard gives each
query a first kth score over all shards, which is the starting threshold everywhere in the second.
Scores are sums of products of whole numbers, so they are exact in double precision.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import stored

LEAF = 256
SHARD_ROWS = 25_000  # vectors a shard, on average
SHARD_BYTES = 16 << 20  # of vectors a shard, on average
QUERY_BLOCK = 1_000  # queries that descend together

_ARRAYS = {"ids": np.int64, "vectors": np.float64, "low": np.int64, "high": np.int64, "child": np.int64, "centres": np.float64, "radii": np.float64}


class BallTree:
    """Nodes over ranges of the members: rows are split at the median of the widest of two pivots' directions."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.arange(len(ids))
        low, high, child, centres, radii = [], [], [], [], []
        stack = [(0, len(ids), -1, 0)] if len(ids) else []
        while stack:
            a, b, parent, side = stack.pop()
            node = len(low)
            if parent >= 0:
                child[parent][side] = node
            part = vectors[order[a:b]]
            centre = part.mean(axis=0)
            low.append(a)
            high.append(b)
            child.append([-1, -1])
            centres.append(centre)
            radii.append(np.sqrt(((part - centre) ** 2).sum(axis=1).max()))
            if b - a > LEAF:
                far = part[((part - part[0]) ** 2).sum(axis=1).argmax()]
                other = part[((part - far) ** 2).sum(axis=1).argmax()]
                order[a:b] = order[a:b][np.argsort(part @ (other - far), kind="stable")]
                half = a + (b - a) // 2
                stack += [(half, b, node, 1), (a, half, node, 0)]
        width = vectors.shape[1] if vectors.ndim == 2 else 0
        self._hold(ids[order], vectors[order], np.array(low, np.int64), np.array(high, np.int64), np.array(child, np.int64).reshape(-1, 2),
                   np.array(centres, np.float64).reshape(len(low), width), np.array(radii, np.float64))

    def _hold(self, ids, vectors, low, high, child, centres, radii) -> None:
        self.member_ids, self.members, self.low, self.high, self.child, self.centres, self.radii = ids, vectors, low, high, child, centres, radii
        #: What rounding may take from a bound, for a query of length 1.
        self.slack = 1e-9 * (np.sqrt((centres**2).sum(axis=1)) + radii)

    def arrays(self) -> dict[str, bytes]:
        held = (self.member_ids, self.members, self.low, self.high, self.child, self.centres, self.radii)
        return {name: np.ascontiguousarray(x, kind).tobytes() for (name, kind), x in zip(_ARRAYS.items(), held, strict=True)}

    @classmethod
    def of(cls, arrays: dict[str, bytes], width: int) -> BallTree:
        tree = cls.__new__(cls)
        flat = {name: np.frombuffer(arrays[name], kind) for name, kind in _ARRAYS.items()}
        tree._hold(flat["ids"], flat["vectors"].reshape(-1, width), flat["low"], flat["high"], flat["child"].reshape(-1, 2), flat["centres"].reshape(-1, width), flat["radii"])
        return tree

    @property
    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.child[:, 0] < 0)

    @property
    def ids(self) -> list[np.ndarray]:
        """The ids of every leaf."""
        return [self.member_ids[self.low[x] : self.high[x]] for x in self.leaves]

    @property
    def vectors(self) -> list[np.ndarray]:
        return [self.members[self.low[x] : self.high[x]] for x in self.leaves]

    def bounds(self, queries: np.ndarray, nodes: np.ndarray | None = None) -> np.ndarray:
        """Upper bound of the inner products of each query (rows) with each node's members (by default the leaves'), rounded up."""
        nodes = self.leaves if nodes is None else nodes
        size = np.sqrt((queries**2).sum(axis=-1))[..., None]
        return queries @ self.centres[nodes].T + size * (self.radii[nodes] + self.slack[nodes]) + 1e-9

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, kth: np.ndarray, probe: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids), one row a query, of its k best members other than itself that reach its kth score; ties go to the smaller id.

        Queries descend together: a node is opened, in falling order of the greatest bound, for those of
        its queries whose bound still reaches their kth score. A probe follows each query's best child
        to one leaf. Places without a member score minus infinity.
        """
        scores, ids = np.full((len(queries), k), -np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
        if not len(self.low) or not len(queries):
            return scores, ids
        kth, least = kth.copy(), self.bounds(queries, np.array([0]))[:, 0]
        heap = [(-least.max(), 0, np.arange(len(queries)), least)]
        while heap:
            _, node, who, bound = heapq.heappop(heap)
            who = who[bound >= kth[who]]
            if not len(who):
                continue
            if self.child[node, 0] >= 0:
                bounds = self.bounds(queries[who], self.child[node])
                for side, x in enumerate(self.child[node].tolist()):
                    open_ = bounds[:, side] >= kth[who]
                    if probe:
                        open_ &= bounds.argmax(axis=1) == side
                    if open_.any():
                        heapq.heappush(heap, (-bounds[open_, side].max(), x, who[open_], bounds[open_, side]))
                continue
            here = slice(self.low[node], self.high[node])
            there = self.member_ids[here]
            score = queries[who] @ self.members[here].T
            score[(there[None, :] == query_ids[who][:, None]) | (score < kth[who][:, None])] = -np.inf
            hit = np.isfinite(score).any(axis=1)
            who, score = who[hit], score[hit]
            both = np.concatenate([scores[who], score], axis=1)
            names = np.concatenate([ids[who], np.broadcast_to(there, score.shape)], axis=1)
            best = np.lexsort((names, -both), axis=1)[:, :k]
            scores[who], ids[who] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
            kth[who] = np.maximum(kth[who], scores[who, -1])
        return scores, ids


def whole_vectors(df: DataFrame, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and vec, floor(scale * x) as double; vectors that are null or empty or hold null or non-finite components are left out."""
    kept = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("_v")).filter(F.col("vec_id").isNotNull() & F.col("_v").isNotNull() & (F.size("_v") > 0))
    kept = kept.filter(~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    return kept.select("vec_id", F.transform("_v", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("vec"))


def _pieces(batches):
    """((dim, shard), rows): slices of neighbouring rows of one shard."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "shard")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield (int(keys[0, a]), int(keys[1, a])), batch.slice(a, b - a)


def _vectors(piece: pa.RecordBatch, dim: int) -> np.ndarray:
    return piece.column("vec").flatten().to_numpy().reshape(-1, dim)


def _built(batches):
    """A row for every shard: its tree as arrays."""

    def row(key, held):
        tree = BallTree(np.concatenate([p.column("vec_id").to_numpy() for p in held]), np.concatenate([_vectors(p, key[0]) for p in held]))
        columns = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), *[pa.array([x], pa.binary()) for x in tree.arrays().values()]]
        return pa.RecordBatch.from_arrays(columns, names=["dim", "shard", *_ARRAYS])

    now, held = None, []
    for key, piece in _pieces(batches):
        if key != now and held:
            yield row(now, held)
            held = []
        now = key
        held.append(piece)
    if held:
        yield row(now, held)


def _searched(k: int, probe: bool, block: int):
    """Answers of the queries that follow their shard's tree."""

    def run(batches):
        now, tree = None, None
        for key, piece in _pieces(batches):
            kinds = piece.column("kind").to_numpy()
            if kinds[0] == 0:
                now, tree = key, BallTree.of({name: piece.column(name)[0].as_py() for name in _ARRAYS}, key[0])
            asked = piece.slice(int((kinds == 0).sum()))
            if key != now or not asked.num_rows:
                continue  # no vectors of this length in the shard
            for at in range(0, asked.num_rows, block):
                part = asked.slice(at, block)
                own = part.column("vec_id").to_numpy()
                scores, ids = tree.search(own, _vectors(part, key[0]), k, part.column("kth").to_numpy(), probe)
                row, place = np.nonzero(np.isfinite(scores))
                found = (own[row], ids[row, place], scores[row, place].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    return run


def search(queries: DataFrame, candidates: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best candidates other than itself, ties to the smaller vec_id.

    Both inputs are vec_id, vec tables as `whole_vectors` gives them. Only vectors of the same length
    meet. Candidate rows that repeat an id count once each; a repeated query id is searched once, with
    its smallest vector. Every query meets every shard, which is what an exact search over all rows
    has to do; a task holds one shard's tree and streams the queries past it.
    """
    size = candidates.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("vec") * 8).alias("bytes")).first()
    n_shards = max(1, -(-size["n"] // shard_rows), -(-(size["bytes"] or 0) // SHARD_BYTES))
    dim, shard = F.size("vec").alias("dim"), F.pmod(F.xxhash64("vec_id", "vec"), F.lit(n_shards)).alias("shard")
    dealt = candidates.select(dim, shard, "vec_id", "vec").repartition(n_shards, "dim", "shard").sortWithinPartitions("dim", "shard")
    trees = stored(dealt.mapInArrow(_built, "dim int, shard long, " + ", ".join(f"{name} binary" for name in _ARRAYS)), "trees").withColumn("kind", F.lit(0))
    q = queries.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long")))

    def searched(kth: DataFrame | None, probe: bool) -> DataFrame:
        known = q.withColumn("kth", F.lit(float("-inf"))) if kth is None else q.join(kth, "vec_id", "left").fillna(float("-inf"), ["kth"])
        asked = known.select(F.size("vec").alias("dim"), every.alias("shard"), F.lit(1).alias("kind"), "vec_id", "vec", "kth")
        met = trees.unionByName(asked, allowMissingColumns=True).repartition(n_shards, "dim", "shard").sortWithinPartitions("dim", "shard", "kind")
        return met.mapInArrow(_searched(k, probe, query_block), "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    probe = searched(None, True).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k)
    first = probe.select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("kth"))
    ranked = searched(first, False).withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
