"""Prefix trie of rebuilt conversations from sorted, padded matrices of turn ids.

1. Turns are hashed where they are read (128 bits of role and text); only hashes, byte counts and
   positions travel. Rebuilding borrows at most eight turns a conversation.
2. A rebuilt conversation is cut into blocks of BLOCK turns. The node above a block is known by the
   exclusive or of the position-bound turn hashes before it, so a conversation of any length, even
   one with a third of all turns, is many small rows and never one list.
3. Blocks are range-sharded by (node above, turn ids, conversation). A shard is one padded matrix:
   lexsort orders it, neighbouring rows are compared column by column, the change masks are
   OR-accumulated from left to right and mark where nodes start, and reduceat adds up each depth.
   A distinct node's bytes belong to the first row that holds it, so sums over subtrees are sums over rows.
4. Only nodes on the first or last row of a shard, or with a deeper block, can have other parts. Their
   parts are added up by key; neighbouring shards correct what both counted on their shared path,
   and blocks below hand their sums to the nodes above them.
Members that end in a node spread over many shards are hashed from ordered chunks as a stream.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import stored
from graphloom.operators.ranking import ranked
from graphloom.operators.skew import own_shuffle

BLOCK = 16  # turns of a block
SHARD_ROWS = 20_000  # blocks of a shard, on average
CHUNK = 1_000  # conversation ids in a row of an end list
BORROWED = 8  # turns a conversation can take over at most
NOTHING = hashlib.sha256(b"").hexdigest()

CLOSED, OPEN, EDGE, SHARE, ENDS = range(5)
_PART = (
    "kind int, shard int, depth long, hi long, lo long, phi long, plo long, conv long, parent long, n long, children long,"
    " leaves long, suffix long, own long, sha string, block long, side int, more boolean, ids array<long>, bytes array<long>, text string"
)
_DELTA = "kind int, depth long, hi long, lo long, children long, leaves long, own long, conv long, block long"


def rebuild(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 0; -1 once for every conversation), a, b, nb: the turns of every rebuilt conversation.

    a and b are hashes of role and text, nb the bytes of the text.
    """
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    read = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.xxhash64(role, text).alias("a"), F.xxhash64(text, role).alias("b"),
        F.octet_length(text).cast("long").alias("nb"))
    turns = stored(ranked(read, ["conv"], ["turn", "a", "b"]).select("conv", (F.col("rn") - 1).alias("pos"), "a", "b", "nb"), "turns")
    crc = F.crc32(F.col("conv").cast("string").cast("binary"))
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("_n")).select(
        "conv", (F.col("conv") - F.col("conv") % 5).alias("base"), (crc % (BORROWED + 1)).alias("h"))
    first = turns.filter((F.col("conv") % 5 == 0) & (F.col("pos") < BORROWED)).groupBy(F.col("conv").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "a", "b", "nb"))).alias("first"))
    plan = convs.join(first, "base", "left").withColumn("m", F.least("h", F.greatest(F.size("first"), F.lit(0)).cast("long")))
    borrowed = plan.filter("m > 0").select("conv", F.explode(F.expr("slice(first, 1, cast(m as int))")).alias("t")).select("conv", "t.*")
    own = turns.join(own_shuffle(plan.select("conv", "h", "m")), "conv").filter("pos >= h").select("conv", F.expr("pos - h + m").alias("pos"), "a", "b", "nb")
    nothing = plan.select("conv", F.lit(-1).cast("long").alias("pos"), *[F.lit(0).cast("long").alias(x) for x in ("a", "b", "nb")])
    return borrowed.unionByName(own).unionByName(nothing)


def blocks(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv, block, phi and plo (key of the node above), ids (two longs a turn), bytes, tail (bytes below the block), more (blocks follow)."""
    real = F.col("pos") >= 0
    keyed = turns.select(
        "conv", "pos", F.expr(f"greatest(pos, 0) div {block}").alias("block"), F.when(real, F.shiftrightunsigned(F.xxhash64("pos", "a", "b"), 1)).alias("hi"),
        F.when(real, F.xxhash64("b", "a", "pos")).alias("lo"), "nb")
    cut = keyed.groupBy("conv", "block").agg(
        F.array_sort(F.collect_list(F.when(F.col("hi").isNotNull(), F.struct("pos", "hi", "lo", "nb")))).alias("t"),
        F.coalesce(F.bit_xor("hi"), F.lit(0)).alias("xhi"), F.coalesce(F.bit_xor("lo"), F.lit(0)).alias("xlo"), F.sum("nb").alias("_nb"))
    along = Window.partitionBy("conv").orderBy("block")
    before, after = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    return cut.select(
        "conv", "block", F.coalesce(F.bit_xor("xhi").over(before), zero).alias("phi"), F.coalesce(F.bit_xor("xlo").over(before), zero).alias("plo"),
        F.flatten(F.transform("t", lambda x: F.array(x["hi"], x["lo"]))).alias("ids"), F.transform("t", lambda x: x["nb"]).alias("bytes"),
        F.coalesce(F.sum("_nb").over(after), zero).alias("tail"), F.lead("block").over(along).isNotNull().alias("more"))


def _keys(above: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Keys of the nodes along every row: the key above, then each turn's hash taken in."""
    return np.concatenate([above[:, None], above[:, None] ^ np.bitwise_xor.accumulate(ids, axis=1)], axis=1)


class Matrix:
    """The rows of a shard in order, padded to the longest block, with change masks accumulated."""

    def __init__(self, table: pa.Table):
        col = {k: table[k].to_numpy() for k in ("conv", "block", "phi", "plo", "tail", "more")}
        flat = {k: table[k].combine_chunks() for k in ("ids", "bytes")}
        n, length = len(col["conv"]), np.diff(flat["bytes"].offsets.to_numpy())
        width = int(length.max())
        row, at = np.repeat(np.arange(n), length), np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        ids, size = np.zeros((n, width, 2), np.int64), np.zeros((n, width), np.int64)
        ids[:, :, 0] = -1  # before every turn, so that a prefix precedes what goes on from it
        ids[row, at] = flat["ids"].flatten().to_numpy().reshape(-1, 2)
        size[row, at] = flat["bytes"].flatten().to_numpy()
        order = np.lexsort([col["conv"], col["more"], *[ids[:, e, s] for e in range(width - 1, -1, -1) for s in (1, 0)], col["plo"], col["phi"], col["block"]])
        self.n, self.width = n, width
        self.ids, self.size, self.length = ids[order], size[order], length[order]
        for k, v in col.items():
            setattr(self, k, v[order])
        changed = np.ones((n, width + 1), bool)
        changed[1:, 0] = (self.block[1:] != self.block[:-1]) | (self.phi[1:] != self.phi[:-1]) | (self.plo[1:] != self.plo[:-1])
        changed[1:, 1:] = (self.ids[1:] != self.ids[:-1]).any(axis=2)
        self.starts = np.logical_or.accumulate(changed, axis=1)
        shared = np.minimum((~self.starts[:, 1:]).sum(axis=1), self.length)
        with_next = np.append(np.where(self.starts[1:, 0], -1, shared[1:]), -1)
        self.leaf = (~self.more & (with_next < self.length)).astype(np.int64)
        self.sum = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(self.size, axis=1)], axis=1)
        self.total = self.sum[:, -1]
        #: Bytes of the turns that no row before has in the same place.
        self.new = self.total - self.sum[np.arange(n), shared]
        self.hi, self.lo = _keys(self.phi, self.ids[:, :, 0]), _keys(self.plo, self.ids[:, :, 1])

    def depths(self):
        """For every depth of the block: its depth, rows that reach it, and the places among them where nodes start."""
        for e in range(self.width + 1):
            rows = np.flatnonzero(self.length >= e)
            if not len(rows):
                return
            yield e, rows, np.flatnonzero(self.starts[rows, e])


def _joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def _batch(kind: int, schema: pa.Schema, n: int, /, **columns) -> pa.RecordBatch:
    columns["kind"] = np.full(n, kind, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(",")])


def _parts(block: int, chunk: int):
    """Nodes of a shard, its first and last row, what each row adds to the blocks above, and chunks of end lists."""

    def run(batches):
        schema = _schema(_PART)
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        m, shard = Matrix(pa.Table.from_batches(held)), TaskContext.get().partitionId()
        before = None
        for e, rows, at in m.depths():
            first = rows[at]
            total = lambda x: np.add.reduceat(x[rows], at)  # noqa: B023, E731
            above = m.sum[:, max(e - 1, 0)]
            conv, virtual = np.minimum.reduceat(m.conv[rows], at), (m.block[first] > 0) & (e == 0)
            count = np.diff(np.append(at, len(rows)))
            new_below = (m.starts[:, e + 1] & (m.length > e)).astype(np.int64) if e < m.width else np.zeros(m.n, np.int64)
            own = total(m.new) - m.new[first] + m.total[first] - above[first]
            is_open = (total(m.more.astype(np.int64)) > 0) | virtual
            is_open[0] |= rows[0] == 0
            is_open[-1] |= rows[-1] == m.n - 1
            ended = np.add.reduceat(((m.length == e) & ~m.more)[rows].astype(np.int64), at)
            sha = np.full(len(first), NOTHING, object)
            chunks = []
            for x in np.flatnonzero(ended):
                ids = m.conv[rows[at[x] : at[x] + ended[x]]]
                if is_open[x]:
                    chunks += [(x, int(ids[i]), _joined(ids[i : i + chunk])) for i in range(0, len(ids), chunk)]
                else:
                    sha[x] = hashlib.sha256(_joined(ids).encode()).hexdigest()
            key = {"depth": m.block[first] * block + e, "hi": m.hi[first, e], "lo": m.lo[first, e]}
            if before is None:
                up = {"phi": None, "plo": None, "parent": None}
                parent_open = np.zeros(len(first), bool)
            else:
                at_up = np.searchsorted(before["first"], first, "right") - 1
                parent_open = before["open"][at_up]
                up = {"phi": before["hi"][at_up], "plo": before["lo"][at_up], "parent": before["conv"][at_up]}
            real = (~virtual).astype(np.int64)
            values = {**key, "conv": conv, "n": count * real, "children": total(new_below), "leaves": total(m.leaf) * real,
                      "suffix": total(m.total + m.tail - above) * real, "own": own * real, "sha": sha}
            for kind, chosen in ((CLOSED, ~is_open), (OPEN, is_open)):
                x = np.flatnonzero(chosen)
                if not len(x):
                    continue
                cols = {k: v[x] for k, v in values.items()}
                if before is not None:
                    # A closed parent is final here; the key stands for one whose parts are still to be added up.
                    cols |= {k: pa.array(up[k][x], mask=~parent_open[x]) for k in ("phi", "plo")}
                    cols["parent"] = pa.array(up["parent"][x], mask=parent_open[x])
                yield _batch(kind, schema, len(x), shard=np.full(len(x), shard, np.int32), **cols)
            if chunks:
                x = np.array([c[0] for c in chunks])
                yield _batch(ENDS, schema, len(x), **{k: v[x] for k, v in key.items()}, conv=[c[1] for c in chunks], text=[c[2] for c in chunks])
            before = {"first": first, "open": is_open, "hi": key["hi"], "lo": key["lo"], "conv": conv}
        x = np.flatnonzero((m.block > 0) | m.more)
        yield _batch(SHARE, schema, len(x), conv=m.conv[x], block=m.block[x], own=m.new[x], leaves=m.leaf[x])
        ends = [0, m.n - 1]
        lists = {"ids": [m.ids[r, : m.length[r]].ravel() for r in ends], "bytes": [m.size[r, : m.length[r]] for r in ends]}
        yield _batch(EDGE, schema, 2, shard=[shard] * 2, side=[0, 1], conv=m.conv[ends], block=m.block[ends], phi=m.phi[ends], plo=m.plo[ends], more=m.more[ends], **lists)

    return run


def _overlaps(block: int):
    """What a shard's last row and the next shard's first row both counted."""

    def run(batches):
        for pdf in batches:
            out = []
            for left, right in zip(pdf["last"], pdf["first"], strict=True):
                if any(left[k] != right[k] for k in ("block", "phi", "plo")):
                    continue
                ours, theirs = (np.array(x["ids"], np.int64).reshape(-1, 2) for x in (left, right))
                least = min(len(ours), len(theirs))
                same = (ours[:least] == theirs[:least]).all(axis=1)
                depth = least if same.all() else int(np.argmin(same))
                j, twice = left["block"], int(not left["more"] and len(ours) == depth)
                size = np.array(right["bytes"], np.int64)[:depth]
                hi, lo = (_keys(np.array([left[k]], np.int64), ours[None, :depth, s])[0] for k, s in (("phi", 0), ("plo", 1)))
                for e in range(depth + 1):
                    real = int(j == 0 or e > 0)
                    out.append((OPEN, j * block + e, hi[e], lo[e], -int(e < depth), -twice * real, -int(size[max(e - 1, 0) :].sum()) * real, None, None))
                if j > 0 or right["more"]:
                    out.append((SHARE, None, None, None, None, 0, -int(size.sum()), right["conv"], j))
                if j > 0 and twice:
                    out.append((SHARE, None, None, None, None, -1, 0, left["conv"], j))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in _DELTA.split(",")], dtype=object).astype("Int64")

    return run


def _handed_up(block: int):
    """What the blocks below add to each node along a block."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            ids = np.array(pdf["ids"].tolist(), np.int64).reshape(len(pdf), block, 2)
            j = pdf["block"].to_numpy(np.int64)
            depth = j[:, None] * block + np.arange(block + 1)
            there = (j[:, None] == 0) | (np.arange(block + 1) > 0)
            row = np.broadcast_to(np.arange(len(pdf))[:, None], depth.shape)[there]
            hi, lo = (_keys(pdf[k].to_numpy(np.int64), ids[:, :, s])[there] for k, s in (("phi", 0), ("plo", 1)))
            yield pd.DataFrame({"depth": depth[there], "hi": hi, "lo": lo, "leaves": pdf["_leaves"].to_numpy()[row], "own": pdf["_own"].to_numpy()[row]})

    return run


def _next_first(edges: DataFrame) -> DataFrame:
    """last, first: each shard's last row and the first row of the next shard that has rows."""
    row = F.struct("block", "phi", "plo", "more", "conv", "ids", "bytes")
    sides = edges.groupBy("shard").agg(F.max(F.when(F.col("side") == 0, row)).alias("first"), F.max(F.when(F.col("side") == 1, row)).alias("last"))
    sides = sides.withColumn("group", F.expr("shard div 1024"))
    near = sides.withColumn("next", F.lead("first").over(Window.partitionBy("group").orderBy("shard")))
    # One row for 1 024 shards of SHARD_ROWS blocks.
    heads = sides.groupBy("group").agg(F.min(F.struct("shard", "first")).alias("_head")).withColumn("_far", F.lead("_head.first").over(Window.orderBy("group")))
    both = near.join(heads.select("group", "_far"), "group")
    return both.select("last", F.coalesce("next", "_far").alias("first")).filter("first IS NOT NULL")


def _end_hashes(chunks: DataFrame) -> DataFrame:
    """depth, hi, lo, sha: the hash of each node's list, taken chunk by chunk in order."""

    def run(batches):
        now, digest = None, None
        for pdf in batches:
            out = []
            for d, h, lo, text in zip(pdf["depth"], pdf["hi"], pdf["lo"], pdf["text"], strict=True):
                if (d, h, lo) == now:
                    digest.update(b"," + text.encode())
                    continue
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = (d, h, lo), hashlib.sha256(text.encode())
            yield pd.DataFrame(out, columns=["depth", "hi", "lo", "sha"])
        if now is not None:
            yield pd.DataFrame([(*now, digest.hexdigest())], columns=["depth", "hi", "lo", "sha"])

    key = ["depth", "hi", "lo"]
    ordered = chunks.select(*key, "conv", "text").repartition(*key).sortWithinPartitions(*key, "conv")
    return ordered.select(*key, "text").mapInPandas(run, "depth long, hi long, lo long, sha string")


def trie(conversations: DataFrame, block: int = BLOCK, shard_rows: int = SHARD_ROWS, chunk: int = CHUNK) -> DataFrame:
    """One row a node of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null role and text count as empty, null turns come first, turns of one number are ordered by the
    hash of role and text, and repeated rows are turns of their own. Rows without conv_id are left
    out; an empty table has no nodes, not even a root. Other columns are not read. Two different
    turns are taken for one with a chance of 2**-127 a pair.
    """
    key = ["depth", "hi", "lo"]
    cut = stored(blocks(rebuild(conversations), block), "blocks")
    shards = max(1, -(-cut.count() // shard_rows))
    ranged = cut.repartitionByRange(shards, "block", "phi", "plo", "ids", "more", "conv")
    parts = stored(ranged.mapInArrow(_parts(block, chunk), _PART), "parts")
    of = lambda kind: parts.filter(F.col("kind") == kind)

    overlaps = stored(_next_first(of(EDGE)).mapInPandas(_overlaps(block), _DELTA), "overlaps")
    share = of(SHARE).select("conv", "block", "own", "leaves").union(overlaps.filter(F.col("kind") == SHARE).select("conv", "block", "own", "leaves"))
    below = Window.partitionBy("conv").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    share = share.groupBy("conv", "block").agg(F.sum("own").alias("own"), F.sum("leaves").alias("leaves"))
    share = share.select("conv", "block", F.sum("own").over(below).alias("_own"), F.sum("leaves").over(below).alias("_leaves")).filter("_own IS NOT NULL")
    going_on = cut.filter("more").select("conv", "block", "phi", "plo", "ids").join(share, ["conv", "block"])
    handed = going_on.mapInPandas(_handed_up(block), "depth long, hi long, lo long, leaves long, own long")

    some = [*key, "n", "children", "leaves", "suffix", "own", "conv", "phi", "plo", "parent", "shard"]
    deltas = overlaps.filter(F.col("kind") == OPEN).select(*key, "children", "leaves", "own").unionByName(handed, allowMissingColumns=True)
    together = of(OPEN).select(*some).unionByName(deltas, allowMissingColumns=True).groupBy(*key)
    #: A block's own top knows no parent, the same node at the end of the block above does.
    known = F.when(F.coalesce("phi", "parent").isNotNull() | (F.col("depth") == 0), F.col("shard"))
    opened = stored(together.agg(
        *[F.sum(x).alias(x) for x in ("n", "children", "leaves", "suffix", "own")], F.min("conv").alias("conv"),
        F.max("phi").alias("phi"), F.max("plo").alias("plo"), F.min("parent").alias("parent"), F.min(known).alias("shard")), "opened")
    opened = opened.join(_end_hashes(of(ENDS)), key, "left").withColumn("sha", F.coalesce("sha", F.lit(NOTHING)))

    nodes = of(CLOSED).select(*some, "sha").unionByName(opened.select(*some, "sha"))
    # An open parent has one entry a shard that holds a part of it: children meet it by shard, so no entry is hot.
    entries = of(OPEN).select("shard", *key).distinct().join(opened.select(*key, F.col("conv").alias("_parent")), key)
    entries = entries.select("shard", F.col("depth").alias("_depth"), F.col("hi").alias("phi"), F.col("lo").alias("plo"), "_parent")
    hanging = nodes.filter("phi IS NOT NULL").withColumn("_depth", F.col("depth") - 1).join(entries, ["shard", "_depth", "phi", "plo"])
    done = nodes.filter("phi IS NULL").withColumn("_parent", F.col("parent")).unionByName(hanging.drop("_depth").select(*some, "sha", "_parent"))
    return done.select(
        F.col("conv").alias("conv_id"), "depth", F.col("_parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("suffix") - F.col("own")).alias("saved_tokens"), F.col("sha").alias("ends_sha256"))
