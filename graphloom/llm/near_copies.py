"""N-gram Jaccard join with MinHash LSH at one fixed prefix depth.

1. Every text gets the set of its five-word shingles (lower-case words between white space), a
   128-bit hash of the set and TREES x DEPTH MinHash values. Texts of one set form one class.
2. Two classes are candidates when they share the prefix of a tree's values, met by its hash. The
   length is the same everywhere: the longest, up to DEPTH, at which the chance that two sets at the
   threshold share one in some tree reaches the target recall.
3. In each shared prefix the signatures part what merely collides: classes whose estimate reaches
   ESTIMATE (over four standard deviations below the threshold) are linked to a leader, so a group
   gives one row a member and not all pairs. Groups of more than CHUNK members are cut into blocks
   and every pair of blocks is a task of its own.
4. The components of these links are verified exactly: intersections of all pairs in a component
   come from products of incidence matrices, again by pairs of blocks, and give the number of links
   of every class and the classes they connect.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from graphloom.llm.common import bounded, by_group, mix, shingles, stored, word_hashes
from graphloom.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
TREES, DEPTH = 24, 6
RECALL = 0.9999
ESTIMATE = 0.62
CHUNK = 1_000  # members of a block
CHUNK_SHINGLES = 2_000_000  # shingles of a block

_rng = np.random.Generator(np.random.PCG64(11))
_MULTIPLY = _rng.integers(1, 2**63, (TREES * DEPTH, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, (TREES * DEPTH, 1), dtype=np.uint64)


def prefix_length(similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """The longest prefix at which sets of that similarity share one in some tree with the target recall."""
    for d in range(DEPTH, 1, -1):
        if 1 - (1 - similarity**d) ** TREES >= recall:
            return d
    return 1


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words has one shingle, an empty one none."""
    words = word_hashes(text.lower().encode())
    return np.unique(shingles(words, min(SHINGLE, len(words)))) if len(words) else np.zeros(0, np.uint64)


def set_key(s: np.ndarray) -> bytes:
    """128-bit hash of a shingle set."""
    return np.array([mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64).tobytes()


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits each)."""
    least = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint64)
    for lo in range(0, len(s), 1024):
        np.minimum(least, ((s[lo : lo + 1024] * _MULTIPLY + _ADD) >> np.uint64(32)).min(axis=1), out=least)
    return least.astype(np.uint32)


def _signed(batches):
    for pdf in batches:
        sets = [shingle_set(t) if isinstance(t, str) else np.zeros(0, np.uint64) for t in pdf["text"]]
        signs = [signature(s) if len(s) else None for s in sets]
        yield pd.DataFrame({
            "doc_id": pdf["doc_id"], "cid": [set_key(s) if len(s) else None for s in sets], "n": [len(s) for s in sets],
            "prefixes": [None if x is None else x.tobytes() for x in signs], "sig": [None if x is None else mix(x.astype(np.uint64)).astype(np.uint8).tobytes() for x in signs],
        })


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from signatures cut to a byte, without the share of equal bytes by chance."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def _spanning(ids: np.ndarray, signs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list, list]:
    """Edges that connect, within each group of rows, everything linked by estimates."""
    left, right = [], []
    size = ends - starts
    small = size <= 8
    of = np.repeat(np.arange(len(size)), size)
    for shift in range(1, 8):
        at = np.flatnonzero(small[of[shift:]] & (of[shift:] == of[:-shift]))
        if not len(at):
            break
        hit = at[estimate(signs[at], signs[at + shift]) >= ESTIMATE]
        left.append(ids[hit])
        right.append(ids[hit + shift])
    for g in np.flatnonzero(~small):
        rest = np.arange(starts[g], ends[g])
        queue: list[int] = []
        while len(rest):
            if not queue:
                queue, rest = [int(rest[0])], rest[1:]
            head = queue.pop()
            near = estimate(signs[rest], signs[head]) >= ESTIMATE
            if near.any():
                left.append(np.full(int(near.sum()), ids[head], object))
                right.append(ids[rest[near]])
                queue += rest[near].tolist()
                rest = rest[~near]
    return left, right


def _edges(batches):
    for pdf in by_group(batches, ["key", "pair"]):
        group = pdf["key"].to_numpy() * np.int64(31) + pdf["pair"].to_numpy()
        cuts = np.flatnonzero((pdf["key"].to_numpy()[1:] != pdf["key"].to_numpy()[:-1]) | (pdf["pair"].to_numpy()[1:] != pdf["pair"].to_numpy()[:-1])) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(group)]])
        signs = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), -1)
        left, right = _spanning(pdf["cid"].to_numpy(object), signs, starts, ends)
        if left:
            yield pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)}).drop_duplicates()


def _block_pairs(members: DataFrame, blocks, cid: str = "cid") -> DataFrame:
    """Every member for each pair of blocks its own block is in: `block`, `pair` (the pair's number)."""
    own = members.withColumn("_blocks", blocks).withColumn("block", F.pmod(F.xxhash64(cid, F.lit("block")), F.col("_blocks")))
    other = own.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    low, high = F.least("block", "_other"), F.greatest("block", "_other")
    return other.withColumn("pair", low * F.col("_blocks") + high).withColumn("alone", F.col("block") == F.col("_other")).drop("_blocks", "_other")


def _blocks_of(n, size: int):
    return F.ceil(n / size).cast("long")


def links_within(sets: list[np.ndarray], block: np.ndarray, alone: bool, copies: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of every set (partners with their copies) and the first row of its component.

    With `alone` all pairs of the rows count, else only pairs from different blocks.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat, row = np.concatenate(sets), np.repeat(np.arange(m), size)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    common = np.zeros((m, m), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 2048
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((m, min(width, int(column[-1]) + 1 - lo)), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        common += part @ part.T
    near = common >= similarity * (size[:, None] + size[None, :] - common) - 1e-9
    np.fill_diagonal(near, False)
    if not alone:
        near &= block[:, None] != block[None, :]
    root = np.arange(m)
    while True:
        low = np.where(near, root[None, :], m).min(axis=1, initial=m)
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return near @ copies.astype(np.float64), root


def _verified(similarity: float):
    def run(batches):
        for pdf in by_group(batches, ["comp", "pair"]):
            out = []
            for _, g in pdf.groupby(["comp", "pair"], sort=False):
                sets = [np.frombuffer(x, np.uint64) for x in g["shingles"]]
                links, root = links_within(sets, g["block"].to_numpy(), bool(g["alone"].iloc[0]), g["copies"].to_numpy(), similarity)
                ids = g["cid"].to_numpy(object)
                out.append(pd.DataFrame({"cid": ids, "root": ids[root], "links": links.astype(np.int64), "one": (g["n_blocks"] == 1).to_numpy()}))
            if out:
                yield pd.concat(out)

    return run


def _with_sets(batches):
    for pdf in batches:
        sets = [shingle_set(t) if isinstance(t, str) else np.zeros(0, np.uint64) for t in pdf.pop("text")]
        keys = [set_key(s) if len(s) else b"" for s in sets]
        keep = np.array([k == bytes(c) for k, c in zip(keys, pdf["cid"], strict=True)], bool)
        pdf["shingles"] = [s.tobytes() for s in sets]
        yield pdf[keep]


def _sets_of(batches):
    """Key and set of every text that has one."""
    for pdf in batches:
        sets = [s for s in (shingle_set(t) for t in pdf["text"] if isinstance(t, str)) if len(s)]
        yield pd.DataFrame({"cid": [set_key(s) for s in sets], "shingles": [s.tobytes() for s in sets]})


@F.pandas_udf(BinaryType())
def _cid_of(texts: pd.Series) -> pd.Series:
    sets = (shingle_set(t) if isinstance(t, str) else np.zeros(0, np.uint64) for t in texts)
    return pd.Series([set_key(s) if len(s) else None for s in sets], dtype=object)


def join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, set_id, n_links of every document row.

    A link joins two rows whose shingle sets have a Jaccard similarity of `similarity` or more; n_links
    counts a row's links, copies included. class_id is the smallest doc_id connected to the row by
    links, set_id the smallest doc_id with the same shingle set. Null and wordless texts have no
    links and are classes of their own. Rows that repeat an id are documents of their own; other
    columns are not carried.
    """
    return _joined(docs, similarity, recall).drop("cid")


def _joined(docs: DataFrame, similarity: float, recall: float) -> DataFrame:
    """What `join` gives, with the key of the row's shingle set as `cid`."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = stored(docs.select("doc_id", "text").mapInPandas(_signed, f"doc_id {kind}, cid binary, n int, prefixes binary, sig binary"), "signed")
    classes = signed.filter(F.col("cid").isNotNull()).groupBy("cid").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("prefixes").alias("prefixes"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    classes = stored(classes, "classes")
    d = prefix_length(similarity, recall)
    trees = F.explode(F.array(*[F.xxhash64(F.lit(t), F.expr(f"substring(prefixes, {t * DEPTH * 4 + 1}, {d * 4})")) for t in range(TREES)]))
    forest = classes.select("cid", trees.alias("key"))
    shared = stored(forest.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "shared")
    members = classes.select("cid", "sig", trees.alias("key")).join(bounded(shared, shared.count()), "key")
    paired = _block_pairs(members, _blocks_of(F.col("m"), CHUNK)).select("key", "pair", "cid", "sig")
    edges = paired.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInPandas(_edges, "a binary, b binary")
    found = components(edges)
    # exact verification inside the components
    about = classes.select("cid", "rep", "copies", "n").join(found.select(F.col("node").alias("cid"), F.col("root").alias("comp")), "cid")
    about = stored(about, "about")
    sizes = about.groupBy("comp").agg(F.greatest(_blocks_of(F.count(F.lit(1)), CHUNK), _blocks_of(F.sum("n"), CHUNK_SHINGLES)).alias("n_blocks"))
    sizes = stored(sizes, "sizes")
    placed = about.join(bounded(sizes, sizes.count()), "comp")
    placed = stored(placed, "placed")
    # texts are found by id, one row a class; where an id repeats or is null, by set
    repeated = stored(signed.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select(F.col("doc_id").alias("_twice")), "repeated")
    n_repeated = repeated.count()
    single = placed
    if n_repeated:
        single = placed.join(bounded(repeated, n_repeated), F.col("rep") == F.col("_twice"), "left_anti")
    rows = docs.select("doc_id", "text").join(bounded(single, placed.count()), F.col("doc_id") == F.col("rep")).select("cid", "comp", "copies", "n_blocks", "text")
    sets = rows.mapInPandas(_with_sets, "cid binary, comp binary, copies long, n_blocks long, shingles binary")
    if n_repeated or not placed.filter(F.col("rep").isNull()).isEmpty():
        own = docs.select("doc_id", "text")
        again = own.join(bounded(repeated, n_repeated), F.col("doc_id") == F.col("_twice"), "left_semi").union(own.filter(F.col("doc_id").isNull()))
        several = placed.join(bounded(repeated, n_repeated), F.col("rep") == F.col("_twice"), "left_semi").union(placed.filter(F.col("rep").isNull()))
        found = again.select("text").mapInPandas(_sets_of, "cid binary, shingles binary").dropDuplicates(["cid"])
        sets = sets.union(found.join(several, "cid").select("cid", "comp", "copies", "n_blocks", "shingles"))
    sets = _block_pairs(sets, F.col("n_blocks")).select("comp", "pair", "cid", "block", "alone", "copies", "n_blocks", "shingles")
    sets = sets.repartition("comp", "pair").sortWithinPartitions("comp", "pair")
    checked = stored(sets.mapInPandas(_verified(similarity), "cid binary, root binary, links long, one boolean"), "checked")
    links = checked.groupBy("cid").agg(F.sum("links").alias("links"))
    whole = checked.filter("one").select("cid", "root")
    parts = checked.filter(~F.col("one") & (F.col("cid") != F.col("root")))
    if not parts.isEmpty():
        joined = components(parts.select(F.col("cid").alias("a"), F.col("root").alias("b")))
        whole = whole.union(joined.select(F.col("node").alias("cid"), "root"))
    told = stored(about.join(links, "cid").join(whole.distinct(), "cid", "left").select("cid", "rep", "copies", "links", F.coalesce("root", "cid").alias("root")), "told")
    first = stored(told.groupBy("root").agg(F.min("rep").alias("class_id")), "first")
    told = told.join(first, "root").select("cid", "class_id", "links")
    every = classes.select("cid", "rep", "copies").join(told, "cid", "left")
    every = every.filter((F.col("copies") > 1) | F.col("links").isNotNull()).select(F.col("cid").alias("_cid"), F.coalesce("class_id", "rep").alias("_class"), F.col("rep").alias("_set"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"))
    every = stored(every, "every")
    out = signed.select("doc_id", "cid").join(bounded(every, every.count()), F.col("cid") == F.col("_cid"), "left")
    return out.select("cid", "doc_id", F.coalesce("_class", "doc_id").alias("class_id"), F.coalesce("_set", "doc_id").alias("set_id"), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without those whose class has a smaller doc_id, all columns; of rows that repeat a kept id in a class, all stay."""
    told = _joined(docs, similarity, RECALL).withColumn("_out", F.coalesce(F.col("doc_id") != F.col("class_id"), F.lit(False)))
    ids = told.groupBy(F.col("doc_id").alias("_drop")).agg(F.max("_out").alias("_any"), F.min("_out").alias("_all"))
    dropped = stored(ids.filter("_any").select("_drop", "_all"), "dropped")
    kept = docs.join(bounded(dropped, dropped.count()), F.col("doc_id") == F.col("_drop"), "left_anti")
    mixed = dropped.filter(~F.col("_all"))
    n_mixed = mixed.count()
    if not n_mixed:
        return kept
    # an id with rows of several sets, not all of them dropped
    mixed = bounded(mixed, n_mixed)
    sets = stored(told.filter("_out").join(mixed, F.col("doc_id") == F.col("_drop"), "left_semi").select(F.col("doc_id").alias("_id"), F.col("cid").alias("_set")).distinct(), "mixed")
    rows = docs.join(mixed, F.col("doc_id") == F.col("_drop"), "left_semi").withColumn("_cid", _cid_of("text"))
    return kept.union(rows.join(bounded(sets, sets.count()), (F.col("doc_id") == F.col("_id")) & (F.col("_cid") == F.col("_set")), "left_anti").drop("_cid"))
