"""Benchmark decontamination with SimHash windows, in DataFrame functions only.

Texts are lower-cased and cut into words of letters and digits; shingles are five words (all words
of a shorter item). A window has as many words as the item it is held against.

1. A window whose similarity to an item is above zero shares a shingle with it, so windows are laid
   only where a document's shingle meets an item's, aligned to it.
2. Every window and item gets a 64-bit SimHash, each shingle weighing as often as it occurs.
3. Fingerprints meet by multi-index Hamming search: eight blocks of eight bits, an item listed under
   every block value at distance two or less, so that no fingerprint within distance 23 is missed.
4. Weighted Jaccard similarity of the shingle multisets, sum of minima over sum of maxima, is worked
   out exactly; pairs of `similarity` or more are hits. Two texts at 0.8 differ in about 10 of 64
   bits (deviation 3), so the radius leaves out fewer than one in a million of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Rows of a side that is broadcast (each under 100 bytes); larger sides are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def words(text: Column | str) -> Column:
    """Lower-case words of letters and digits; null and wordless texts give an empty array."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), "")


def _shingle_at(w: Column, i: Column, k: int) -> list[Column]:
    return [F.get(w, i + j) for j in range(k)]


def _places(w: Column, k: int) -> Column:
    return F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(w: Column, k: int) -> Column:
    return F.transform(_places(w, k), lambda i: F.xxhash64(F.lit(k), *_shingle_at(w, i, k)))


def numbered_shingles(w: Column, k: Column) -> Column:
    """Every shingle as text with the number of its occurrence, so that set operations count multisets."""
    places = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    texts = F.transform(places, lambda i: F.array_join(F.slice(w, i + 1, k), " "))
    return F.transform(F.array(texts), lambda t: F.transform(t, lambda s, i: F.concat_ws("#", s, F.size(F.filter(F.slice(t, F.lit(1), i + 1), lambda x: x == s)))))[0]


def simhash(w: Column, k: Column) -> Column:
    """64 bits: the sign of the sum over shingles of +1 or -1 by each bit of the shingle's hash."""
    places = F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0)))
    hashes = F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, k), " ")))
    bit = lambda h, b: F.getbit(h, b).cast("int") * 2 - 1
    sums = lambda hs: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(hs, F.lit(0), lambda a, h: a + bit(h, b)))
    pack = lambda s: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(F.when(F.get(s, b) > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))))
    return F.transform(F.array(hashes), lambda hs: F.transform(F.array(sums(hs)), pack)[0])[0]


def _block_values(fingerprint: Column, radius: int) -> Column:
    """(block, value) of the fingerprint's blocks and of all values within `radius` bits of them."""
    flips = [0]
    for _ in range(radius):
        flips = sorted({f ^ (1 << b) for f in flips for b in range(BLOCK_BITS)} | set(flips))
    masks = F.array(*[F.lit(x) for x in flips])
    value = lambda i: F.shiftrightunsigned(fingerprint, i * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
    around = lambda i: F.transform(masks, lambda m: F.struct(F.lit(i).alias("block"), value(i).bitwiseXOR(m).alias("value")))
    return F.flatten(F.array(*[around(i) for i in range(BLOCKS)]))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def hits(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words: the best window of every contaminated pair.

    Equal windows: the first counts. Null and wordless texts and items hit nothing. Rows that repeat
    an id count as one document (or item) with several texts. Other columns are not carried.
    """
    n = F.size("w")
    items = benchmark.select("item_id", words("text").alias("w")).filter(n > 0).select("item_id", "w", n.alias("n"), F.least(n, F.lit(SHINGLE)).alias("k")).distinct()
    items = cut_lineage(items)
    sizes = sorted(r[0] for r in items.select("k").distinct().collect())  # at most SHINGLE values
    own = docs.select("doc_id", words("text").alias("w"))
    if not sizes:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, similarity double, start_word int, n_words int")
    seeds = None
    for k in sizes:
        listed = items.filter(F.col("k") == k).select("n", F.posexplode(shingle_hashes(F.col("w"), k)).alias("off", "h")).distinct()
        listed = _bounded(listed, listed.count())
        met = own.select("doc_id", F.size("w").alias("_size"), F.posexplode(shingle_hashes(F.col("w"), k)).alias("pos", "h")).join(listed, "h")
        start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("off"), F.col("_size") - F.col("n")))
        met = met.select("doc_id", "n", F.lit(k).alias("k"), start.alias("start"))
        seeds = met if seeds is None else seeds.union(met)
    laid = cut_lineage(seeds.groupBy("doc_id", "n", "k").agg(F.collect_set("start").alias("starts")).groupBy("doc_id").agg(F.collect_list(F.struct("n", "k", "starts")).alias("laid")))
    there = own.withColumnRenamed("doc_id", "_id").join(_bounded(laid, 8 * laid.count()), F.col("_id").eqNullSafe(F.col("doc_id")))
    window = F.flatten(F.transform("laid", lambda x: F.transform(x["starts"], lambda s: F.struct(s.alias("start"), x["n"].alias("n"), x["k"].alias("k"), F.slice("w", s + 1, x["n"]).alias("w")))))
    windows = there.select("doc_id", F.explode(window).alias("x")).select("doc_id", "x.*")
    windows = windows.withColumn("fp", simhash(F.col("w"), F.col("k")))
    marked = items.withColumn("item_fp", simhash(F.col("w"), F.col("k"))).select("item_id", "n", F.col("w").alias("item_w"), "item_fp")
    index = marked.select("*", F.explode(_block_values(F.col("item_fp"), BLOCK_RADIUS)).alias("b")).select("item_id", "n", "item_w", "item_fp", "b.*")
    near = windows.withColumn("b", F.explode(_block_values(F.col("fp"), 0))).select("doc_id", "start", "n", "k", "w", "fp", "b.*").join(_bounded(index, 50 * BLOCKS * items.count()), ["n", "block", "value"])
    # a pair met in several blocks is taken in the first of them
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    close = lambda i: F.bit_count(F.shiftrightunsigned(apart, i * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))) <= BLOCK_RADIUS
    first = F.coalesce(*[F.when(close(i), F.lit(i)) for i in range(BLOCKS)])
    near = near.filter((F.bit_count(apart) <= RADIUS) & (F.col("block") == first))
    near = near.withColumn("_a", numbered_shingles(F.col("w"), F.col("k"))).withColumn("_b", numbered_shingles(F.col("item_w"), F.col("k")))
    shared = F.size(F.array_intersect("_a", "_b"))
    exact = near.withColumn("similarity", shared / (F.size("_a") + F.size("_b") - shared)).filter(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("_at"), F.size("w").alias("n_words")))
    return exact.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.similarity", (-F.col("x._at")).alias("start_word"), "x.n_words")


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that hit no item, all columns."""
    found = cut_lineage(hits(docs, benchmark, similarity).select(F.col("doc_id").alias("_hit")).distinct())
    return docs.join(_bounded(found, found.count()), F.col("doc_id").eqNullSafe(F.col("_hit")), "left_anti")
