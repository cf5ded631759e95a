"""Helpers shared by the training-data operators: tables, bounded samples, hashed words in numpy."""

from __future__ import annotations

import gc

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.session import run_dir

#: Bytes that separate words, as in `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit number for each byte, for polynomial hashes modulo 2**64, and their odd bases.
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
BASES = tuple(int(x) | 1 for x in _rng.integers(2**62, 2**63, 4, dtype=np.uint64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def bounded_sample(df: DataFrame, label: str, key: str, per_label: int) -> DataFrame:
    """At most `per_label` rows of each label, chosen by the hash of `key`; the label counts alone reach the driver.

    Rows are thinned by hash to about twice the bound before a window ranks them, so no group is
    sorted whole. Rows without label are left out; equal keys are ranked in any order.
    """
    df = df.filter(F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    if not counts:
        return df.limit(0)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (2 * per_label + 50) / n))])
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(F.col(key)), F.col(key)))
    return df.filter(draw < share[F.col(label)]).withColumn("_rank", rank).filter(F.col("_rank") <= per_label).drop("_rank")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_powers: dict[tuple[int, int], np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    key = (base, 0)
    have = _powers.get(key)
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _powers[key] = have
    return have[:n]


def runs(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of codes[start:end] for each pair, from prefix sums of a polynomial modulo 2**64."""
    prefix = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _power(base, len(codes)), out=prefix[1:])
    inverse = _power(pow(base, -1, 1 << 64), len(codes) + 1)
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~SPACE[raw]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: bytes, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of every word of the text."""
    starts, ends = words_of(data)
    return runs(BYTE_CODE[np.frombuffer(data, np.uint8)], starts, ends, base) if len(starts) else np.zeros(0, np.uint64)


def shingles(hashes: np.ndarray, k: int, base: int = BASES[1]) -> np.ndarray:
    """A 64-bit hash of every k consecutive words; none if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return runs(hashes, at, at + k, base)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: it survives lost executors and
    carries no partitioning, so that both sides of a later join are shuffled and skewed keys split."""
    path = run_dir(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete written tables that no later plan reads, and let Spark drop the shuffle files of finished plans."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for t in tables:
        folders = {f.rpartition("/")[0] for f in t.inputFiles()}
        for folder in folders:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
    gc.collect()
    jvm.System.gc()


def bounded(df: DataFrame, rows: int, most: int = 1_000_000) -> DataFrame:
    """Marked for broadcast if its counted rows (of well under 100 bytes) are at most `most`; else joined by shuffle."""
    return F.broadcast(df) if rows <= most else df


def by_group(batches, keys: list[str]):
    """Frames that hold whole groups of an input sorted by `keys`; a group may span batches."""
    import pandas as pd

    held = []
    for pdf in batches:
        if not len(pdf):
            continue
        last = pdf[keys].iloc[-1]
        same = np.ones(len(pdf), bool)
        for k in keys:
            same &= (pdf[k] == last[k]).to_numpy()
        cut = len(pdf) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut == 0 and held and all(held[-1][k].iloc[-1] == last[k] for k in keys):
            held.append(pdf)
            continue
        if cut == 0:
            if held:
                yield pd.concat(held, ignore_index=True)
            held = [pdf]
            continue
        yield pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
        held = [pdf.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)
