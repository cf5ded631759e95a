"""Order-dependent operators that never put an unbounded group in one task.

`ranked` is the row_number of this library. It first proves, from an aggregate of the key
columns, that no group exceeds `task_rows`; then a plain window does. Otherwise rows are cut
into ranges of the full sort key (group columns first), so a group holding a third of the
table is spread over many tasks, and the counts of earlier ranges are added to the local number.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.skew import own_shuffle

TASK_ROWS = 1_000_000
_SAMPLES_PER_RANGE = 16


def ranked(
    df: DataFrame,
    part: list[str],
    order: list[tuple[str, Column] | str],
    rn: str = "rn",
    n: str | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Add a 1-based position `rn` (and the group size `n`) per `part` group, ascending by `order`.

    `order` holds column names or (name, expression) pairs and must make positions unique.
    Group columns must not be NULL.
    """
    order = [(f"__o{i}", F.col(o) if isinstance(o, str) else o[1]) for i, o in enumerate(order)]
    names = [name for name, _ in order]
    keyed = df.select("*", *[e.alias(name) for name, e in order])
    if largest_group(df, part) <= task_rows:
        group = Window.partitionBy(*part)
        out = keyed.withColumn(rn, F.row_number().over(group.orderBy(*names)).cast("long"))
        if n:
            out = out.withColumn(n, F.count(F.lit(1)).over(group))
        return out.drop(*names)

    keyed = _with_range(keyed, part + names)
    counts = keyed.groupBy("__range", *part).agg(F.count(F.lit(1)).alias("__c"))
    # One row per range and group: at most as many rows of any one group as there are ranges.
    before = Window.partitionBy(*part).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__c").over(before), F.lit(0)))
    if n:
        offsets = offsets.withColumn(n, F.sum("__c").over(Window.partitionBy(*part)))
    offsets = offsets.drop("__c")
    if not part:
        offsets = F.broadcast(offsets)  # one row per range
    local = Window.partitionBy("__range", *part).orderBy(*names)
    return (
        keyed.join(offsets, ["__range", *part])
        .withColumn(rn, (F.row_number().over(local) + F.col("__off")).cast("long"))
        .drop("__range", "__off", *names)
    )


def largest_group(df: DataFrame, part: list[str]) -> int:
    """Row count of the largest group: one aggregate over the key columns, one row to the driver."""
    if not part:
        return df.count()
    sizes = df.groupBy(*part).agg(F.count(F.lit(1)).alias("c"))
    return sizes.agg(F.max("c")).first()[0] or 0


def _with_range(keyed: DataFrame, columns: list[str]) -> DataFrame:
    """Add `__range`, the number of the sort-key range a row falls in.

    Bounds come from a bounded sample of keys in hash order, so every evaluation finds the same
    ones. They are held in two levels, which keeps the lookup at about 2*sqrt(ranges) comparisons.
    """
    ranges = max(2, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    step = ceil(sqrt(ranges))
    key = F.struct(*columns)
    sample = (
        keyed.select(key.alias("k"))
        .orderBy(F.xxhash64("k"))
        .limit(ranges * _SAMPLES_PER_RANGE)
        .agg(F.array_sort(F.collect_list("k")).alias("a"))
    )
    stride = F.greatest(F.lit(1), F.floor(F.size("a") / F.lit(ranges)).cast("int"))
    picked = sample.select(F.filter("a", lambda x, i: (i % stride) == 0).alias("a"))
    last = F.floor((F.greatest(F.size("a"), F.lit(1)) - 1) / F.lit(step)).cast("int")
    rows = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(F.col("a"), i * step + 1, F.lit(step)))
    heads = F.transform("rows", lambda r: F.get(r, F.lit(0)))
    bounds = picked.select(rows.alias("rows")).select(F.struct(heads.alias("heads"), "rows").alias("b")).scalar()

    def not_above(bound_list: Column, k: Column) -> Column:
        return F.size(F.filter(bound_list, lambda x: x <= k))

    head = F.transform(F.array(key), lambda k: F.struct(k.alias("k"), not_above(F.col("__b.heads"), k).alias("h")))
    number = F.transform(head, lambda x: F.when(
        x["h"] > 0, (x["h"] - 1) * step + not_above(F.get(F.col("__b.rows"), x["h"] - 1), x["k"])))
    return keyed.withColumn("__b", bounds).withColumn(
        "__range", F.coalesce(F.get(number, F.lit(0)), F.lit(0))).drop("__b")


def dense_codes(df: DataFrame, column: str, code: str) -> DataFrame:
    """0-based code of each distinct value in ascending order, added to every row (NULL stays NULL)."""
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    codes = ranked(values, [], [column], rn="__rn").select(column, (F.col("__rn") - 1).alias(code))
    return df.join(codes, column, "left")


def last_wins(df: DataFrame, keys: list[str], seq: str | Column) -> DataFrame:
    """Keep the row with the greatest `seq` per key, by a map-side-combining aggregate."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*[F.col(c) for c in rest]), seq)
    return df.groupBy(*keys).agg(row.alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(
        df.columns)


def first_declaring_file(symbols: DataFrame, files_seq: str = "file_seq") -> DataFrame:
    """Attribute a symbol to the first file, in file order, that declares it."""
    return last_wins(symbols, ["id"], -F.col(files_seq))


def source_order(symbols: DataFrame) -> DataFrame:
    """Position `rn` and count `n` of each symbol within its file, by line then id."""
    return ranked(symbols, ["file"], ["line", "id"], rn="rn", n="n")


def tail_lines(lines: DataFrame, limit: int) -> DataFrame:
    """Last `limit` lines of each file; line numbers are dense, so the maximum is enough."""
    top = lines.groupBy("file").agg(F.max("line_no").alias("__top"))
    return lines.join(own_shuffle(top), "file").where(F.col("line_no") > F.col("__top") - limit).drop("__top")


def recent_n(events: DataFrame, limit: int, seq: str = "seq") -> DataFrame:
    """The newest `limit` events, oldest of them first."""
    return events.orderBy(F.col(seq).desc()).limit(limit).orderBy(seq)


def recent_sessions(events: DataFrame, limit: int = 50, seq: str = "seq") -> DataFrame:
    """Newest sessions by first arrival."""
    return (
        events.groupBy("session_id").agg(F.min(seq).alias("first_seq"))
        .orderBy(F.col("first_seq").desc()).limit(limit)
    )


def first_last(events: DataFrame, key: str, ts: str, seq: str, columns: list[str]) -> DataFrame:
    """First and last event of each key, by time then arrival."""
    at = F.struct(ts, seq)
    picks = [f(F.col(c), at).alias(f"{p}_{c}") for p, f in (("first", F.min_by), ("last", F.max_by)) for c in columns]
    return events.groupBy(key).agg(*picks)


def emit_order(nodes: DataFrame) -> DataFrame:
    """Sequence number by depth (9 when unknown), then id."""
    return ranked(nodes, [], [("d", F.coalesce(F.col("depth"), F.lit(9))), "id"], rn="seq")


def listing_order(entries: DataFrame) -> DataFrame:
    """Folders before files, then name without regard to case."""
    return entries.orderBy(F.col("is_file"), F.lower("name"), "path")


def chunked_lists(df: DataFrame, group: list[str], item: str, chunk: int = 10_000) -> DataFrame:
    """Lists of a group's items in bounded chunks: (group, chunk, items); nothing is dropped."""
    numbered = ranked(df, group, [item], rn="__rn")
    numbered = numbered.withColumn("chunk", F.floor((F.col("__rn") - 1) / F.lit(chunk)).cast("long"))
    return numbered.groupBy(*group, "chunk").agg(F.array_sort(F.collect_list(item)).alias("items"))
