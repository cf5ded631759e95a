"""Auth logs: files with stable line numbers, growing folders, journal exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import auth, filters
from graphloom.operators.ranking import tail_lines
from graphloom.schemas import LOG_LINES
from graphloom.session import cut_lineage
from graphloom.sources import growing


#: Split counts are broadcast up to this many bytes, else joined by shuffle.
SPLIT_BYTES = 64 << 20


def _fixed_splits(spark: SparkSession) -> None:
    """Files are cut the same way in every scan, even if executors come or go between two of them."""
    name = "spark.sql.files.minPartitionNum"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(max(1, spark.sparkContext.defaultParallelism)))


def numbered(rows: DataFrame, per_file: bool = True, name: str = "line_no") -> DataFrame:
    """Text rows (file, block, at and more) with their number from 1, in a file or in all files by name.

    Lines are counted per split; the counts of earlier splits and a line's place in its split make
    its number. Only one row a split is shuffled, never a line, so a file of any size is read by many tasks.
    """
    splits = rows.groupBy("file", "block").agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # One row a split: a window over all of them is small.
    order = Window.partitionBy("file").orderBy("block") if per_file else Window.orderBy("file", "block")
    earlier = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = cut_lineage(splits.withColumn("_before", earlier).drop("_n"))
    size = splits.agg(F.sum(F.octet_length("file") + 40)).first()[0] or 0
    met = rows.join(F.broadcast(splits) if size <= SPLIT_BYTES else splits, ["file", "block"], "left")
    before = F.coalesce("_before", F.raise_error(F.lit("a split was not counted")).cast("long"))
    return met.withColumn(name, (F.col("at") - F.col("_first") + before + 1).cast("long")).drop("block", "at", "_first", "_before")


def placed_text(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, at) of text files: the split a line is in and its place there."""
    _fixed_splits(spark)
    reader = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    return reader.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, line_no) of one or many log files; missing or unreadable files give no rows.

    What could not be read is told by `read_source_errors`.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place):
        return spark.createDataFrame([], LOG_LINES)
    return numbered(placed_text(spark, path)).select("value", "file", "line_no")


def read_source_errors(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(file, pos, error) of what cannot be read below a folder: files, compressed data, bytes that are no text."""
    reader = spark.read.format(growing.register(spark)).option("glob", glob).option("compressed", "true").option("errorsOnly", "true")
    return reader.load(folder).select("file", "pos", "error")


def read_log_text(spark: SparkSession, path: str) -> DataFrame:
    """(value, file) of one or many log files, in no order and without numbers: nothing is shuffled."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place):
        return spark.createDataFrame([], LOG_LINES).drop("line_no")
    reader = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def read_log_history(spark: SparkSession, path: str, year: int, max_lines: int | None = None, zone: str = "UTC",
                     now: Column | None = None) -> DataFrame:
    """Events of all lines of each log, or of its last `max_lines`."""
    lines = read_log_lines(spark, path)
    return auth.parse_auth_lines(lines if max_lines is None else tail_lines(lines, max_lines), year, zone, now)


def tail_log(spark: SparkSession, folder: str, per_trigger: int | None = None) -> DataFrame:
    """Stream of lines of a log folder; rotated files are new files, the checkpoint is the position."""
    reader = spark.readStream.format("text")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(folder).select("value", F.col("_metadata.file_path").alias("file"))


def follow_log(spark: SparkSession, folder: str, start: str = "begin", glob: str = "*", compressed: bool = False) -> DataFrame:
    """Stream of (value, file, pos, error) of logs that grow in place, from their begin or their end.

    Lines appended to a known file arrive once, also after a restart and under a new name; what
    cannot be read arrives as a row with `error`.
    """
    reader = spark.readStream.format(growing.register(spark)).option("start", start).option("glob", glob)
    return reader.option("compressed", str(compressed).lower()).load(folder)


def read_journal_export(spark: SparkSession, path: str, now: Column, minutes: int = 30, units: list[str] | None = None,
                        zone: str = "UTC") -> DataFrame:
    """Events of exported journal lines of the last minutes, of all or some services."""
    events = filters.time_cutoff(auth.parse_auth_lines(read_log_text(spark, path), 1970, zone, now), now, minutes)
    return events.where(F.col("service").isin(units)) if units else events
