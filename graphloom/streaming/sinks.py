"""Writing streams: one folder per micro-batch, rewritten whole when a batch is retried."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def write_batches(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", available_now: bool = True,
                  each: Callable[[DataFrame, int], DataFrame] | None = None) -> StreamingQuery:
    """Write each micro-batch (after `each`) to `out/batch=N`; a retry overwrites its own folder."""
    def write(batch: DataFrame, number: int) -> None:
        rows = batch if each is None else each(batch, number)
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def write_stateful(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", available_now: bool = True) -> StreamingQuery:
    """`write_batches` for streams with state of their own, which lives in RocksDB: on disk and in the checkpoint, not on the heap."""
    conf = stream.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKS)
    try:
        # A running query keeps the settings it started with.
        return write_batches(stream, out, checkpoint, mode, available_now)
    finally:
        conf.unset(_PROVIDER) if before is None else conf.set(_PROVIDER, before)


def drain(query: StreamingQuery) -> None:
    """Wait for an availableNow query and surface its error."""
    query.awaitTermination()


def read_batches(spark: SparkSession, out: str, schema) -> DataFrame:
    """All written batches with their number in `batch`."""
    return spark.read.schema(schema).option("basePath", out).parquet(out).withColumn(
        "batch", F.regexp_extract(F.col("_metadata.file_path"), r"batch=(\d+)", 1).cast("long"))


def on_progress(spark: SparkSession, callback: Callable[[str, int, int], None]) -> StreamingQueryListener:
    """Call back with (query name or id, batch, input rows) after every micro-batch; returns the listener to remove."""
    class Report(StreamingQueryListener):
        def onQueryStarted(self, event) -> None: ...

        def onQueryIdle(self, event) -> None: ...

        def onQueryTerminated(self, event) -> None: ...

        def onQueryProgress(self, event) -> None:
            p = event.progress
            callback(p.name or str(p.id), p.batchId, p.numInputRows)

    listener = Report()
    spark.streams.addListener(listener)
    return listener


class Reported:
    """A table whose rows are counted while something else reads it."""

    def __init__(self, df: DataFrame, stage: str, callback: Callable[[str, int], None]) -> None:
        self._seen, self._stage, self._callback = Observation(), stage, callback
        self.table = df.observe(self._seen, F.count(F.lit(1)).alias("n"))

    def tell(self) -> None:
        """Call back with (stage, rows) of the first run that read the table; waits for it."""
        self._callback(self._stage, self._seen.get["n"])


def reported(df: DataFrame, stage: str, callback: Callable[[str, int], None]) -> Reported:
    """Progress of a batch stage without a second pass: use `.table` in its place, and `.tell()` after the run."""
    return Reported(df, stage, callback)
