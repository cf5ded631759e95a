"""The catalogue of graph runs and the saved views, as append-only tables.

Nothing is deleted in place: a deletion appends a tombstone row, and the live view keeps the
newest row per key unless it is a tombstone.
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import keys, times
from graphloom.operators.ranking import last_wins
from graphloom.operators.skew import own_shuffle
from graphloom.schemas import GRAPH_RUNS

TTL_SECONDS = 86_400   # fixed value: how long a stored run is served
LISTED_RUNS = 50       # fixed value: entries of a listing


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each key."""
    return last_wins(runs, ["key"], "ts")


def live_runs(runs: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """Newest runs not covered by a later tombstone of their key or repository.

    Tombstones are (scope, ts): a run key, or a repository key for all its runs.
    """
    newest = latest_runs(runs).withColumn("repo_key", F.substring_index("key", "::", 1))
    if tombstones is not None:
        gone = tombstones.groupBy("scope").agg(F.max("ts").alias("gone_ts"))
        for column in ("key", "repo_key"):
            newest = newest.join(own_shuffle(gone.withColumnRenamed("scope", column)), column, "left").where(
                F.col("gone_ts").isNull() | (F.col("ts") > F.col("gone_ts"))).drop("gone_ts")
    return newest


def fresh_runs(runs: DataFrame, now: Column, ttl: int = TTL_SECONDS, tombstones: DataFrame | None = None) -> DataFrame:
    """Runs that may be served: live and not older than the time to live."""
    return live_runs(runs, tombstones).where((F.unix_micros(now) - F.unix_micros("ts")) / F.lit(1e6) <= ttl)


def list_runs(runs: DataFrame, now: Column, limit: int = LISTED_RUNS, ttl: int = TTL_SECONDS, tombstones: DataFrame | None = None) -> DataFrame:
    """Newest runs first with their age; stale ones are listed and marked."""
    age = times.age_seconds(F.col("ts"), now)
    return live_runs(runs, tombstones).orderBy(F.col("ts").desc(), "key").limit(limit).withColumn("age_seconds", age).withColumn(
        "is_stale", F.col("age_seconds") > ttl)


def live_changes(changes: DataFrame, by: list[str], at: str = "at") -> DataFrame:
    """Current rows of a change log (bookmarks, snapshots, history): newest per key unless deleted."""
    return last_wins(changes, by, at).where(~F.col("deleted")).drop("deleted")


def url_hash(url: Column) -> Column:
    return keys.short_hash(url)


def count_mismatches(runs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Runs whose declared counts (node_count, edge_count) differ from the stored rows."""
    n = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("nodes_found"))
    e = edges.groupBy("key").agg(F.count(F.lit(1)).alias("edges_found"))
    found = runs.join(n, "key", "left").join(e, "key", "left")
    for c in ("nodes_found", "edges_found"):
        found = found.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
    return found.where((F.col("node_count") != F.col("nodes_found")) | (F.col("edge_count") != F.col("edges_found")))


def _plain(name: str, kind: T.DataType) -> Column:
    """A value as text that does not depend on the order of map entries or the sign of zero."""
    if isinstance(kind, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(name)))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return (F.col(name) + F.lit(0.0)).cast("string")
    return F.to_json(F.struct(name), {"ignoreNullFields": "false"}) if isinstance(kind, (T.StructType, T.ArrayType)) else F.col(name).cast("string")


def fingerprints(rows: DataFrame, by: list[str], columns: list[str] | None = None) -> DataFrame:
    """Per key the number of rows and a fingerprint of them as a multiset: the order does not matter, repeats do.

    Each row is hashed twice; hashes are added up, so partial results combine and no key is collected.
    """
    columns = sorted(columns or [c for c in rows.columns if c not in by])
    # A null is written unlike any text.
    fields = [F.coalesce(F.concat(F.lit("v"), _plain(c, rows.schema[c].dataType)), F.lit("n")) for c in columns]
    row = F.array(*fields)
    hashed = rows.select(*by, *[F.xxhash64(row, F.lit(i)).cast("decimal(38,0)").alias(f"__h{i}") for i in (0, 1)])
    return hashed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.struct(F.sum("__h0").alias("a"), F.sum("__h1").alias("b")).alias("print"))


def replay_mismatches(stored: dict[str, DataFrame], rebuilt: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """(part, key..., stored_rows, rebuilt_rows) of every key whose stored and rebuilt rows are not the same multiset.

    Parts are tables by name, say nodes and edges. A single changed attribute or doubled row shows;
    equal graphs give no rows. Columns that only one side has are not compared.
    """
    found = []
    for part, left in stored.items():
        right = rebuilt[part]
        columns = [c for c in left.columns if c in right.columns and c not in by]
        a, b = (fingerprints(df, by, columns).select(*by, F.col("n").alias(f"{name}_rows"), F.col("print").alias(f"__{name}"))
                for df, name in ((left, "stored"), (right, "rebuilt")))
        met = a.join(b, by, "full").where(~F.col("__stored").eqNullSafe(F.col("__rebuilt")))
        counts = [F.coalesce(f"{name}_rows", F.lit(0)).alias(f"{name}_rows") for name in ("stored", "rebuilt")]
        found.append(met.select(F.lit(part).alias("part"), *by, *counts))
    return functools.reduce(DataFrame.unionByName, found)


class RunStore:
    """Stored graphs below a shared folder: catalogue rows plus nodes and edges per run."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _append(self, df: DataFrame, table: str) -> None:
        df.write.mode("append").parquet(f"{self.root}/{table}")

    def _read(self, table: str, schema) -> DataFrame:
        """A table, empty before its first append."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")

    def runs(self) -> DataFrame:
        return self._read("runs", GRAPH_RUNS)

    def tombstones(self) -> DataFrame:
        return self._read("tombstones", "scope string, ts timestamp")

    def _payload(self, key: str, micros: int, part: str) -> str:
        repo, _, run = key.partition("::")
        return f"{self.root}/payload/repo_key={repo}/run_hash={run}/at={micros}/{part}"

    def put(self, nodes: DataFrame, edges: DataFrame, key: str, ts: Column, label: str, url: str = "", mode: str = "", layout: str = "") -> None:
        """Store a graph; the catalogue row is appended last, so a half-written run is never seen."""
        if not key.partition("::")[2]:
            return
        micros = self.spark.range(1).select(F.unix_micros(ts)).first()[0]
        for df, part in ((nodes, "nodes"), (edges, "edges")):
            df.write.mode("overwrite").parquet(self._payload(key, micros, part))
        sizes = [self.spark.read.parquet(self._payload(key, micros, part)) for part in ("nodes", "edges")]
        size = sum((df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0))).first()[0] for df in sizes))
        row = self.spark.range(1).select(
            *[F.lit(v).alias(c) for c, v in (("key", key), ("label", label), ("url", url), ("mode", mode), ("layout", layout))],
            F.timestamp_micros(F.lit(micros)).alias("ts"), F.lit(size).cast("long").alias("size_bytes"))
        self._append(row, "runs")

    def get(self, key: str, now: Column, ttl: int = TTL_SECONDS) -> tuple[DataFrame, DataFrame] | None:
        hit = fresh_runs(self.runs().where(F.col("key") == key), now, ttl, self.tombstones()).select(F.unix_micros("ts")).first()
        if hit is None:
            return None
        return tuple(self.spark.read.parquet(self._payload(key, hit[0], part)) for part in ("nodes", "edges"))

    def list(self, now: Column, limit: int = LISTED_RUNS) -> DataFrame:
        return list_runs(self.runs(), now, limit, tombstones=self.tombstones())

    def _bury(self, scope: str, ts: Column, matched: DataFrame) -> bool:
        found = matched.limit(1).count() > 0
        if found:
            self._append(self.spark.range(1).select(F.lit(scope).alias("scope"), ts.alias("ts")), "tombstones")
        return found

    def evict(self, key: str, ts: Column) -> bool:
        """True when there was something to evict."""
        return self._bury(key, ts, live_runs(self.runs(), self.tombstones()).where(F.col("key") == key))

    def evict_repo(self, repo_key: str, ts: Column) -> bool:
        return self._bury(repo_key, ts, live_runs(self.runs(), self.tombstones()).where(F.col("repo_key") == repo_key))

    def put_tree(self, files: DataFrame, folders: DataFrame, repo_key: str, at: Column, is_partial: bool = False) -> None:
        """Store a source listing; the newest per repository is the current one."""
        stamp = F.unix_micros(at)
        for df, table in ((files, "tree_files"), (folders, "tree_folders")):
            df.withColumns({"tree_key": F.lit(repo_key), "at": stamp, "is_partial": F.lit(is_partial)}).write.mode("append").partitionBy(
                "tree_key", "at").parquet(f"{self.root}/{table}")

    def get_tree(self, repo_key: str, now: Column, ttl: int = TTL_SECONDS) -> tuple[DataFrame, DataFrame] | None:
        """Files and folders of the newest stored whole listing, None when there is none, it is stale or partial.

        Partitions are pruned by key and time.
        """
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/tree_folders")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return None
        folders = self.spark.read.parquet(f"{self.root}/tree_folders").where((F.col("tree_key") == repo_key) & ~F.col("is_partial"))
        latest = folders.agg(F.max("at").alias("at")).where((F.unix_micros(now) - F.col("at")) / F.lit(1e6) <= ttl).first()
        if latest is None or latest["at"] is None:
            return None
        files = self.spark.read.parquet(f"{self.root}/tree_files").where(F.col("tree_key") == repo_key)
        return files.where(F.col("at") == latest["at"]), folders.where(F.col("at") == latest["at"])

    # bookmarks by name, snapshots by name, history by (url hash, captured_at)

    def log_change(self, table: str, rows: DataFrame, at: Column, deleted: bool = False) -> None:
        self._append(rows.withColumns({"at": at, "deleted": F.lit(deleted)}), table)

    def save_snapshot(self, name: str, nodes: DataFrame, edges: DataFrame, at: Column) -> None:
        """Keep a graph under a name; the listing row is appended last. A later one of the name takes its place."""
        micros = self.spark.range(1).select(F.unix_micros(at)).first()[0]
        counts = {}
        for df, part in ((nodes, "nodes"), (edges, "edges")):
            seen = Observation()
            df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(self._snapshot(name, micros, part))
            counts[part] = seen.get["n"]
        row = self.spark.range(1).select(F.lit(name).alias("name"), F.lit(counts["nodes"]).cast("long").alias("node_count"),
                                         F.lit(counts["edges"]).cast("long").alias("edge_count"), F.lit(micros).alias("micros"))
        self.log_change("saved_snapshots", row, F.timestamp_micros(F.lit(micros)))

    def delete_snapshot(self, name: str, at: Column) -> None:
        gone = self.spark.range(1).select(F.lit(name).alias("name"), *[F.lit(0).cast("long").alias(c) for c in ("node_count", "edge_count", "micros")])
        self.log_change("saved_snapshots", gone, at, deleted=True)

    def snapshots(self) -> DataFrame:
        """(name, node_count, edge_count, micros, at) of the snapshots there are; no payload is read."""
        return self.current("saved_snapshots", "name string, node_count bigint, edge_count bigint, micros bigint", ["name"])

    def load_snapshot(self, name: str) -> tuple[DataFrame, DataFrame] | None:
        hit = self.snapshots().where(F.col("name") == name).select("micros").first()
        if hit is None:
            return None
        return tuple(self.spark.read.parquet(self._snapshot(name, hit[0], part)) for part in ("nodes", "edges"))

    def _snapshot(self, name: str, micros: int, part: str) -> str:
        return f"{self.root}/snapshot_payload/name_hash={hashlib.sha256(name.encode()).hexdigest()[:32]}/at={micros}/{part}"

    def current(self, table: str, schema: str, by: list[str]) -> DataFrame:
        return live_changes(self._read(table, f"{schema}, at timestamp, deleted boolean"), by)
