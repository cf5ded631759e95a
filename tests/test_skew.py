"""A hot key in a join with a keyed side is split by adaptive execution."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import auth, filters, graph, ranking, traverse
from graphloom.sources import files as tree

CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "6",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def tight(spark):
    old = {k: spark.conf.get(k, None) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot(spark, column, n=12_000):
    """80 % of the rows on one key."""
    key = F.when(F.col("id") % 5 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 400).cast("string")))
    return spark.range(0, n, 1, 6).select(key.alias(column), F.sha2(F.col("id").cast("string"), 256).alias("pad"), "id")


def names(spark, column):
    return spark.range(0, 400, 1, 2).select(F.when(F.col("id") == 1, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias(column))


def cases(spark):
    stems = graph.file_by_stem(names(spark, "stem").withColumn("path", F.col("stem")).withColumn("seq", F.lit(1)))
    yield "attach_by_stem", graph.attach_by_stem(hot(spark, "file").select("file", F.col("pad").alias("id"), F.lit(2).alias("depth")), stems)
    yield "resolve", graph._resolved(hot(spark, "module").select("module", F.col("pad").alias("file_id")), stems)
    yield "warnings", graph.flag_parse_warnings(hot(spark, "file"), names(spark, "file"))
    yield "in_target", filters.in_target(hot(spark, "file"), names(spark, "stem"))
    yield "is_saved", filters.is_saved(hot(spark, "url"), names(spark, "url"))
    events = hot(spark, "session_id").select("session_id", "pad", F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"))
    yield "replay", auth.replay_schedule(events)
    yield "tail", ranking.tail_lines(hot(spark, "file").select("file", "pad", F.col("id").alias("line_no")), 1 << 40)
    repos = names(spark, "repo").withColumn("tier", F.lit("content")).groupBy("repo").agg(F.max("tier").alias("tier"))
    yield "tiers", tree.apply_tiers(hot(spark, "repo").select("repo", F.lit("").alias("folder"), F.col("pad").alias("raw")), repos)
    edges = hot(spark, "dst").select(F.col("pad").alias("src"), "dst")
    yield "drop_nodes", filters.drop_nodes(names(spark, "id"), edges, names(spark, "id").where("id = 'k7'"))[1]
    yield "grow", traverse.grow_selection(edges, names(spark, "id"))
    yield "large_star", traverse._large_star(edges.select(F.col("dst").alias("u"), F.concat(F.lit("z"), "src").alias("v")))


def test_hot_keys_are_split(tight):
    for name, df in cases(tight):
        df.write.format("noop").mode("overwrite").save()
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan, name
