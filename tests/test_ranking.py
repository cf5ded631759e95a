import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import ranking


@pytest.fixture(scope="module")
def skewed(spark):
    """A third and more of all rows in one group."""
    group = F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 97).cast("string")))
    return spark.range(10_000).select(group.alias("g"), F.xxhash64("id").alias("v"), "id")


@pytest.mark.parametrize("part", [["g"], []])
@pytest.mark.parametrize("task_rows", [0, 1_000_000])
@pytest.mark.parametrize("partitions", ["1", "8", "50"])
def test_ranked_is_row_number(spark, skewed, part, task_rows, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = ranking.ranked(skewed, part, ["v", "id"], n="n", task_rows=task_rows)
        w = Window.partitionBy(*part)
        both = got.withColumn("e", F.row_number().over(w.orderBy("v", "id"))).withColumn("en", F.count(F.lit(1)).over(w))
        assert both.where("rn <> e or n <> en").count() == 0 and both.count() == 10_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_ranges_split_a_hot_group(spark, skewed):
    keyed = ranking._with_range(skewed, ["g", "v", "id"])
    sizes = keyed.groupBy("__range").count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert sizes[0] < 4000 and sizes[1] >= 4


def test_ranked_of_nothing(skewed):
    for rows in (0, 10):
        assert ranking.ranked(skewed.where("false"), ["g"], ["id"], task_rows=rows).count() == 0


def test_dense_codes_keep_nulls(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "k string")
    assert sorted((r["k"] or "", r["c"]) for r in ranking.dense_codes(df, "k", "c").collect()) == [("", None), ("a", 0), ("b", 1), ("b", 1)]


def test_chunks_are_bounded_and_whole(skewed):
    chunks = ranking.chunked_lists(skewed, ["g"], "id", 100)
    got = chunks.agg(F.max(F.size("items")), F.sum(F.size("items"))).first()
    assert tuple(got) == (100, 10_000)


def test_last_wins_and_first_file(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, None)], "id string, file_seq int, v string")
    assert {r["id"]: r["v"] for r in ranking.last_wins(df, ["id"], "file_seq").collect()} == {"a": "y", "b": None}
    assert {r["id"]: r["v"] for r in ranking.first_declaring_file(df).collect()} == {"a": "x", "b": None}


def test_emit_order_puts_unknown_depth_last(spark):
    df = spark.createDataFrame([("z", 0), ("a", None), ("b", 2), ("a2", 2)], "id string, depth int")
    assert [r["id"] for r in ranking.emit_order(df).orderBy("seq").collect()] == ["z", "a2", "b", "a"]


def test_listing_order(spark):
    df = spark.createDataFrame([("b", True), ("A", True), ("z", False)], "name string, is_file boolean").withColumn("path", F.col("name"))
    assert [r["name"] for r in ranking.listing_order(df).collect()] == ["z", "A", "b"]
