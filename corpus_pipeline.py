"""From raw documents to a mixed training set: five stages, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, mixing, near_copies, pii, quality
from graphloom.llm.common import stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network gives 0.5 or more."""
    net = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, net, tuple(docs.columns)).filter(F.col("score") >= 0.5).drop("score")


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    return near_copies.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates at which the documents are to be drawn."""
    return mixing.mix(docs, mixing.domains_of(table(spark, sf_dir, "labels")), mixing.TARGETS)


STAGES = [
    ("quality", keep_good),
    ("near_copies", keep_one_copy),
    ("decontamination", drop_leaks),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
]

#: The network and the rates are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
