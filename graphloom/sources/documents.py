"""Small documents: lexicons, build databases, and writing graphs as JSON."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import feed, pieces
from graphloom.schemas import COMPILE_COMMANDS, LEXICON
from graphloom.sources import logs

LEXICONS = str(Path(__file__).resolve().parent.parent / "fixed" / "lexicons")


def available_lexicons(spark: SparkSession, folder: str = LEXICONS) -> DataFrame:
    """Languages that have a lexicon, by file name."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    return listed.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("language")).distinct().orderBy("language")


def load_lexicon(spark: SparkSession, language: str, folder: str = LEXICONS) -> DataFrame:
    return spark.read.schema(LEXICON).option("multiLine", "true").json(f"{folder}/{language.lower()}.json")


def read_compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """(file, args) of build databases, each a JSON array."""
    return compile_arguments(spark.read.schema(COMPILE_COMMANDS).option("multiLine", "true").json(path))


def compile_arguments(entries: DataFrame) -> DataFrame:
    """Arguments without the compiler, -o... and -c; quotes around an argument are dropped."""
    # Words are runs of quoted and unquoted text, as a shell would split them.
    shell_words = F.transform(F.regexp_extract_all("command", F.lit(r"((?:\"[^\"]*\"|'[^']*'|[^\s\"'])+)"), F.lit(1)),
                              lambda w: F.regexp_replace(w, "[\"']", ""))
    words = F.when(F.col("command").isNotNull(), shell_words).otherwise(
        F.slice("arguments", F.lit(2), F.greatest(F.size("arguments"), F.lit(1))))
    args = F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))
    return entries.select("file", F.filter(args, lambda a: ~a.startswith("-o") & (a != "-c")).alias("args"))


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str, shape: str = "gjgf", name: str = "graph", kind: str = "ast") -> None:
    """Write a graph document; the text parts, read in name order, are the JSON."""
    feed.graph_document(nodes, edges, shape, name, kind).select("text").write.mode("overwrite").text(path)


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one graph document of any size: the lines of its text parts in name order."""
    rows = logs.numbered(logs.placed_text(spark, path), per_file=False, name="seq")
    return pieces.read_pieces(rows.select("seq", F.col("value").alias("text")))
