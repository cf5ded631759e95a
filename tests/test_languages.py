"""Languages registered as functions of the files."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import extract
from graphloom.plans.code_graph import build_graph
from graphloom.sources import logs


@pytest.fixture
def toy():
    """A language whose symbols are the files' first words, numbered over the whole tree."""
    def nodes(files):
        word = F.substring_index("raw", " ", 1)
        return files.select(F.concat_ws("::", F.lit("toy"), "path", word).alias("id"), F.lit("word").alias("kind"), word.alias("label"),
                            F.lit(1).alias("line"), F.concat(F.lit("file::"), F.col("path")).alias("file_id"))

    extract.register_language("toy", [".toy"], nodes)
    yield
    extract.REGISTRY._languages.pop("toy")
    extract.REGISTRY._by_extension.pop(".toy")


def test_function_is_run_and_reaches_the_graph(files, toy):
    tree = files({"a.toy": "alpha x", "d/b.toy": "beta y", "c.go": "func F(a int) {\n"})
    rows = {r["label"]: r for r in extract.extract_symbols(tree).collect()}
    assert set(rows) == {"alpha", "beta", "F"} and rows["alpha"]["language"] == "toy" and rows["alpha"]["depth"] == 2
    nodes, edges = build_graph(tree, "r")
    assert {"toy::a.toy::alpha", "toy::d/b.toy::beta"} <= {r["id"] for r in nodes.collect()}
    assert ("file::d/b.toy", "toy::d/b.toy::beta") in {(r["src"], r["dst"]) for r in edges.collect()}


def test_journal_lines_are_not_shuffled(spark, tmp_path):
    (tmp_path / "j.log").write_text("2024-01-12T11:59:00+0000 host sshd[7]: Accepted password for bob from 1.2.3.4 port 22 ssh2\n")
    now = F.lit("2024-01-12 12:00:00+00:00").cast("timestamp")
    df = logs.read_journal_export(spark, str(tmp_path / "*.log"), now)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 1
    assert logs.read_journal_export(spark, str(tmp_path / "none*"), now).count() == 0
