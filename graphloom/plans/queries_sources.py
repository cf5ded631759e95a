"""Queries over sources: the given tables are written out as files and read back by the readers."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from graphloom.functions import times
from graphloom.operators import extract, graph
from graphloom.operators.skew import own_shuffle
from graphloom.plans import inputs as I
from graphloom.plans.queries_auth import journal_lines
from graphloom.plans.queries_files import _CODE_SQL, _by_language, _lines_sql
from graphloom.plans.queries_streams import _arrived
from graphloom.plans.registry import query, table
from graphloom.session import run_dir
from graphloom.sources import documents, files as tree, logs
from graphloom.streaming import auth as live, sinks

W = I.with_inputs


@query("SELECT 'source=' || source AS folder, '.txt' AS ext, CAST(sum(strlen(text) + 1) AS BIGINT) AS size FROM documents GROUP BY source")
def a1_scan_tree(spark, sf):
    """Documents as text files, one folder per source, found by the scanner."""
    root = run_dir(spark, "tree")
    table(spark, sf, "documents").select("text", "source").write.partitionBy("source").text(root)
    return tree.scan_tree(spark, root, [".txt"]).groupBy("folder", "ext").agg(F.sum("size").alias("size"))


@query(W("auth_events") + "SELECT epoch(ts) AS ts, event_type, session_id, detail FROM auth_events")
def a7_read_log_history(spark, sf):
    path = run_dir(spark, "log")
    I.log_lines(spark, sf).select("value").write.text(path)
    events = logs.read_log_history(spark, path, 2024)
    return events.select(times.epoch(F.col("ts")).alias("ts"), "event_type", "session_id", "detail")


@query(W("auth_events") + "SELECT epoch(ts) AS ts, event_type, session_id, detail FROM auth_events")
def a8_tail_log(spark, sf):
    path = run_dir(spark, "growing-log")
    I.log_lines(spark, sf).select("value").write.text(path)
    events = live.stream_auth_events(logs.tail_log(spark, path), 2024)
    return _arrived(spark, events, "tail").select(times.epoch(F.col("ts")).alias("ts"), "event_type", "session_id", "detail")


def _followed(spark, sf, start):
    """A folder followed twice, half of the lines being there at the first start and the rest at the restart."""
    base = run_dir(spark, "followed")
    lines = I.log_lines(spark, sf)
    for half in (0, 1):
        lines.where(F.col("line_no") % 2 == half).select("value").write.text(f"{base}/in/{half}")
        stream = logs.follow_log(spark, f"{base}/in", start)
        sinks.drain(sinks.write_batches(stream, f"{base}/out", f"{base}/checkpoint"))
    return sinks.read_batches(spark, f"{base}/out", stream.schema)


@query(W("log_lines") + "SELECT value FROM log_lines")
def a8_follow_from_begin(spark, sf):
    return _followed(spark, sf, "begin").select("value")


@query(W("log_lines") + "SELECT value FROM log_lines WHERE line_no % 2 = 1")
def a8_follow_from_end(spark, sf):
    return _followed(spark, sf, "end").select("value")


# Bytes that are no text are an event of their own and spoil no other line.
@query(W("auth_events") + """SELECT event_type, count(*) AS n FROM auth_events GROUP BY event_type
    UNION ALL SELECT 'source_error', count(*) FROM log_lines WHERE line_no % 97 = 0""")
def k1_source_errors(spark, sf):
    base = run_dir(spark, "damaged")
    bad = F.when(F.col("line_no") % 97 == 0, F.concat("value", F.unhex(F.lit("20FFFE")).cast("string"))).otherwise(F.col("value"))
    I.log_lines(spark, sf).select(bad.alias("value")).write.text(f"{base}/in")
    events = live.stream_source_events(logs.follow_log(spark, f"{base}/in"), 2024)
    return _arrived(spark, events, "errors").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT round(epoch(ts) - 7200, 6) AS ts, 'sshd:' || user_id AS session_id FROM events
    WHERE ts - INTERVAL 2 HOUR >= TIMESTAMP '2024-01-12 12:00:00' - INTERVAL 1440 MINUTE""")
def a9_read_journal_export(spark, sf):
    path = run_dir(spark, "journal")
    journal_lines(spark, sf).select("value").write.text(path)
    now = F.lit("2024-01-12 12:00:00+00:00").cast("timestamp")
    return logs.read_journal_export(spark, path, now, 1440, ["sshd"]).select(F.round(times.epoch(F.col("ts")), 6).alias("ts"), "session_id")


@query("""SELECT p_partkey || '.c' AS file, '-I' || p_brand || '|-DNAME=' || p_name || '|' || p_partkey || '.c' AS args FROM part""")
def a13_compile_arguments(spark, sf):
    key = F.col("p_partkey").cast("string")
    command = F.concat(F.lit("cc -c -o "), key, F.lit(".o -o"), key, F.lit(".x -I"), F.col("p_brand"), F.lit(' "-DNAME='), F.col("p_name"), F.lit('" '), key, F.lit(".c"))
    entries = table(spark, sf, "part").select(F.concat(key, F.lit(".c")).alias("file"), command.alias("command"), F.lit(None).cast("array<string>").alias("arguments"))
    # The value after a bare -o stays, as it is an argument of its own.
    found = documents.compile_arguments(entries)
    rest = F.filter("args", lambda a: ~a.endswith(".o"))
    return found.select("file", F.array_join(rest, "|").alias("args"))


@query(W("code_files") + f"""SELECT path, kind, label, CAST(line AS BIGINT) AS line FROM
    (SELECT path, line, {_by_language('kind')} AS kind, {_by_language('label')} AS label FROM {_lines_sql('code_files', 'ext, name, path')} WHERE {_CODE_SQL}) WHERE kind IS NOT NULL""")
def l1_extract_symbols_in_sql(spark, sf):
    """The table function for SQL users, joined laterally to the files."""
    extract.register_sql_function(spark)
    I.code_files(spark, sf).createOrReplaceTempView("rendered_code_files")
    return spark.sql("SELECT f.path, s.kind, s.label, CAST(s.line AS BIGINT) AS line FROM rendered_code_files f, LATERAL extract_symbols(f.ext, f.raw) s")


@query(W("code_files") + f""", hits AS (SELECT {_by_language('kind')} AS kind FROM {_lines_sql('code_files', 'ext, name')} WHERE {_CODE_SQL})
    SELECT 'files' AS stage, count(*) AS n FROM code_files UNION ALL SELECT 'symbols', count(*) FROM hits WHERE kind IS NOT NULL""")
def l4_observed_progress(spark, sf):
    """How many files were read and symbols found, told by the writing itself: nothing is read twice."""
    told = {}
    files = sinks.reported(I.code_files(spark, sf), "files", told.__setitem__)
    symbols = sinks.reported(extract.extract_symbols(files.table), "symbols", told.__setitem__)
    symbols.table.select("id", "kind", "label").write.parquet(run_dir(spark, "observed"))
    for stage in (files, symbols):
        stage.tell()
    return spark.createDataFrame(list(told.items()), "stage string, n long")


# A language whose symbols cannot be told from one file: each file's first word with the number of files that begin with it.
@query("""SELECT 'file::d/' || doc_id || '.toy' AS file_id, 'word' AS kind, w || ':' || count(*) OVER (PARTITION BY w) AS label
    FROM (SELECT doc_id, split_part(coalesce(text, ''), ' ', 1) AS w FROM documents)""")
def l2_whole_tree_language(spark, sf):
    def nodes(files):
        word = files.select("path", F.substring_index("raw", " ", 1).alias("word"))
        met = word.join(own_shuffle(word.groupBy("word").agg(F.count(F.lit(1)).alias("n"))), "word")
        label = F.concat_ws(":", "word", F.col("n").cast("string"))
        return met.select(F.concat_ws("::", F.lit("toy"), "path").alias("id"), F.lit("word").alias("kind"), label.alias("label"), F.lit(1).alias("line"),
                          F.concat(F.lit("file::"), F.col("path")).alias("file_id"))

    path = F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".toy"))
    raw = F.coalesce("text", F.lit(""))
    files = tree.files_from_paths(table(spark, sf, "documents").select(
        F.lit("docs").alias("repo"), path.alias("path"), F.lit("").alias("url"), F.length(raw).cast("long").alias("size"), raw.alias("raw")))
    extract.register_language("toy", [".toy"], nodes)
    try:
        return extract.extract_symbols(files).select("file_id", "kind", "label")
    finally:
        extract.unregister_language("toy")


@query("SELECT DISTINCT lang AS language, source AS token FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def a10_lexicons_by_listing(spark, sf):
    """A lexicon file per language of the documents, found by the listing and loaded one by one."""
    folder, fs_path = run_dir(spark, "lexicons"), spark._jvm.org.apache.hadoop.fs.Path
    group = F.struct(F.lit("sources").alias("name"), F.array_sort(F.collect_set(F.struct(F.col("source").alias("token")))).alias("tokens"))
    layer = F.struct(F.lit(0).alias("ordinal"), F.lit("all").alias("name"), F.array(group).alias("groups"))
    known = table(spark, sf, "documents").where("lang IS NOT NULL AND source IS NOT NULL").groupBy(F.col("lang").alias("language")).agg(F.array(layer).alias("layers"))
    known.select(F.col("language").alias("file"), "language", F.struct("layers").alias("keywords")).repartition("file").write.partitionBy("file").json(f"{folder}/parts")
    files = fs_path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for part in files.globStatus(fs_path(f"{folder}/parts/file=*/part-*")):
        files.rename(part.getPath(), fs_path(f"{folder}/{part.getPath().getParent().getName()[5:]}.json"))
    languages = [r["language"] for r in documents.available_lexicons(spark, folder).collect()]
    loaded = [graph.lexicon_tokens(documents.load_lexicon(spark, language, folder)).select("language", "token") for language in languages]
    return functools.reduce(lambda a, b: a.unionByName(b), loaded)
