"""Streaming queries: the given tables arrive as a file stream, run to its end, and are read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.fixed import languages as L
from graphloom.functions import times
from graphloom.operators import auth
from graphloom.plans import inputs as I
from graphloom.plans.code_graph import build_graph
from graphloom.plans.queries_files import _CODE_SQL, _by_language, _lines_sql
from graphloom.plans.queries_layout import TAU, _rounded, _xy
from graphloom.plans.registry import query, table
from graphloom.session import run_dir, shuffles_dropped
from graphloom.streaming import auth as live
from graphloom.streaming import dependencies, sessions, sinks
from graphloom.streaming import graph as live_graph
from graphloom.streaming.graph import CTables

W = I.with_inputs


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream of files."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _arrived(spark: SparkSession, stream: DataFrame, purpose: str, mode: str = "append") -> DataFrame:
    """Run a stream to its end and read what it wrote, with the batch number."""
    base = run_dir(spark, purpose)
    sinks.drain(sinks.write_batches(stream, f"{base}/out", f"{base}/checkpoint", mode))
    return sinks.read_batches(spark, f"{base}/out", stream.schema)


def _live_events(spark: SparkSession, sf: str) -> DataFrame:
    return live.stream_auth_events(I.render_lines(_stream(spark, sf, "events")), 2024).withColumnRenamed("line_no", "seq")


@query(W("auth_events") + "SELECT seq, epoch(ts) AS ts, event_type, session_id FROM auth_events")
def k1_stream_auth_events(spark, sf):
    return _arrived(spark, _live_events(spark, sf), "events").select("seq", times.epoch(F.col("ts")).alias("ts"), "event_type", "session_id")


@query(W("auth_events") + "SELECT line_no, value AS raw FROM log_lines WHERE line_no NOT IN (SELECT seq FROM auth_events)")
def k1_stream_rejects(spark, sf):
    return _arrived(spark, live.stream_rejects(I.render_lines(_stream(spark, sf, "events"))), "rejects").select("line_no", "raw")


@query(W("sessions") + "SELECT * FROM sessions")
def k2_stream_sessions(spark, sf):
    """Running summaries in update mode; the newest version of each session counts."""
    versions = _arrived(spark, live.stream_sessions(_live_events(spark, sf)), "sessions", "update")
    return live.current_sessions(versions).withColumns({c: times.epoch(F.col(c)) for c in ("start_ts", "end_ts")})


@query(W("auth_events") + "SELECT seq, event_type FROM auth_events ORDER BY seq DESC LIMIT 2000")
def k3_stream_recent(spark, sf):
    return live.recent(_arrived(spark, _live_events(spark, sf), "recent"), 2000).select("seq", "event_type")


# Only sessions that the watermark has passed are out: their silence ended an hour before the last event.
@query(W("auth_events") + """, g AS (
      SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts, seq) AS part FROM
        (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch(ts) - epoch(lag(ts) OVER w) >= 36000 THEN 1 ELSE 0 END AS new FROM auth_events WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq)))
    SELECT session_id, epoch(min(ts)) AS start_ts, epoch(max(ts)) AS end_ts, count(*) AS event_count FROM g GROUP BY session_id, part
    HAVING epoch(max(ts)) + 36000 <= (SELECT epoch(max(ts)) - 3600 FROM auth_events)""")
def k4_stream_windowed_sessions(spark, sf):
    found = _arrived(spark, live.stream_windowed_sessions(_live_events(spark, sf), "10 hours", "1 hour"), "windowed")
    return found.select("session_id", times.epoch(F.col("start_ts")).alias("start_ts"), times.epoch(F.col("end_ts")).alias("end_ts"), "event_count")


# Events up to the watermark, an hour before the last; a session ends with a closing event or ten hours of silence.
@query(W("auth_events") + """, w AS (SELECT floor(epoch(max(ts)) * 1000) / 1000 - 3600 AS mark FROM auth_events), g AS (
      SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts, seq) AS part FROM
        (SELECT *, CASE WHEN lag(ts) OVER o IS NULL OR epoch(ts) - epoch(lag(ts) OVER o) >= 36000 OR lag(event_type) OVER o IN ('session_close', 'pam_end') THEN 1 ELSE 0 END AS new
         FROM auth_events, w WHERE epoch(ts) <= mark WINDOW o AS (PARTITION BY session_id ORDER BY ts, seq)))
    SELECT session_id, epoch(min(ts)) AS start_ts, epoch(max(ts)) AS end_ts, count(*) AS event_count,
      CASE WHEN bool_or(event_type = 'access_granted') THEN 'granted' WHEN bool_or(event_type = 'access_denied') THEN 'denied' ELSE 'unknown' END AS result,
      CASE WHEN bool_or(event_type IN ('session_close', 'pam_end')) THEN 'closing' ELSE 'silence' END AS ended_by FROM g GROUP BY session_id, part
    HAVING bool_or(event_type IN ('session_close', 'pam_end')) OR epoch(max(ts)) + 36000 <= (SELECT mark FROM w)""")
def k2_ended_sessions(spark, sf):
    """Sessions given out by timers and closing events; their state is gone."""
    base = run_dir(spark, "ended")
    ended = sessions.ended_sessions(_live_events(spark, sf), 36_000, "1 hour")
    sinks.drain(sinks.write_stateful(ended, f"{base}/out", f"{base}/checkpoint"))
    found = sinks.read_batches(spark, f"{base}/out", ended.schema)
    return found.select("session_id", times.epoch(F.col("start_ts")).alias("start_ts"), times.epoch(F.col("end_ts")).alias("end_ts"), "event_count", "result", "ended_by")


@query(W("component_rows") + "SELECT component, arg_max(state, CAST(epoch_us(ts) AS HUGEINT) * 100000000 + seq) AS state FROM component_rows GROUP BY component")
def k10_component_stream(spark, sf):
    return live.current_components(_arrived(spark, live.stream_components(_live_events(spark, sf)), "components", "update"))


# ---- graphs -------------------------------------------------------------------------------

_GRAPH_CTE = ["code_files", "py_files"]
_SYMBOLS = f"""symbols AS (SELECT path, kind, count(*) AS n FROM (SELECT *, {_by_language("kind")} AS kind FROM {_lines_sql("code_files", "ext, name, path")} WHERE {_CODE_SQL})
      WHERE kind IS NOT NULL GROUP BY path, kind)"""
_KINDS = _SYMBOLS + """, folders AS (SELECT count(DISTINCT b) + 2 AS n FROM py_files), files AS (SELECT (SELECT count(*) FROM code_files) + (SELECT count(*) FROM py_files) AS n)
    SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM (
      SELECT kind, n FROM symbols UNION ALL SELECT 'directory', n FROM folders UNION ALL SELECT 'file', n FROM files UNION ALL SELECT 'external_module', (SELECT count(DISTINCT b) + 1 FROM py_files)
      UNION ALL SELECT unnest(['module', 'import', 'import', 'import', 'import', 'class', 'function', 'function']), count(*) FROM py_files) GROUP BY kind"""


def _all_files(files: DataFrame, code: DataFrame) -> DataFrame:
    return files.unionByName(code)


@query(W(*_GRAPH_CTE) + ", " + _KINDS)
def p_build_graph(spark, sf):
    """The whole batch job: folders, files, symbols, Python parse, imports."""
    nodes, _ = build_graph(_all_files(I.py_files(spark, sf), I.code_files(spark, sf)), "code")
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _graph_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select(F.lit("node").alias("part"), "id", F.col("label").alias("other"), "kind").unionByName(
        edges.select(F.lit("edge").alias("part"), F.col("src").alias("id"), F.col("dst").alias("other"), "kind"))


# Row by row: the template's symbols by hand, everything else from the paths and lines.
_GRAPH_ROWS = f"""hits AS (SELECT path, ext, kind, label, CASE ext {" ".join(f"WHEN '{e}' THEN '{lang}'" for lang, (exts, _) in L.SYMBOL_RULES.items() for e in exts)} END
        || '::' || path || '::' || kind || '::' || label || '::' || line AS id
      FROM (SELECT *, {_by_language("kind")} AS kind, {_by_language("label")} AS label FROM {_lines_sql("code_files", "ext, name, path")} WHERE {_CODE_SQL}) WHERE kind IS NOT NULL),
    paths AS (SELECT path, string_split(path, '/')[2] AS b, string_split(path, '/')[-1] AS name FROM (SELECT path FROM code_files UNION ALL SELECT path FROM py_files)),
    py_symbols AS (SELECT path, n, unnest([n, b || '.helper', b || '.Other', 'None.sibling', 'C_' || n, 'run', 'f_' || n, 'Other']) AS label,
      unnest(['module', 'import', 'import', 'import', 'class', 'function', 'function', 'import']) AS kind FROM py_files),
    py_edges AS (SELECT path, unnest([n || '.' || n, n || '.' || n, n || '.' || n, n || '.' || n, n || '.C_' || n, n || '.' || n, n || '.' || n]) AS src,
      unnest([n || '.' || b || '.helper', n || '.' || b || '.Other', n || '.None.sibling', n || '.C_' || n, n || '.run', n || '.f_' || n, n || '.Other']) AS dst,
      unnest(['imports', 'imports', 'imports', 'contains', 'contains', 'contains', 'imports']) AS kind FROM py_files)
    SELECT 'node' AS part, 'dir::' AS id, 'code' AS other, 'directory' AS kind UNION ALL SELECT 'node', 'dir::src', 'src', 'directory'
    UNION ALL SELECT DISTINCT 'node', 'dir::src/' || b, b, 'directory' FROM paths
    UNION ALL SELECT 'node', 'file::' || path, name, 'file' FROM paths UNION ALL SELECT 'node', id, label, kind FROM hits
    UNION ALL SELECT 'node', path || '::' || n || '.' || label, label, kind FROM py_symbols
    UNION ALL SELECT DISTINCT 'node', 'external::' || unnest(['os', b]), unnest(['os', b]), 'external_module' FROM py_files
    UNION ALL SELECT 'edge', 'dir::', 'dir::src', 'contains' UNION ALL SELECT DISTINCT 'edge', 'dir::src', 'dir::src/' || b, 'contains' FROM paths
    UNION ALL SELECT 'edge', 'dir::src/' || b, 'file::' || path, 'contains' FROM paths UNION ALL SELECT 'edge', 'file::' || path, id, 'contains' FROM hits
    UNION ALL SELECT 'edge', 'file::' || path, path || '::' || n || '.' || n, 'contains' FROM py_files
    UNION ALL SELECT 'edge', path || '::' || src, path || '::' || dst, kind FROM py_edges
    UNION ALL SELECT 'edge', 'file::' || path, 'external::' || unnest(['os', b]), 'depends_on' FROM py_files"""


@query(W(*_GRAPH_CTE) + ", " + _GRAPH_ROWS)
def p_build_graph_rows(spark, sf):
    """Every node and edge of the batch build."""
    return _graph_rows(*build_graph(_all_files(I.py_files(spark, sf), I.code_files(spark, sf)), "code"))


# A C tree: sources by nation, headers by part size (the last of a stem in path order counts), errors where a supplier is in debt.
@query(W("c_decls", "call_sites") + """, c_files AS (
      SELECT 'c/s' || n_nationkey || '.c' AS path FROM nation UNION ALL SELECT DISTINCT 'h/p' || p_size || '.h' FROM part UNION ALL SELECT DISTINCT 'a/p' || p_size || '.c' FROM part WHERE p_size % 3 > 0
      UNION ALL SELECT DISTINCT 'os/winnt/p' || p_size || '.h' FROM part WHERE p_size % 2 = 0),
    named AS (SELECT path, string_split(path, '/')[-1] AS name, split_part(string_split(path, '/')[-1], '.', 1) AS stem, left(path, length(path) - length(string_split(path, '/')[-1]) - 1) AS folder FROM c_files),
    owner AS (SELECT stem, max(path) AS path FROM named WHERE folder <> 'os/winnt' GROUP BY stem),
    warned AS (SELECT DISTINCT 's' || s_nationkey AS file FROM supplier WHERE s_acctbal < 0),
    edges AS (
      SELECT 'dir::' AS src, 'dir::' || unnest(['a', 'c', 'h', 'os']) AS dst, 'contains' AS kind, 1.0 AS weight UNION ALL SELECT 'dir::os', 'dir::os/winnt', 'contains', 1.0
      UNION ALL SELECT 'dir::' || folder, 'file::' || path, 'contains', 1.0 FROM named
      UNION ALL SELECT 'file::' || o.path, d.id, 'contains', 1.0 FROM c_decls d JOIN owner o ON o.stem = d.file WHERE d.kind NOT IN ('field', 'enum_constant')
      UNION ALL SELECT m.parent_id, m.id, 'field_of', 1.0 FROM c_decls m JOIN c_decls p ON p.id = m.parent_id WHERE m.kind = 'field' OR (m.kind = 'enum_constant' AND p.kind = 'enum')
      UNION ALL SELECT src, dst, 'calls', least(3.0, 0.5 + 0.4 * count(*)) FROM call_sites GROUP BY src, dst
      UNION ALL SELECT u.id, s.id, 'type_of', 0.6 FROM c_decls u JOIN c_decls s ON s.kind = 'struct' AND u.type_str = 'const struct ' || s.name || ' *' WHERE u.kind IN ('field', 'variable')
      UNION ALL SELECT u.id, s.id, 'aliases', 0.8 FROM c_decls u JOIN c_decls s ON s.kind IN ('struct', 'enum', 'union') AND u.type_str = 'struct ' || s.name WHERE u.kind = 'typedef')
    SELECT 'edge' AS part, src AS id, dst AS other, kind, CAST(round(weight, 6) AS DOUBLE) AS value FROM edges
    UNION ALL SELECT 'node', id, name, kind, CASE WHEN kind IN ('field', 'enum_constant') THEN 3.0 ELSE 2.0 END + CASE WHEN file IN (SELECT file FROM warned) THEN 0.5 ELSE 0.0 END FROM c_decls
    UNION ALL SELECT 'node', 'file::' || path, name, 'file', 1.0 FROM named
    UNION ALL SELECT 'node', 'dir::' || f, CASE f WHEN '' THEN 'tree' WHEN 'os/winnt' THEN 'winnt' ELSE f END, 'directory', 0.0 FROM (SELECT unnest(['', 'a', 'c', 'h', 'os', 'os/winnt']) AS f)""")
def p_build_c_graph(spark, sf):
    """Declarations, members, calls, types and warnings of a C tree in the built graph, every node and edge."""
    tables = CTables(I.full_c_decls(spark, sf), I.call_sites(spark, sf), table(spark, sf, "supplier").where("s_acctbal < 0").select(
        F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("file")))
    nodes, edges = build_graph(I.c_files(spark, sf), "tree", depth=3, c=tables)
    value = F.col("depth") + F.when(F.col("has_parse_warning"), 0.5).otherwise(0.0)
    return nodes.select(F.lit("node").alias("part"), "id", F.col("label").alias("other"), "kind", value.alias("value")).unionByName(
        edges.select(F.lit("edge").alias("part"), F.col("src").alias("id"), F.col("dst").alias("other"), "kind", F.round("weight", 6).alias("value")))


def _streamed(spark: SparkSession, sf: str) -> str:
    """Let the rendered source files arrive as a stream; returns the folder of its tables."""
    base = run_dir(spark, "graph")
    with shuffles_dropped(spark):
        _all_files(I.py_files(spark, sf), I.code_files(spark, sf)).write.option("compression", "zstd").parquet(f"{base}/in")
    arriving = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")
    sinks.drain(live_graph.start_graph_stream(arriving, f"{base}/out", f"{base}/checkpoint"))
    return f"{base}/out"


@query(W(*_GRAPH_CTE) + ", " + _KINDS)
def k5_stream_graph(spark, sf):
    """Structure and symbols per micro-batch, dependencies once all files are in: the same graph."""
    out = _streamed(spark, sf)
    nodes, _ = live_graph.assemble(spark, out, I.py_files(spark, sf).schema, "code")
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(W(*_GRAPH_CTE) + ", " + _GRAPH_ROWS)
def k5_stream_graph_rows(spark, sf):
    """Every node and edge of the graph that arrived as a stream."""
    return _graph_rows(*live_graph.assemble(spark, _streamed(spark, sf), I.py_files(spark, sf).schema, "code"))


@query(W("import_rows", "import_stems") + """, r AS (SELECT DISTINCT i.file_id AS src, s.file_id AS dst, i.module FROM import_rows i LEFT JOIN import_stems s ON s.stem = string_split(module, '.')[-1])
    SELECT DISTINCT src, CASE WHEN dst IS NULL OR dst = src THEN 'external::' || string_split(module, '.')[1] ELSE dst END AS dst, 'depends_on' AS kind FROM r""")
def k5_stream_dependencies(spark, sf):
    """Imports and files arrive mixed, in four parts; the changes of edges add up to those of a batch build."""
    base = run_dir(spark, "dependencies")
    known = I.import_files(spark, sf).select(F.lit(None).cast("string").alias("file_id"), "stem", "path", F.lit(None).cast("string").alias("module"))
    asked = I.import_rows(spark, sf).distinct().select("file_id", *[F.lit(None).cast("string").alias(c) for c in ("stem", "path")], "module")
    mixed = known.unionByName(asked)
    each = max(1, spark.sparkContext.defaultParallelism // 4)  # files of a part, which are written side by side
    mixed.repartition(4 * each, F.coalesce("file_id", "path")).write.parquet(f"{base}/in")
    rows = spark.readStream.schema(mixed.schema).option("maxFilesPerTrigger", each).parquet(f"{base}/in")
    arriving = dependencies.arrivals(rows.where("path IS NOT NULL").select("stem", "path"), rows.where("module IS NOT NULL").select("file_id", "module"))
    changes = dependencies.edge_changes(arriving)
    sinks.drain(sinks.write_stateful(changes, f"{base}/out", f"{base}/checkpoint"))
    return dependencies.current_edges(sinks.read_batches(spark, f"{base}/out", changes.schema)).select("src", "dst", "kind")


@query(W(*_GRAPH_CTE) + ", " + _SYMBOLS + """
    SELECT 'file::' || f.path AS file_id, CAST(coalesce(s.n, 0) AS BIGINT) AS symbols FROM (SELECT path FROM code_files UNION ALL SELECT path FROM py_files) f
    LEFT JOIN (SELECT path, sum(n) AS n FROM symbols GROUP BY path) s USING (path)""")
def k9_progress_by_file(spark, sf):
    out = _streamed(spark, sf)
    symbols = spark.read.parquet(f"{out}/symbols")
    return live_graph.progress_by_file(symbols, sinks.read_batches(spark, f"{out}/files", I.py_files(spark, sf).schema))


@query(W("numbered") + f"SELECT id, {_xy(f'100 * cos({TAU} * i / n)', f'100 * sin({TAU} * i / n)')} FROM numbered")
def k6_reposition(spark, sf):
    """Nodes arrive with no place; once the stream is over the layout runs on the complete graph."""
    base = run_dir(spark, "reposition")
    I.tree_nodes(spark, sf).write.parquet(f"{base}/in")
    arriving = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")
    sinks.drain(sinks.write_batches(arriving, f"{base}/out", f"{base}/checkpoint"))
    nodes = sinks.read_batches(spark, f"{base}/out", arriving.schema)
    return _rounded(live_graph.reposition(nodes, I.tree_edges(spark, sf)))


@query(W("auth_events") + "SELECT event_type, count(*) AS n FROM auth_events WHERE event_type IN ('access_granted', 'access_denied') GROUP BY event_type")
def p_auth_outcomes(spark, sf):
    """Logins granted and denied, straight from the lines."""
    wanted = auth.parse_auth_lines(I.log_lines(spark, sf), 2024).where(F.col("event_type").isin("access_granted", "access_denied"))
    return wanted.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
