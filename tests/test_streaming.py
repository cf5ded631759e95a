import time

from pyspark.sql import functions as F

from graphloom.operators import auth
from graphloom.plans.code_graph import build_graph
from graphloom.schemas import FILES
from graphloom.sources import logs
from graphloom.streaming import auth as live
from graphloom.streaming import graph as live_graph
from graphloom.streaming import sinks


def line(minute, pid, body):
    return f"Feb 27 14:{minute:02}:01 h sshd[{pid}]: {body}"


def test_log_folder_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        events = live.stream_auth_events(logs.tail_log(spark, str(tmp_path / "in")), 2025)
        sinks.drain(sinks.write_batches(events, out, checkpoint))
        return sinks.read_batches(spark, out, events.schema)

    (tmp_path / "in" / "auth.log").write_text(line(1, 1, "Accepted password for a") + "\nnot a line\n")
    assert run().count() == 1
    # After rotation a new file appears; what was read is not read again.
    (tmp_path / "in" / "auth.log.1").write_text(line(2, 1, "session opened for user a") + "\n" + line(3, 2, "Failed password for b") + "\n")
    written = run()
    assert {(r["batch"], r["event_type"]) for r in written.collect()} == {(0, "access_granted"), (1, "session_open"), (1, "access_denied")}


def test_session_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    bodies = ["pam_start()", "Accepted password for user a", "session opened for user a", "Failed password for b"]
    rows = [line(i, i % 3, bodies[i % 4]) for i in range(40)]
    for part in range(4):
        (tmp_path / "in" / f"{part}.log").write_text("\n".join(rows[part * 10:part * 10 + 10]) + "\n")
    events = live.stream_auth_events(logs.tail_log(spark, str(tmp_path / "in"), per_trigger=1), 2025).withColumn("seq", F.xxhash64("raw"))
    summaries = live.stream_sessions(events)
    sinks.drain(sinks.write_batches(summaries, str(tmp_path / "out"), str(tmp_path / "cp"), "update"))
    versions = sinks.read_batches(spark, str(tmp_path / "out"), summaries.schema)
    assert versions.select("batch").distinct().count() >= 4
    lines = spark.createDataFrame([(r, "f", i) for i, r in enumerate(rows)], "value string, file string, line_no long")
    batch = auth.session_summary(auth.parse_auth_lines(lines, 2025).withColumn("seq", F.xxhash64("raw")))
    assert sorted(live.current_sessions(versions).select(batch.columns).collect()) == sorted(batch.collect())


def test_windowed_sessions_end_with_a_silence_of_just_the_gap(spark, tmp_path):
    lines = [f"Feb 27 {at} h sshd[1]: session opened for user a" for at in ("00:00:00", "10:00:00", "19:59:59")]
    lines.append("Feb 29 00:00:00 h sshd[2]: session opened for user b")
    rows = [(x, "f", i) for i, x in enumerate(lines)]
    spark.createDataFrame(rows, "value string, file string, line_no long").write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema("value string, file string, line_no long").parquet(str(tmp_path / "in"))
    events = live.stream_auth_events(arriving, 2024).withColumnRenamed("line_no", "seq")
    done = live.stream_windowed_sessions(events, "10 hours", "1 hour")
    sinks.drain(sinks.write_batches(done, str(tmp_path / "out"), str(tmp_path / "cp")))
    assert sorted(r["event_count"] for r in sinks.read_batches(spark, str(tmp_path / "out"), done.schema).collect()) == [1, 2]


def test_graph_stream_equals_batch(spark, files, tmp_path):
    tree = {"a.py": "import b\nimport os\nclass A:\n    def m(self): pass\n", "p/b.py": "x = 1\n", "p/c.go": "func F(a int) {\n"}
    for i, path in enumerate(tree):
        files({path: tree[path]}).write.parquet(str(tmp_path / "in" / f"part{i}"))
    stream = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    sinks.drain(live_graph.start_graph_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")))
    nodes, edges = live_graph.assemble(spark, str(tmp_path / "out"), FILES, "root")
    want_nodes, want_edges = build_graph(files(tree), "root")
    assert sorted(map(str, nodes.collect())) == sorted(map(str, want_nodes.select(nodes.columns).collect()))
    assert sorted(map(str, edges.collect())) == sorted(map(str, want_edges.select(edges.columns).collect()))


def test_files_that_arrive_together_are_parsed_by_many_tasks(spark, files, tmp_path):
    files({f"p/m{i}.py": "x = 1\n" for i in range(64)}).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FILES).parquet(str(tmp_path / "in"))
    sinks.drain(live_graph.start_graph_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")))
    parsed = spark.read.parquet(str(tmp_path / "out" / "parsed"))
    assert parsed.select("file_id").distinct().count() == 64
    assert parsed.select("_metadata.file_path").distinct().count() > 1


def test_an_arrived_batch_leaves_no_second_copy_of_its_files(spark, files, tmp_path):
    files({f"p/m{i}.py": "x = 1\n" for i in range(8)}).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FILES).parquet(str(tmp_path / "in"))
    sinks.drain(live_graph.start_graph_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")))
    assert not list(tmp_path.glob("cp-dealt/batch=*"))
    assert not spark.sparkContext._jsc.getPersistentRDDs()
    assert all(".zstd." in f.name for f in (tmp_path / "out").glob("*/batch=*/*.parquet"))


def test_progress_is_reported(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.log").write_text("one\ntwo\n")
    seen = []
    listener = sinks.on_progress(spark, lambda name, batch, rows: seen.append(rows))
    try:
        sinks.drain(sinks.write_batches(logs.tail_log(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")))
        for _ in range(50):
            if seen:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert sum(seen) == 2
