import gzip
import os
import shutil

import pytest
from pyspark.sql import functions as F

from graphloom.operators import auth
from graphloom.sources import growing, logs
from graphloom.streaming import auth as live
from graphloom.streaming import sessions, sinks


def line(minute, pid, body):
    return f"Feb 27 14:{minute:02}:01 h sshd[{pid}]: {body}"


class Follower:
    """Runs the stream until it has caught up; each run is a restart from the checkpoint."""

    def __init__(self, spark, tmp_path, **options):
        self.spark, self.folder, self.options = spark, tmp_path / "in", options
        self.out, self.checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
        self.folder.mkdir()

    def stream(self):
        return logs.follow_log(self.spark, str(self.folder), **self.options)

    def run(self):
        stream = self.stream()
        sinks.drain(sinks.write_batches(stream, self.out, self.checkpoint))
        return sinks.read_batches(self.spark, self.out, stream.schema)

    def values(self):
        return sorted(r["value"] for r in self.run().where("error IS NULL").collect())

    def append(self, name, text):
        with open(self.folder / name, "a", encoding="utf-8") as f:
            f.write(text)


def test_appended_lines_arrive_once_after_restarts(spark, tmp_path):
    log = Follower(spark, tmp_path)
    log.append("auth.log", "a\nb\nhalf")
    assert log.values() == ["a", "b"]
    assert log.values() == ["a", "b"]
    log.append("auth.log", " done\nc\n")
    log.append("other.log", "x\r\ny\n")
    assert log.values() == ["a", "b", "c", "half done", "x", "y"]
    assert log.values() == ["a", "b", "c", "half done", "x", "y"]


def test_start_at_the_end_skips_what_is_there(spark, tmp_path):
    log = Follower(spark, tmp_path, start="end")
    log.append("auth.log", "old\n")
    assert log.values() == []
    log.append("auth.log", "new\n")
    log.append("later.log", "from its begin\n")
    assert log.values() == ["from its begin", "new"]


def test_renamed_files_go_on_and_files_begun_anew_are_read_anew(spark, tmp_path):
    log = Follower(spark, tmp_path)
    log.append("auth.log", "1 a\n1 b\n")
    assert log.values() == ["1 a", "1 b"]
    log.append("auth.log", "1 c\n")
    os.rename(log.folder / "auth.log", log.folder / "auth.log.1")
    log.append("auth.log", "2 a\n")
    assert log.values() == ["1 a", "1 b", "1 c", "2 a"]
    # Cut in place: the inode stays, the first line is another.
    with open(log.folder / "auth.log", "w", encoding="utf-8") as f:
        f.write("3 a\n")
    assert log.values() == ["1 a", "1 b", "1 c", "2 a", "3 a"]


def test_damaged_files_give_error_rows_and_lose_no_neighbour(spark, tmp_path):
    log = Follower(spark, tmp_path, compressed=True)
    log.append("good.log", line(1, 1, "Accepted password for a") + "\n")
    whole = gzip.compress(b"".join(f"{line(2, 7, 'session opened for user z')}\n".encode() for _ in range(20_000)), mtime=0)
    (log.folder / "cut.log.gz").write_bytes(whole[: len(whole) // 2])
    (log.folder / "whole.log.gz").write_bytes(gzip.compress(line(3, 8, "Failed password for b").encode()))
    (log.folder / "bytes.log").write_bytes(b"Feb 27 14:01:01 h sshd[3]: Accepted password for \xff\xfe\n")
    events = live.stream_source_events(log.stream(), 2025)
    sinks.drain(sinks.write_batches(events, log.out, log.checkpoint))
    found = sinks.read_batches(spark, log.out, events.schema)
    errors = {os.path.basename(r["file"]): r["detail"] for r in found.where("event_type = 'source_error'").collect()}
    assert set(errors) == {"cut.log.gz", "bytes.log"}
    assert "end-of-stream" in errors["cut.log.gz"] and errors["bytes.log"] == "bytes that are no UTF-8"
    by_file = {os.path.basename(r["file"]): r["n"] for r in found.where("event_type <> 'source_error'").groupBy("file").agg(F.count("*").alias("n")).collect()}
    assert by_file["good.log"] == by_file["whole.log.gz"] == by_file["bytes.log"] == 1
    assert 0 < by_file["cut.log.gz"] < 20_000
    # Told once, not again with every look.
    sinks.drain(sinks.write_batches(events, log.out, log.checkpoint))
    assert sinks.read_batches(spark, log.out, events.schema).where("event_type = 'source_error'").count() == 2
    batch = {os.path.basename(r["file"]) for r in logs.read_source_errors(spark, str(log.folder)).collect()}
    assert batch == set(errors)


def test_a_file_that_may_not_be_read_is_told_once(tmp_path, monkeypatch):
    for name in ("a.log", "b.log"):
        (tmp_path / name).write_text(f"{name} line\n")
    whole = growing._whole_lines

    def guarded(system, found):
        if found.path.endswith("a.log"):
            raise PermissionError("not allowed")
        return whole(system, found)

    monkeypatch.setattr(growing, "_whole_lines", guarded)
    tail = growing._Tail(growing._Options({"path": str(tmp_path)}))
    start, end = tail.initialOffset(), tail.latestOffset()
    pieces = tail.partitions(start, end)
    assert sorted((os.path.basename(p.path), p.error) for p in pieces) == [("a.log", "not allowed"), ("b.log", None)]
    rows = [r for p in pieces for b in tail.read(p) for r in b.to_pylist()]
    assert sorted((os.path.basename(r["file"]), r["value"], r["error"]) for r in rows) == [("a.log", None, "not allowed"), ("b.log", "b.log line", None)]
    assert [p.path for p in tail.partitions(end, tail.latestOffset())] == [""]
    monkeypatch.undo()
    assert [os.path.basename(p.path) for p in tail.partitions(end, tail.latestOffset())] == ["a.log"]


def test_a_missing_folder_is_an_error_row(spark, tmp_path):
    rows = logs.read_source_errors(spark, str(tmp_path / "none")).collect()
    assert [r["error"].split(":")[0] for r in rows] == ["cannot list"]


@pytest.mark.parametrize("size", [1, 3, 7, 64])
def test_pieces_of_any_size_hold_every_line_once(spark, tmp_path, size):
    text = "one\n\ntwo two\nthree\r\nfür\n" + "x" * 50 + "\n\nlast"
    (tmp_path / "a.log").write_bytes(text.encode())
    reader = spark.read.format(growing.register(spark)).option("partitionBytes", size).load(str(tmp_path))
    rows = sorted((r["pos"], r["value"]) for r in reader.collect())
    assert [v for _, v in rows] == ["one", "", "two two", "three", "für", "x" * 50, "", "last"]
    assert [text.encode()[p:].decode()[: len(v)] for p, v in rows] == [v for _, v in rows]


def test_lines_are_numbered_without_shuffling_them(spark, tmp_path):
    want = {}
    for name, n in (("big.log", 5000), ("small.log", 3), ("empty.log", 0)):
        rows = [f"{name} {i} {'z' * (i % 90)}" for i in range(n)]
        (tmp_path / name).write_text("\n".join(rows) + ("\n" if n else ""))
        want[name] = {i + 1: r for i, r in enumerate(rows)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = logs.read_log_lines(spark, str(tmp_path))
        plan = lines._jdf.queryExecution().executedPlan().toString()
        found = {}
        for r in lines.collect():
            found.setdefault(os.path.basename(r["file"]), {})[r["line_no"]] = r["value"]
        parts = spark.read.text(str(tmp_path / "big.log")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == {k: v for k, v in want.items() if v}
    assert parts > 5
    exchanges = [x for x in plan.splitlines() if "Exchange" in x and "BroadcastExchange" not in x]
    assert not any("value" in x for x in exchanges)


def events_of(spark, rows):
    lines = spark.createDataFrame([(r, "f", i) for i, r in enumerate(rows)], "value string, file string, line_no long")
    return auth.parse_auth_lines(lines, 2025).withColumnRenamed("line_no", "seq")


def test_sessions_end_by_closing_or_silence_and_state_is_freed(spark, tmp_path):
    day = ["00", "10", "20", "30", "40", "50"]
    stamp = lambda h, m: f"Feb 27 {h:02}:{m}:00 h sshd"
    rows = [f"{stamp(1, day[i % 6])}[{i % 30}]: Accepted password for u{i}" for i in range(120)]
    rows += [f"{stamp(2, '00')}[{i}]: session closed for user u{i}" for i in range(10)]
    # Later events of others move the watermark on; some session ids come back after their end.
    rows += [f"{stamp(9, '00')}[{i}]: Failed password for v{i}" for i in range(5)] + [f"{stamp(23, '00')}[99]: pam_start()"]
    parts = [rows[80:120], rows[:80], rows[120:130], rows[130:]]
    (tmp_path / "in").mkdir()
    for i, part in enumerate(parts):
        (tmp_path / "in" / f"{i}.log").write_text("\n".join(part) + "\n")
    stream = logs.tail_log(spark, str(tmp_path / "in"), per_trigger=1)
    events = live.stream_auth_events(stream, 2025).withColumn("seq", F.xxhash64("raw"))
    query = sinks.write_stateful(sessions.ended_sessions(events, 3600, "2 hours"), str(tmp_path / "out"), str(tmp_path / "cp"))
    sinks.drain(query)
    schema = sessions.ended_sessions(events, 3600, "2 hours").schema
    found = sinks.read_batches(spark, str(tmp_path / "out"), schema).drop("batch").collect()
    batch = events_of(spark, rows).withColumn("seq", F.xxhash64("raw"))
    by_key = {}
    for e in sorted(batch.collect(), key=lambda e: (e["ts"], e["seq"])):
        if e["ts"].day == 27 and e["ts"].hour < 21:
            by_key.setdefault(e["session_id"], []).append((int(e["ts"].timestamp() * 1e6), e["seq"], e["service"], e["user"], e["rhost"], e["event_type"]))
    want = []
    for key, some in by_key.items():
        over, held = sessions.take(key, None, some, 3600 * 10**6, sessions.CLOSING)
        want += over + ([sessions.summary(key, held, "silence")] if held else [])
    got = [(r["session_id"], r["service"], r["user"], r["rhost"], r["event_count"], int(r["start_ts"].timestamp() * 1e6), int(r["end_ts"].timestamp() * 1e6), r["result"], r["ended_by"])
           for r in found]
    assert sorted(got) == sorted(want)
    assert {r[-1] for r in got} == {"closing", "silence"}
    counts = sessions.state_rows(query)
    assert counts[-1] < max(counts)


def test_taking_events_cuts_at_silence_and_closing():
    at = lambda s, kind="x": (s * 10**6, s, "sshd", f"u{s}", "", kind)
    over, held = sessions.take("k", None, [at(1), at(5, "access_granted"), at(20), at(21, "session_close"), at(22)], 10 * 10**6, ("session_close",))
    assert [(o[4], o[7], o[8]) for o in over] == [(2, "granted", "silence"), (2, "unknown", "closing")]
    assert held[0] == held[1] == 22 * 10**6


def test_rotation_by_copy_keeps_lines_apart(spark, tmp_path):
    log = Follower(spark, tmp_path)
    log.append("auth.log", "same first line\nb\n")
    shutil.copy(log.folder / "auth.log", log.folder / "copy.log")
    assert log.values() == ["b", "b", "same first line", "same first line"]


class HeldState:
    """A state variable in memory, with the messages it was sent."""

    def __init__(self):
        self.rows, self.asked = [], 0

    def _told(self, rows):
        self.asked, self.rows = self.asked + 1, rows

    def exists(self):
        self.asked += 1
        return bool(self.rows)

    def get(self):
        self.asked += 1
        return iter(self.rows) if self.listed else (self.rows[0] if self.rows else None)

    def update(self, row):
        self._told([row])

    def put(self, rows):
        self._told(list(rows))

    def appendList(self, rows):
        self._told(self.rows + list(rows))

    def clear(self):
        self._told([])


def test_events_of_a_key_wait_as_one_row():
    import json

    import pandas as pd

    class Handle:
        def __init__(self):
            self.states, self.timers = {}, set()

        def _state(self, name, listed):
            self.states[name] = HeldState()
            self.states[name].listed = listed
            return self.states[name]

        def getListState(self, name, schema):
            return self._state(name, True)

        def getValueState(self, name, schema):
            return self._state(name, False)

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.discard(at)

    class Passed:
        def getCurrentWatermarkInMs(self):
            return 50_000

    handle, work = Handle(), sessions.Sessions(10 * 10**6, ("session_close",))
    work.init(handle)
    kinds = ["session_close" if i % 20 == 19 else "x" for i in range(100)]
    rows = [dict(at=i * 10**6, seq=i, service="sshd", user=None, rhost="ü\"", event_type=k) for i, k in enumerate(kinds)]
    part = pd.DataFrame(rows).assign(session_id="k", event=[json.dumps(r) for r in rows])
    assert list(work.handleInputRows(("k",), iter([part]), Passed())) == [] and handle.timers == {0}
    assert len(handle.states["waiting"].rows) == 1 and sum(s.asked for s in handle.states.values()) <= 4
    handle.timers.clear()
    over = [o for frame in work.handleExpiredTimer(("k",), Passed(), None) for text in frame["over"] for o in json.loads(text)]
    assert [(o["event_count"], o["rhost"], o["user"], o["ended_by"]) for o in over] == [(20, "ü\"", None, "closing")] * 2
    assert len(handle.states["waiting"].rows) == 1 and handle.timers == {51_000}
    assert handle.states["open"].rows[0][7] == 11 and sum(s.asked for s in handle.states.values()) <= 9
