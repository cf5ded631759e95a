import datetime as dt

import pytest
from pyspark.sql import functions as F

from graphloom.operators import auth, filters, ranking

HEAD = "Feb 27 14:32:01 myhost sshd[12345]: "
LINES = {
    "accepted": HEAD + "Accepted password for alice from 192.168.1.10 port 22 ssh2",
    "failed": HEAD + "Failed password for alice from 192.168.1.10 port 22 ssh2",
    "invalid": HEAD + "Invalid user bob from 10.0.0.1 port 51234",
    "open": HEAD + "pam_unix(sshd:session): session opened for user alice by (uid=0)",
    "close": HEAD + "pam_unix(sshd:session): session closed for user alice",
    "fields": HEAD + "pam_unix(sshd:auth): authentication failure; logname= uid=0 euid=0 tty=ssh ruser= rhost=192.168.1.10 user=alice",
    "module": HEAD + "pam_sss.so(sshd:auth): authentication failure; logname= uid=0 rhost=192.168.1.10 user=alice",
    "cache": "Feb 27 14:32:01 myhost sssd[12345]: pam_sss.so: cache hit for user alice",
    "journal": "2025-02-27T14:32:01.123456+00:00 myhost sshd[12345]: Accepted publickey for carol from 10.1.2.3 port 43210 ssh2",
    "journal_z": "2025-02-27T14:32:01Z myhost sshd[12345]: pam_unix(sshd:auth): authentication failure; rhost=10.1.2.3 user=carol",
    "sudo": "Feb 27 14:35:00 myhost sudo[99999]: alice : TTY=pts/0 ; PWD=/home/alice ; USER=root ; COMMAND=/bin/bash",
    "kerberos": HEAD + "Kerberos TGT accepted for alice",
    "krb_call": HEAD + "krb5 AS-REQ sent",
    "unsuccessful": HEAD + "login unsuccessful",
    "end": HEAD + "pam_end() PAM_AUTH_ERR",
    "sssd_call": "Feb 27 14:32:01 myhost sssd[7]: doing work",
    "bad_date": "Feb 31 14:32:01 myhost sshd[1]: Accepted",
}
DROPPED = ["Feb 27 14:32:01 myhost crond[1234]: (CRON) INFO (pidfile fd = 3)", "", "   ", "this is not a log line at all"]


@pytest.fixture(scope="module")
def events(spark):
    rows = [(line, name, i) for i, (name, line) in enumerate(LINES.items())] + [(line, "dropped", 100 + i) for i, line in enumerate(DROPPED)]
    lines = spark.createDataFrame(rows, "value string, file string, line_no long")
    return {r["file"]: r for r in auth.parse_auth_lines(lines, 2025).collect()}


@pytest.mark.parametrize("name, expected", [
    ("accepted", dict(event_type="access_granted", success=True, result="PAM_SUCCESS", phase="password", session_id="sshd:12345", user="")),
    ("failed", dict(event_type="access_denied", success=False, result="PAM_AUTH_ERR")),
    ("invalid", dict(event_type="unknown", success=False, user="bob")),
    ("open", dict(event_type="session_open", phase="session", user="alice", success=None)),
    ("close", dict(event_type="session_close", phase="session", user="alice")),
    ("fields", dict(event_type="unknown", success=False, phase="auth", tty="ssh", rhost="192.168.1.10", user="alice", module="")),
    ("module", dict(event_type="module_call", module="pam_sss.so", success=False)),
    ("cache", dict(event_type="sssd_cache", success=True, service="sssd", detail="pam_sss.so: cache hit for user alice")),
    ("journal", dict(event_type="access_granted", ts=dt.datetime(2025, 2, 27, 14, 32, 1, 123456))),
    ("journal_z", dict(user="carol", rhost="10.1.2.3", ts=dt.datetime(2025, 2, 27, 14, 32, 1))),
    ("sudo", dict(user="root", tty="pts/0", service="sudo", pid=99999)),
    ("kerberos", dict(event_type="access_granted")),
    ("krb_call", dict(event_type="krb_call")),
    ("unsuccessful", dict(success=True)),
    ("end", dict(event_type="access_denied")),
    ("sssd_call", dict(event_type="sssd_call", success=None)),
    ("bad_date", dict(ts=None)),
])
def test_event_fields(events, name, expected):
    got = events[name].asDict()
    # Collected timestamps come in the machine's zone; all times here are UTC.
    if isinstance(expected.get("ts"), dt.datetime):
        got["ts"] = got["ts"].astimezone(dt.timezone.utc).replace(tzinfo=None)
    assert {k: got[k] for k in expected} == expected


def test_unrelated_lines_are_dropped(events):
    assert "dropped" not in events


def test_bad_date_becomes_now_when_given(spark):
    line = spark.createDataFrame([(LINES["bad_date"], "f", 1)], "value string, file string, line_no long")
    now = F.lit("2025-01-01 00:00:00+00:00").cast("timestamp")
    assert auth.parse_auth_lines(line, 2025, now=now).where(F.col("ts") == now).count() == 1


def test_rejects_complement_events(spark):
    rows = [(v, "f", i) for i, v in enumerate([*LINES.values(), *DROPPED])]
    lines = spark.createDataFrame(rows, "value string, file string, line_no long")
    rejected = {r["raw"] for r in auth.rejected_lines(lines).collect()}
    assert rejected == {DROPPED[0], DROPPED[3]}


@pytest.fixture(scope="module")
def sessions(spark):
    rows = [("s2", "pam_start", "", "", 2000, 1), ("s2", "access_granted", "zoe", "h", 2001, 2), ("s3", "pam_start", "a", "", 3000, 3),
            ("s3", "access_denied", "b", "", 3001, 4), ("s4", "pam_start", "", "", 4000, 5), ("s5", "access_denied", "", "", 5000, 6),
            ("s5", "access_granted", "", "", 5100, 7)]
    df = spark.createDataFrame(rows, "session_id string, event_type string, user string, rhost string, t long, seq long")
    return df.withColumn("ts", F.timestamp_seconds("t")).withColumn("service", F.lit("sshd"))


def test_session_summary(sessions):
    got = {r["session_id"]: r for r in auth.session_summary(sessions).collect()}
    assert {k: r["result"] for k, r in got.items()} == {"s2": "granted", "s3": "denied", "s4": "unknown", "s5": "granted"}
    assert (got["s2"]["event_count"], got["s2"]["user"], got["s2"]["rhost"], got["s3"]["user"]) == (2, "zoe", "h", "a")


def test_no_sessions_of_no_events(sessions):
    assert auth.session_summary(sessions.where("false")).count() == 0


def test_replay_offsets_are_capped(sessions):
    got = {(r["session_id"], r["seq"]): r["offset"] for r in auth.replay_schedule(sessions).collect()}
    assert got[("s5", 6)] == 0 and got[("s5", 7)] == pytest.approx(10) and got[("s2", 2)] == pytest.approx(1 / 3)


def test_log_status_lists_last_sessions_in_order(sessions):
    row = auth.log_status(sessions, last=2).first()
    assert (row["recent_event_count"], row["session_count"], row["session_ids"]) == (7, 4, ["s4", "s5"])


def test_cutoff_bounds(sessions):
    now = F.timestamp_seconds(F.lit(5100))
    for minutes in (0, 99999):
        with pytest.raises(ValueError):
            filters.time_cutoff(sessions, now, minutes)
    assert filters.time_cutoff(sessions, now, 1440).count() == 7
    assert filters.time_cutoff(sessions, now, 2).count() == 2


def test_recent_sessions_newest_first(sessions):
    assert [r["session_id"] for r in ranking.recent_sessions(sessions, 2).collect()] == ["s5", "s4"]


def test_component_states(spark):
    rows = [("pam_start", "", None, None, 1), ("module_call", "pam_sss.so", "account", None, 2), ("module_result", "pam_unix.so", "auth", False, 3),
            ("sssd_result", "", None, True, 4), ("module_call", "pam_foo.so", None, None, 5)]
    df = spark.createDataFrame(rows, "event_type string, module string, phase string, success boolean, seq long").withColumn("ts", F.timestamp_seconds("seq"))
    got = {r["component"]: r["state"] for r in auth.latest_component_states(df).collect()}
    assert got == {"app": "active", "pamconf": "active", "libpam": "active", "mod_sss_ac": "active", "mod_unix_a": "failed", "sssd": "success",
                   "sssd_nss": "active"}
    ended = df.withColumn("event_type", F.when(F.col("seq") == 5, "pam_end").otherwise(F.col("event_type")))
    assert {r["state"] for r in auth.latest_component_states(ended).collect()} == {"idle"}


def test_silence_ends_a_session(spark):
    seconds = [0, 50, 149, 249, 250, 351, 1000]
    rows = [("a", t, i, f"u{i}") for i, t in enumerate(seconds)] + [("b", 20, 90, "")]
    df = spark.createDataFrame(rows, "session_id string, t long, seq long, user string").select(
        "*", F.timestamp_seconds("t").alias("ts"), F.lit("sshd").alias("service"), F.lit("").alias("rhost"), F.lit("unknown").alias("event_type"))
    got = auth.windowed_sessions(df, "100 seconds").withColumns({c: F.unix_seconds(c) for c in ("start_ts", "end_ts")})
    assert sorted((r["session_id"], r["start_ts"], r["end_ts"], r["event_count"], r["user"]) for r in got.collect()) == [
        ("a", 0, 149, 3, "u0"), ("a", 249, 250, 2, "u3"), ("a", 351, 351, 1, "u5"), ("a", 1000, 1000, 1, "u6"), ("b", 20, 20, 1, "")]
