"""Queries over the auth log rendered from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.fixed import auth as A
from graphloom.functions import times
from graphloom.operators import auth, filters, ranking, stats
from graphloom.plans import inputs as I
from graphloom.plans.registry import query, table

W = I.with_inputs


def _epoch(c: str):
    return times.epoch(F.col(c))


@query(W("auth_events") + """
    SELECT seq, epoch(ts) AS ts, event_type, service, "user", rhost, tty, CAST(pid AS BIGINT) AS pid, phase, module, result, success, detail, session_id FROM auth_events""")
def c5_parse_auth_lines(spark, sf):
    events = I.auth_events(spark, sf).withColumn("ts", _epoch("ts")).withColumn("pid", F.col("pid").cast("long"))
    return events.select("seq", "ts", "event_type", "service", "user", "rhost", "tty", "pid", "phase", "module", "result", "success", "detail", "session_id")


@query(W("log_lines") + """
    SELECT line_no, epoch(strptime('2024 ' || regexp_extract(value, '^(\\w{3}\\s+\\d+\\s+\\d{2}:\\d{2}:\\d{2})', 1), '%Y %b %d %H:%M:%S')) AS ts,
           regexp_extract(value, '^\\w{3}\\s+\\d+\\s+\\S+\\s+\\S+\\s+(\\w[\\w/-]*)\\[', 1) AS service, CAST(regexp_extract(value, '\\[(\\d+)\\]:', 1) AS BIGINT) AS pid,
           regexp_extract(value, '\\[\\d+\\]:\\s+(.+)$', 1) AS body FROM log_lines""".replace("\\\\", "\\"))
def c5a_parse_header(spark, sf):
    return auth.with_headers(I.log_lines(spark, sf), 2024).select(
        "line_no", _epoch("ts").alias("ts"), "service", F.col("pid").cast("long").alias("pid"), "body")


# The same events as journal lines with an offset of two hours.
@query("""SELECT event_id AS line_no, round(epoch(ts) - 7200, 6) AS ts, CAST(user_id AS BIGINT) AS pid FROM events""")
def c5a_parse_journal_header(spark, sf):
    return auth.with_headers(journal_lines(spark, sf), 2024).select(
        "line_no", F.round(_epoch("ts"), 6).alias("ts"), F.col("pid").cast("long").alias("pid"))


def journal_lines(spark, sf):
    """The events as journal lines with microseconds and an offset."""
    text = F.col("ts").cast("string")
    stamp = F.replace(F.rpad(F.concat(text, F.when(text.contains("."), "").otherwise(".")), 26, "0"), F.lit(" "), F.lit("T"))
    line = F.concat(stamp, F.lit("+02:00 host sshd["), F.col("user_id").cast("string"), F.lit("]: Accepted"))
    return table(spark, sf, "events").select(line.alias("value"), F.lit("journal").alias("file"), F.col("event_id").alias("line_no"))


# Months and days out of the events' hours: many are no calendar day and give NULL.
@query("""
    SELECT event_id AS line_no, CASE WHEN m <= 12 AND d >= 1 AND d <= CASE WHEN m IN (4, 6, 9, 11) THEN 30 WHEN m = 2 THEN 29 ELSE 31 END
                                THEN epoch(make_timestamp(2024, m, d, 1, 2, 3)) END AS ts
    FROM (SELECT event_id, CAST(1 + hour(ts) // 2 AS BIGINT) AS m, CAST(minute(ts) // 2 + 3 AS BIGINT) AS d FROM events)""")
def c5b_syslog_timestamp(spark, sf):
    e = table(spark, sf, "events")
    month = F.element_at(F.array(*[F.lit(m) for m in A.MONTHS]), F.floor(F.hour("ts") / 2).cast("int") + 1)
    day = (F.floor(F.minute("ts") / 2) + 3).cast("string")
    return e.select(F.col("event_id").alias("line_no"), times.epoch(times.syslog_time(month, day, F.lit("01:02:03"), 2024)).alias("ts"))


@query(W("auth_events") + "SELECT \"user\", rhost, tty, module, count(*) AS n FROM auth_events GROUP BY ALL")
def c5c_auth_fields(spark, sf):
    return I.auth_events(spark, sf).groupBy("user", "rhost", "tty", "module").agg(F.count(F.lit(1)).alias("n"))


@query(W("auth_events") + "SELECT phase, event_type, count(*) AS n FROM auth_events GROUP BY ALL")
def c5d_c5e_phase_and_type(spark, sf):
    return I.auth_events(spark, sf).groupBy("phase", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(W("auth_events") + "SELECT event_type, success, result, count(*) AS n FROM auth_events GROUP BY ALL")
def c5f_outcome(spark, sf):
    return I.auth_events(spark, sf).groupBy("event_type", "success", "result").agg(F.count(F.lit(1)).alias("n"))


@query(W("auth_events") + "SELECT DISTINCT session_id FROM auth_events")
def c5g_session_ids(spark, sf):
    return I.auth_events(spark, sf).select("session_id").distinct()


@query(W("auth_events") + "SELECT line_no, value AS raw FROM log_lines WHERE line_no NOT IN (SELECT seq FROM auth_events)")
def b8_auth_relevance(spark, sf):
    """The lines that are not kept."""
    return auth.rejected_lines(I.log_lines(spark, sf), 2024).select("line_no", "raw")


@query(W("auth_events") + "SELECT seq, event_type FROM auth_events WHERE ts >= TIMESTAMP '2024-01-12 12:00:00' - INTERVAL 1440 MINUTE")
def b9_time_cutoff(spark, sf):
    return filters.time_cutoff(I.auth_events(spark, sf), F.lit("2024-01-12 12:00:00+00:00").cast("timestamp"), 1440).select("seq", "event_type")


_MODULES = "CASE " + " ".join(
    f"WHEN {' OR '.join(f_ for f_ in [f'''contains(lower(module), '{x}')''' for x in fragments])} THEN CASE WHEN phase = 'account' THEN '{account}' ELSE '{usual}' END"
    for fragments, usual, account in A.MODULE_COMPONENTS) + " END"


@query(W("auth_events") + f"SELECT component, count(*) AS n FROM (SELECT {_MODULES} AS component FROM auth_events) GROUP BY component")
def c7_event_component(spark, sf):
    return I.auth_events(spark, sf).groupBy(auth.module_component(F.col("module"), F.col("phase")).alias("component")).agg(F.count(F.lit(1)).alias("n"))


I.CTE["component_rows"] = (["auth_events"], "SELECT seq, ts, component, state FROM (" + " UNION ALL ".join(
    f"SELECT seq, ts, {_MODULES if c == '*' else repr(c)} AS component, CASE WHEN coalesce(success, FALSE) THEN '{good}' ELSE '{bad}' END AS state FROM auth_events WHERE event_type = '{kind}'"
    for kind, rules in A.COMPONENT_RULES.items() for c, good, bad in rules)
    + " UNION ALL SELECT seq, ts, c, 'idle' FROM auth_events, (VALUES " + ", ".join(f"('{c}')" for c in A.COMPONENTS) + ") t(c) WHERE event_type = 'pam_end'"
    + ") WHERE component IS NOT NULL")


@query(W("component_rows") + "SELECT component, state, count(*) AS n FROM component_rows GROUP BY ALL")
def c8_component_states(spark, sf):
    return auth.component_states(I.auth_events(spark, sf)).groupBy("component", "state").agg(F.count(F.lit(1)).alias("n"))


@query(W("component_rows") + "SELECT component, arg_max(state, CAST(epoch_us(ts) AS HUGEINT) * 100000000 + seq) AS state FROM component_rows GROUP BY component")
def c8_latest_states(spark, sf):
    return auth.latest_component_states(I.auth_events(spark, sf))


I.CTE["sessions"] = (["auth_events"], """
    SELECT session_id, arg_min(service, k) AS service, coalesce(nullif(arg_min("user", k), ''), arg_max("user", k)) AS "user",
           coalesce(nullif(arg_min(rhost, k), ''), arg_max(rhost, k)) AS rhost, count(*) AS event_count, epoch(min(ts)) AS start_ts, epoch(max(ts)) AS end_ts,
           CASE WHEN bool_or(event_type = 'access_granted') THEN 'granted' WHEN bool_or(event_type = 'access_denied') THEN 'denied' ELSE 'unknown' END AS result
    FROM (SELECT *, CAST(epoch_us(ts) AS HUGEINT) * 100000000 + seq AS k FROM auth_events) GROUP BY session_id""")


@query(W("sessions") + "SELECT * FROM sessions")
def e9_session_summary(spark, sf):
    return auth.session_summary(I.auth_events(spark, sf)).withColumns({c: _epoch(c) for c in ("start_ts", "end_ts")})


@query(W("auth_events") + """, s AS (SELECT session_id, min(seq) AS f FROM auth_events GROUP BY 1), l AS (SELECT * FROM s ORDER BY f DESC LIMIT 20)
    SELECT (SELECT count(*) FROM auth_events) AS recent_event_count, (SELECT count(*) FROM s) AS session_count, (SELECT string_agg(session_id, ',' ORDER BY f) FROM l) AS session_ids""")
def e10_log_status(spark, sf):
    return auth.log_status(I.auth_events(spark, sf)).withColumn("session_ids", F.array_join("session_ids", ","))


@query(W("auth_events") + """
    SELECT session_id, arg_min(event_type, k) AS first_event_type, arg_min(detail, k) AS first_detail, arg_max(event_type, k) AS last_event_type, arg_max(detail, k) AS last_detail
    FROM (SELECT *, CAST(epoch_us(ts) AS HUGEINT) * 100000000 + seq AS k FROM auth_events) GROUP BY session_id""")
def f6_first_last(spark, sf):
    return ranking.first_last(I.auth_events(spark, sf), "session_id", "ts", "seq", ["event_type", "detail"])


@query(W("auth_events") + "SELECT seq, event_type FROM auth_events ORDER BY seq DESC LIMIT 2000")
def f7_recent_events(spark, sf):
    return ranking.recent_n(I.auth_events(spark, sf), 2000).select("seq", "event_type")


@query(W("auth_events") + "SELECT session_id, min(seq) AS first_seq FROM auth_events GROUP BY 1 ORDER BY 2 DESC LIMIT 50")
def f8_recent_sessions(spark, sf):
    return ranking.recent_sessions(I.auth_events(spark, sf))


@query(W("auth_events") + """
    SELECT seq, session_id, round(least(epoch(ts) - epoch(first_value(ts) OVER (PARTITION BY session_id ORDER BY ts, seq)), 30) / 3.0, 6) AS "offset" FROM auth_events""")
def f12_replay_schedule(spark, sf):
    return auth.replay_schedule(I.auth_events(spark, sf)).select("seq", "session_id", F.round("offset", 6).alias("offset"))


@query(W("log_lines") + "SELECT file, line_no, value FROM (SELECT 'auth.log' AS file, *, row_number() OVER (ORDER BY line_no DESC) AS r FROM log_lines) WHERE r <= 500")
def f19_tail_lines(spark, sf):
    return ranking.tail_lines(I.log_lines(spark, sf), 500).select("file", "line_no", "value")


@query(W("auth_events") + """, g AS (
      SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts, seq) AS part FROM
        (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch(ts) - epoch(lag(ts) OVER w) >= 36000 THEN 1 ELSE 0 END AS new FROM auth_events WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq)))
    SELECT session_id, epoch(min(ts)) AS start_ts, epoch(max(ts)) AS end_ts, count(*) AS event_count,
           CASE WHEN bool_or(event_type = 'access_granted') THEN 'granted' WHEN bool_or(event_type = 'access_denied') THEN 'denied' ELSE 'unknown' END AS result
    FROM g GROUP BY session_id, part""")
def k4_session_window(spark, sf):
    found = auth.windowed_sessions(I.auth_events(spark, sf), "10 hours")
    return found.select("session_id", _epoch("start_ts").alias("start_ts"), _epoch("end_ts").alias("end_ts"), "event_count", "result")


@query(W("diagnostics") + """
    SELECT doc_id, CASE WHEN contains(lower(message), 'file not found') THEN 'missing_header' WHEN contains(lower(message), 'unknown type') THEN 'unknown_type' ELSE 'other' END AS kind FROM diagnostics""")
def c6_classify_diagnostic(spark, sf):
    return I.diagnostics(spark, sf).select("doc_id", stats.classify_diagnostic(F.col("message")).alias("kind"))


@query(W("diagnostics") + """
    SELECT count(*) FILTER (WHERE contains(lower(message), 'file not found')) AS missing_header, count(*) FILTER (WHERE contains(lower(message), 'unknown type')) AS unknown_type,
           count(*) FILTER (WHERE contains(message, 'expected')) AS other, count(DISTINCT file) AS files_with_warnings FROM diagnostics""")
def e11_diagnostics_summary(spark, sf):
    return stats.diagnostics_summary(I.diagnostics(spark, sf))


@query(W("diagnostics") + "SELECT file, count(*) AS errors FROM diagnostics GROUP BY file ORDER BY errors DESC, file LIMIT 5")
def e12_worst_files(spark, sf):
    return stats.worst_files(I.diagnostics(spark, sf))
