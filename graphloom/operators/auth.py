"""Auth-log lines to typed events, sessions and component states; the parse is stateless columns."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.fixed import auth as A
from graphloom.functions import text, times
from graphloom.operators.ranking import recent_sessions
from graphloom.operators.skew import own_shuffle


_MARK = "\u0001"


def _groups(line: Column, pattern: str, wanted: list[int]) -> Column:
    """Array of the wanted groups of one match, NULL without a match; a single regex pass."""
    marked = F.regexp_replace(line, pattern, "".join(f"{_MARK}${g}" for g in wanted))
    parts = F.split(marked, _MARK, len(wanted) + 1)
    # No header starts with the mark, so a line that does cannot be a match.
    return F.when(marked.startswith(_MARK) & ~line.startswith(_MARK), F.slice(parts, 2, len(wanted)))


def with_headers(lines: DataFrame, year: int, zone: str = "UTC", now: Column | None = None, keep_all: bool = False) -> DataFrame:
    """Lines with ts, service, pid, body and lower-cased body (`low`) of their syslog or journal header.

    Lines without a header are dropped, or kept with NULLs by `keep_all`. `year` completes
    syslog stamps; impossible stamps become `now` if given, else NULL. The fields come out of a
    generator, which later filters are not pushed through, so each pattern runs once per line.
    """
    rest = [c for c in lines.columns if c != "value"]
    missing = F.lit(None).cast("timestamp") if now is None else now
    marked = (
        lines.select(*rest, text.strip(F.col("value")).alias("raw"))
        .withColumn("__s", _groups(F.col("raw"), A.SYSLOG_HEADER, [1, 2, 3, 5, 6, 7]))
        .withColumn("__j", F.when(F.col("__s").isNull(), _groups(F.col("raw"), A.JOURNAL_HEADER, [1, 3, 4, 5])))
    )
    s, j = [F.get(F.col("__s"), F.lit(i)) for i in range(6)], [F.get(F.col("__j"), F.lit(i)) for i in range(4)]

    def fields(ts: Column, service: Column, pid: Column, body: Column) -> Column:
        return F.array(F.struct(F.coalesce(ts, missing).alias("ts"), service.alias("service"), pid.try_cast("int").alias("pid"),
                                body.alias("body"), F.lower(body).alias("low")))

    head = F.when(F.col("__s").isNotNull(), fields(times.syslog_time(s[0], s[1], s[2], year, zone), s[3], s[4], s[5])).when(
        F.col("__j").isNotNull(), fields(times.iso_time(j[0], zone), j[1], j[2], j[3]))
    return marked.select(*rest, "raw", (F.inline_outer if keep_all else F.inline)(head))


SIGNS = [*A.WORDINGS, "cache"]


def signs(low: Column) -> dict[str, Column]:
    """What the lower-cased body says: plain substring tests, a regex only behind one."""
    def says(wordings: list[str]) -> Column:
        return functools.reduce(lambda a, b: a | b, [low.contains(w) for w in wordings])

    found = {name: says(wordings) for name, wordings in A.WORDINGS.items()}
    return {**found, "cache": low.contains("cache") & low.rlike(A.CACHE)}


def _extract(body: Column, low: Column, must_hold: str, pattern: str) -> Column:
    """First group of a pattern, '' without a match; the regex only runs where its keyword occurs."""
    return F.when(low.contains(must_hold), F.regexp_extract(body, pattern, 1)).otherwise("")


def is_relevant(service: Column, low: Column, sign: dict[str, Column]) -> Column:
    return (
        low.contains("pam") | low.contains("sssd") | F.lower(service).contains("sssd") | service.isin(A.ALWAYS_KEPT_SERVICES)
        | sign["ok"] | sign["bad"] | sign["opened"] | sign["closed"]
    )


def phase(low: Column, sign: dict[str, Column]) -> Column:
    chain = F.when((sign["opened"] | sign["closed"]) & ~(sign["started"] | sign["ended"]), F.lit("session"))
    for name, pattern in A.PHASE_WORDS:
        chain = chain.when(low.contains(name) & low.rlike(pattern), name)
    return chain


def event_type(service: Column, body: Column, low: Column, module: Column, sign: dict[str, Column]) -> Column:
    """First rule that applies; a success or failure wording may then override it."""
    of_sssd = low.contains("sssd") | F.lower(service).contains("sssd")
    asks = low.contains("request") | body.contains("AS-REQ")
    base = (
        F.when(sign["started"], "pam_start").when(sign["ended"], "pam_end")
        .when(sign["opened"], "session_open").when(sign["closed"], "session_close")
        .when(sign["cache"], "sssd_cache")
        .when(of_sssd, F.when(sign["ok"] | sign["bad"], "sssd_result").otherwise("sssd_call"))
        .when(sign["kerberos"], F.when(asks, "krb_call").otherwise("krb_result"))
        .when(module != "", "module_call").otherwise("unknown")
    )
    granted = sign["ok"] & (sign["ended"] | low.contains("granted") | low.contains("accepted"))
    denied = ~sign["ok"] & sign["bad"] & (sign["ended"] | low.contains("failed password"))
    return F.when(granted, "access_granted").when(denied, "access_denied").otherwise(base)


def success(low: Column, sign: dict[str, Column]) -> Column:
    """True, False or NULL; a success wording is looked for before a failure wording."""
    cached = sign["cache"] & ~(sign["started"] | sign["ended"] | sign["opened"] | sign["closed"])
    return F.when(sign["ok"], True).when(sign["bad"], False).when(cached, low.contains("hit"))


def parse_auth_lines(lines: DataFrame, year: int, zone: str = "UTC", now: Column | None = None) -> DataFrame:
    """Typed events of the lines in `value`; unrelated and malformed lines are dropped."""
    return type_events(with_headers(lines, year, zone, now))


def rejected_lines(lines: DataFrame, year: int = 1970) -> DataFrame:
    """The lines `parse_auth_lines` drops, blank ones aside."""
    headed = with_headers(lines, year, keep_all=True)
    bad = F.col("body").isNull() | ~is_relevant(F.col("service"), F.col("low"), signs(F.col("low")))
    return headed.where((F.col("raw") != "") & bad).drop("ts", "service", "pid", "body", "low")


def events_and_errors(lines: DataFrame, year: int, zone: str = "UTC", now: Column | None = None) -> DataFrame:
    """The events of `parse_auth_lines`, and a `source_error` event for every row whose `error` says what could not be read."""
    headed = with_headers(lines, year, zone, now, keep_all=True)
    failed = F.col("error").isNotNull()
    events = type_events(headed, failed)
    return events.withColumns({"event_type": F.when(failed, "source_error").otherwise(F.col("event_type")),
                               "detail": F.coalesce("error", "detail")}).drop("error")


def type_events(headed: DataFrame, also: Column | None = None) -> DataFrame:
    """Relevant events with all their columns, from service, pid and body; rows that `also` names are kept too."""
    body, low, service = F.col("body"), F.col("low"), F.col("service")
    rest = [c for c in headed.columns if c not in ("raw", "ts", "service", "pid", "body", "low")]
    module = _extract(body, low, "pam_", A.MODULE)
    found = F.struct(
        F.when(module != "", F.concat(F.lit("pam_"), module, F.lit(".so"))).otherwise("").alias("module"),
        *[sign.alias(f"__{name}") for name, sign in signs(low).items()])
    signed = headed.select("*", F.inline(F.array(found)))
    sign = {name: F.col(f"__{name}") for name in SIGNS}
    relevant = is_relevant(service, low, sign)
    return signed.where(relevant if also is None else relevant | also).select(
        *rest, "ts", "raw", event_type(service, body, low, F.col("module"), sign).alias("event_type"), "service",
        F.rtrim(_extract(body, low, "user", A.USER), F.lit(")")).alias("user"),
        _extract(body, low, "rhost", A.RHOST).alias("rhost"),
        _extract(body, low, "tty", A.TTY).alias("tty"),
        "pid", phase(low, sign).alias("phase"), "module", F.lit("").alias("control"),
        F.when(sign["ok"], "PAM_SUCCESS").when(sign["bad"], "PAM_AUTH_ERR").otherwise("").alias("result"),
        success(low, sign).alias("success"), body.alias("detail"),
        F.concat_ws(":", service, F.col("pid").cast("string")).alias("session_id"),
    )


def session_summary(events: DataFrame, keys: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """One row per session: first service, first-or-last user and host, span, count, outcome.

    An order-carrying aggregate, so partial results combine before the shuffle and a session
    holding a third of the events is no burden.
    """
    at = F.struct("ts", seq)
    kind = F.col("event_type")

    def first_or_last(c: str) -> Column:
        return text.or_else(F.min_by(c, at), F.max_by(c, at))

    return events.groupBy(*(keys or ["session_id"])).agg(
        F.min_by("service", at).alias("service"),
        first_or_last("user").alias("user"),
        first_or_last("rhost").alias("rhost"),
        F.count(F.lit(1)).alias("event_count"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.when(F.bool_or(kind == "access_granted"), "granted").when(F.bool_or(kind == "access_denied"), "denied")
        .otherwise("unknown").alias("result"),
    )


def windowed_sessions(events: DataFrame, gap: str, seq: str = "seq") -> DataFrame:
    """Sessions that also end after a silence of `gap`, so a reused pid starts a new one.

    Events of one key in one time cell of width `gap` always share a session. They are folded
    into one row per cell first, map-side, so that only cells, and never a hot key's events,
    meet in the window that looks for silences.
    """
    zero = F.timestamp_seconds(F.lit(0))
    width = F.unix_micros(zero + F.expr(f"INTERVAL '{gap}'"))
    at, kind = F.struct("ts", seq), F.col("event_type")
    who = F.struct("service", "user", "rhost")
    cells = events.groupBy("session_id", F.floor(F.unix_micros("ts") / width).alias("cell")).agg(
        F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.min_by(who, at).alias("first"), F.max_by(who, at).alias("last"),
        F.count(F.lit(1)).alias("n"), F.bool_or(kind == "access_granted").alias("granted"), F.bool_or(kind == "access_denied").alias("denied"))
    by_time = Window.partitionBy("session_id").orderBy("cell")
    silence = F.unix_micros("first_at.ts") - F.unix_micros(F.lag("last_at.ts").over(by_time))
    numbered = cells.withColumn("starts", F.when(silence < width, 0).otherwise(1)).withColumn("part", F.sum("starts").over(by_time))

    def first_or_last(c: str) -> Column:
        return text.or_else(F.min_by(f"first.{c}", "first_at"), F.max_by(f"last.{c}", "last_at"))

    return numbered.groupBy("session_id", "part").agg(
        F.min_by("first.service", "first_at").alias("service"), first_or_last("user").alias("user"), first_or_last("rhost").alias("rhost"),
        F.sum("n").alias("event_count"), F.min("first_at.ts").alias("start_ts"), F.max("last_at.ts").alias("end_ts"),
        F.when(F.bool_or("granted"), "granted").when(F.bool_or("denied"), "denied").otherwise("unknown").alias("result"),
    ).drop("part")


def replay_schedule(events: DataFrame, seq: str = "seq", longest: float = 30.0, speed: float = 3.0) -> DataFrame:
    """Offset in seconds of each event from its session's first, capped and sped up."""
    first = events.groupBy("session_id").agg(F.min(F.struct("ts", seq)).alias("f"))
    offset = times.epoch(F.col("ts")) - times.epoch(F.col("f.ts"))
    return events.join(own_shuffle(first), "session_id").withColumn("offset", F.least(offset, F.lit(longest)) / F.lit(speed)).drop("f")


def log_status(events: DataFrame, seq: str = "seq", last: int = 20) -> DataFrame:
    """One row: events, sessions, and the last session ids in order of arrival."""
    ids = recent_sessions(events, last, seq).agg(
        F.array_sort(F.collect_list(F.struct("first_seq", "session_id"))).alias("s"))
    return events.agg(F.count(F.lit(1)).alias("recent_event_count"), F.countDistinct("session_id").alias("session_count")).select(
        "*", ids.select(F.transform("s", lambda x: x["session_id"])).scalar().alias("session_ids"))


def module_component(module: Column, phase_: Column) -> Column:
    """Component of a module file; two of them have one component per phase."""
    low = F.lower(module)
    rules = []
    for fragments, usual, account in A.MODULE_COMPONENTS:
        hit = functools.reduce(lambda a, b: a | b, [low.contains(f) for f in fragments])
        rules.append(F.when(hit, F.when(phase_ == "account", account).otherwise(usual)))
    return F.coalesce(*rules)


def component_states(events: DataFrame) -> DataFrame:
    """(component, state) rows each event causes; the end of a transaction resets all to idle."""
    own = module_component(F.col("module"), F.col("phase"))
    ok = F.coalesce(F.col("success"), F.lit(False))

    def row(component: str, good: str, bad: str) -> Column:
        name = own if component == "*" else F.lit(component)
        state = F.lit(good) if good == bad else F.when(ok, good).otherwise(bad)
        return F.struct(name.alias("component"), state.alias("state"))

    effects = F.when(F.col("event_type") == "pam_end",
                     F.array(*[F.struct(F.lit(c).alias("component"), F.lit("idle").alias("state")) for c in A.COMPONENTS]))
    for kind, rules in A.COMPONENT_RULES.items():
        effects = effects.when(F.col("event_type") == kind, F.array(*[row(*r) for r in rules]))
    return events.select("*", F.inline(effects)).where(F.col("component").isNotNull())


def latest_component_states(events: DataFrame, seq: str = "seq") -> DataFrame:
    at = F.struct("ts", seq)
    return component_states(events).groupBy("component").agg(F.max_by("state", at).alias("state"))
