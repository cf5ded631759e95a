"""Live auth logs: events, rejects, sessions, recent events, component states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import auth
from graphloom.operators.ranking import last_wins, recent_n


def stream_auth_events(lines: DataFrame, year: int, zone: str = "UTC") -> DataFrame:
    """The batch parse on a stream of lines: stateless, so it is the same operator."""
    return auth.parse_auth_lines(lines, year, zone)


def stream_source_events(lines: DataFrame, year: int, zone: str = "UTC") -> DataFrame:
    """Events, and errors of the source as events of their own, out of one reading of a `follow_log` stream."""
    return auth.events_and_errors(lines, year, zone)


def stream_rejects(lines: DataFrame) -> DataFrame:
    """Lines the event stream drops; run as a second query with its own sink."""
    return auth.rejected_lines(lines)


def stream_sessions(events: DataFrame, seq: str = "seq") -> DataFrame:
    """Running session summaries, for update mode; readers keep the newest version per session."""
    return auth.session_summary(events, ["session_id"], seq)


def current_sessions(versions: DataFrame) -> DataFrame:
    return last_wins(versions, ["session_id"], "batch").drop("batch")


def stream_windowed_sessions(events: DataFrame, gap: str, late: str, seq: str = "seq") -> DataFrame:
    """Sessions finished by a silence of `gap`, for append mode; state is dropped once they are out."""
    timed = events.withWatermark("ts", late)
    # Spark joins windows that touch, but a silence of just `gap` ends a session too.
    window = F.session_window("ts", f"{gap} -1 microseconds")
    return auth.session_summary(timed, ["session_id", window], seq).drop("session_window")


def recent(written: DataFrame, limit: int = 2000, seq: str = "seq") -> DataFrame:
    """The newest events of the table the event stream appends to."""
    return recent_n(written, limit, seq)


def stream_components(events: DataFrame, seq: str = "seq") -> DataFrame:
    """Running (component, state) with its time, for update mode; 18 keys of state."""
    at = F.struct("ts", seq)
    return auth.component_states(events).groupBy("component").agg(F.max_by("state", at).alias("state"), F.max(at).alias("at"))


def current_components(versions: DataFrame) -> DataFrame:
    return last_wins(versions, ["component"], "batch").select("component", "state")
