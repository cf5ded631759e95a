"""Sessions that end: kept as state per session id, given out once they are over, then forgotten.

Events wait in list state until the watermark has passed them, so they are taken in their own order
however they arrived. What was taken is one folded row. A session is over with a closing event, or
by a silence of `gap`, which an event-time timer notices when nothing more arrives. State holds the
events of the last `late` and one row per open session, never a session's past events. Events of a key
that arrive together are one row of the list: state is asked for by a message, which costs more than an event.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

CLOSING = ("session_close", "pam_end")
_EVENT = ("at", "seq", "service", "user", "rhost", "event_type")
_FOLD = ("start long, end long, service string, user string, rhost string, last_user string, last_rhost string,"
         " n long, granted boolean, denied boolean")
_OUT = "session_id string, service string, user string, rhost string, event_count long, start_us long, end_us long, result string, ended_by string"
_NAMES = [f.split()[0] for f in _OUT.split(", ")]
_OVER = f"array<struct<{_OUT.replace(' ', ':').replace(',:', ',')}>>"
PIECE = 5_000  # events or sessions in one text


def _cut(rows: list) -> list[list]:
    return [rows[i:i + PIECE] for i in range(0, len(rows), PIECE)]


def fold(held: tuple | None, event: tuple) -> tuple:
    """The open session with one more event, which is later than all before."""
    at, _, service, user, rhost, kind = event
    granted, denied = kind == "access_granted", kind == "access_denied"
    if held is None:
        return at, at, service, user, rhost, user, rhost, 1, granted, denied
    start, _, first_service, first_user, first_rhost, _, _, n, was_granted, was_denied = held
    return start, at, first_service, first_user, first_rhost, user, rhost, n + 1, was_granted or granted, was_denied or denied


def summary(key: str, held: tuple, why: str) -> tuple:
    start, end, service, user, rhost, last_user, last_rhost, n, granted, denied = held
    result = "granted" if granted else "denied" if denied else "unknown"
    return key, service, user or last_user, rhost or last_rhost, n, start, end, result, why


def take(key: str, held: tuple | None, events: list[tuple], gap: int, closing: tuple[str, ...]) -> tuple[list[tuple], tuple | None]:
    """Sessions that ordered events bring to an end, and the one still open."""
    over = []
    for event in events:
        if held is not None and event[0] - held[1] >= gap:
            over.append(summary(key, held, "silence"))
            held = None
        held = fold(held, event)
        if event[5] in closing:
            over.append(summary(key, held, "closing"))
            held = None
    return over, held


class Sessions(StatefulProcessor):
    def __init__(self, gap: int, closing: tuple[str, ...]):
        self.gap, self.closing = gap, closing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events string")
        self.open = handle.getValueState("open", _FOLD)
        self.alarm = handle.getValueState("alarm", "at long")

    def _wake(self, now: int | None, at: int | None) -> None:
        """One timer a key, at the millisecond in or after `at` (microseconds); `now` is the one set."""
        at = None if at is None else -(-at // 1000)
        if now == at:
            return
        if now is not None:
            self.handle.deleteTimer(now)
        if at is not None:
            self.handle.registerTimer(at)
            self.alarm.update((at,))
        else:
            self.alarm.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        alarm = self.alarm.get()
        now = None if alarm is None else alarm[0]
        first = [] if now is None else [now * 1000]
        packed = []
        for part in rows:
            packed.append((f"[{','.join(part['event'])}]",))
            first.append(int(part["at"].min()))
        self.waiting.appendList(packed)
        self._wake(now, min(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        # The timer is gone; its state is what is to be replaced.
        waiting = [e for row in self.waiting.get() for e in json.loads(row[0])]
        due = sorted((tuple(map(e.get, _EVENT)) for e in waiting if e["at"] <= passed), key=lambda e: e[:2])
        rest = [e for e in waiting if e["at"] > passed]
        before = self.open.get()
        held = None if before is None else tuple(before)
        over, held = take(key[0], held, due, self.gap, self.closing)
        if held is not None and held[1] + self.gap <= passed:
            over.append(summary(key[0], held, "silence"))
            held = None
        if due:
            if rest:
                self.waiting.put([(json.dumps(part),) for part in _cut(rest)])
            else:
                self.waiting.clear()
        if held is not None:
            self.open.update(held)
        elif before is not None:
            self.open.clear()
        marks = [e["at"] for e in rest] + ([held[1] + self.gap] if held is not None else [])
        if marks:
            self._wake(None, min(marks))
        else:
            self.alarm.clear()
        if over:
            yield pd.DataFrame({"over": [json.dumps([dict(zip(_NAMES, o)) for o in part]) for part in _cut(over)]})

    def close(self) -> None:
        pass


def ended_sessions(events: DataFrame, gap_seconds: int, late: str, closing: tuple[str, ...] = CLOSING, seq: str = "seq") -> DataFrame:
    """One row per finished session, for append mode: its summary and what ended it (`closing` or `silence`).

    Write it with `sinks.write_stateful`.
    Events without time are left out, as are those that arrive more than `late` behind the newest.
    """
    timed = events.where(F.col("ts").isNotNull()).withWatermark("ts", late).select(
        "session_id", "ts", F.unix_micros("ts").alias("at"), F.col(seq).cast("long").alias("seq"), "service", "user", "rhost", "event_type")
    # Three columns go to Python, the event as one text that waits as it is.
    timed = timed.select("session_id", "ts", "at", F.to_json(F.struct(*_EVENT)).alias("event"))
    done = timed.groupBy("session_id").transformWithStateInPandas(Sessions(gap_seconds * 1_000_000, tuple(closing)), "over string", "Append", "EventTime")
    # The sessions of a key come back as texts too, and are rows again on this side.
    done = done.select(F.inline(F.from_json("over", _OVER)))
    return done.select("session_id", "service", "user", "rhost", "event_count", F.timestamp_micros("start_us").alias("start_ts"),
                       F.timestamp_micros("end_us").alias("end_ts"), "result", "ended_by")


def state_rows(query: StreamingQuery) -> list[int]:
    """Rows of state after each batch the query still remembers."""
    return [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress]
