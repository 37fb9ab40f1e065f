"""Keyed state of the session and alert streams: what is kept of a crossing, its timers, and when it is forgotten.

Both read rows with `t` (ms) whose event-time column has been dropped after the watermark was set: Spark then
keeps the watermark but throws no row away, so that rows which come too late can be told and counted instead.
State is kept by RocksDB, as Spark's stateful processors need.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sessions import BLOCKED, CLEAR, LAPSE, AlertPolicy, SessionPolicy, alert_machine, streaks

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: kind is open, grown, closed or late; of a late row t and event_id are its own.
SESSION_ROWS = "kind string, crossing_id string, started long, ended long, readings long, peak double, version string, t long, event_id long"
ALERT_ROWS = "kind string, crossing_id string, t long, camera_id string, confidence double, event_id long"


class Sessions(StatefulProcessor):
    """A crossing's open session. A timer a millisecond past the gap closes it, and is set anew as it grows."""

    def __init__(self, policy: SessionPolicy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "started long, ended long, readings long, peak double, version string")
        self.due = handle.getValueState("due", "at long")

    def set_timer(self, at: int | None) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()
        if at is not None:
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        now = list(self.session.get()) if self.session.exists() else None
        told = lambda kind, s, t=None, event=None: Row(kind=kind, crossing_id=key[0], started=s[0], ended=s[1], readings=s[2], peak=s[3], version=s[4], t=t, event_id=event)
        for r in sorted(rows, key=lambda r: (r.t, r.event_id)):
            if r.t < mark:
                yield told("late", (None, None, 1, r.confidence, r.version), r.t, r.event_id)
                continue
            if now is not None and r.t - now[1] > self.policy.gap_ms:
                yield told("closed", now)
                now = None
            kind = "open" if now is None else "grown"
            now = [r.t, r.t, 1, r.confidence, r.version] if now is None else [now[0], max(now[1], r.t), now[2] + 1, max(now[3], r.confidence), now[4]]
            yield told(kind, now)
        if now is None:
            return
        due = now[1] + self.policy.gap_ms + 1
        if due > mark:
            self.session.update(tuple(now))
            self.set_timer(due)
        else:
            yield told("closed", now)
            self.session.clear()
            self.set_timer(None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s = self.session.get()
        self.session.clear()
        self.due.clear()
        yield Row(kind="closed", crossing_id=key[0], started=s[0], ended=s[1], readings=s[2], peak=s[3], version=s[4], t=None, event_id=None)

    def close(self) -> None:
        pass


class Alerts(StatefulProcessor):
    """The state of a crossing's alert machine, the one that batches run. A silence resets the machine, so once
    the watermark is past it nothing needs to be kept of the crossing: a timer removes its state."""

    def __init__(self, policy: AlertPolicy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine, self.on = alert_machine(self.policy), streaks(self.policy)
        self.state = handle.getValueState("state", "state int")
        self.heard = handle.getValueState("heard", "t long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        state = self.state.get()[0] if self.state.exists() else self.machine.start
        last = self.heard.get()[0] if self.heard.exists() else None
        if last is not None:
            self.handle.deleteTimer(last + self.policy.silence_ms + 1)
        for r in sorted(rows, key=lambda r: (r.t, r.event_id)):
            if r.t < mark:
                yield Row(kind="late", crossing_id=key[0], t=r.t, camera_id=r.camera_id, confidence=r.confidence, event_id=r.event_id)
                continue
            lapse = last is not None and r.t - last > self.policy.silence_ms
            symbol = (BLOCKED if r.state == "BLOCKED" else CLEAR) + (LAPSE if lapse else 0)
            was, state = state, self.machine.moves[state][symbol]
            if state >= self.on and (was < self.on or symbol == BLOCKED + LAPSE):
                yield Row(kind="alert", crossing_id=key[0], t=r.t, camera_id=r.camera_id, confidence=r.confidence, event_id=r.event_id)
            last = r.t if last is None else max(last, r.t)
        if last is None or last + self.policy.silence_ms + 1 <= mark:
            self.state.clear()
            self.heard.clear()
        else:
            self.state.update((state,))
            self.heard.update((last,))
            self.handle.registerTimer(last + self.policy.silence_ms + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        self.heard.clear()
        return iter(())

    def close(self) -> None:
        pass


def run(rows: DataFrame, processor: StatefulProcessor, fields: str) -> DataFrame:
    """The processor over a stream's rows by crossing, with event-time timers."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return rows.groupBy("crossing_id").transformWithState(processor, fields, "Append", "EventTime")
