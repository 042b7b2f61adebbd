"""Streams whose state has an order: sessions, workspace, throttled checks, stays in a mode and moods, by transformWithState.

Rows wait in map state until the watermark has passed them, and are then folded in the order of (ts, id) by the steps of the
batch operators. So a stream gives what the batch gives, in whatever order its rows come, as long as they come within the
lateness allowed. Later ones are dropped, as are rows without a time; a row that comes twice (ts and id alike) counts once.
A key has one timer: for its first waiting row, or for the end of what is open. A key's rows are one task's work.

The session's state store must be RocksDB's (STATE_STORE); lorekeep.session sets it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from lorekeep.operators.readmodels import due_step
from lorekeep.operators.state import CALM, CHANGES, DECAY, feel_step, mood, workspace_step

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

Step = Callable[..., tuple[tuple, list[tuple]]]


class InOrder(StatefulProcessor):
    """Folds a key's rows (at in microseconds, id, values) in order behind the watermark.

    step(state, at, id, *values) gives the next state and rows to send. Where ends is given, ends(state) is the time at which
    an open state is over, and its rows are sent and the state forgotten once the watermark is there.
    """

    def __init__(self, values: str, held: str, start: Callable[[], tuple | None], step: Step, ends: Callable[[tuple], int] | None = None, ended: Callable[[tuple], list[tuple]] | None = None):
        # schemas are parsed here, on the driver; workers have no session to do it
        self.values, self.held, self.alarms, self.places = (StructType.fromDDL(x) for x in (values, held, "alarm long, done long", "at long, id long"))
        self.start, self.step, self.ends, self.ended = start, step, ends, ended

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.held)
        self.clock = handle.getValueState("clock", self.alarms)
        self.waiting = handle.getMapState("waiting", self.places, self.values)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.state.update(tuple(initialState[c] for c in self.held.names))
        if self.ends is not None:
            self._set_alarm(None, None, self.ends(self.state.get()))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        alarm, done = self.clock.get() if self.clock.exists() else (None, None)
        first = None
        for r in rows:
            if done is not None and r["at"] <= done:
                continue
            self.waiting.updateValue((r["at"], r["id"]), tuple(r[c] for c in self.values.names))
            first = r["at"] if first is None else min(first, r["at"])
        if first is not None:
            self._set_alarm(alarm, done, first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = [], None
        for place, values in self.waiting.iterator():
            if place[0] <= now:
                due.append((*place, *values))
            else:
                later = place[0] if later is None else min(later, place[0])
        state = self.state.get() if self.state.exists() else self.start()
        sent = []
        for row in sorted(due, key=lambda r: r[:2]):
            state, out = self.step(state, *row)
            sent += out
            self.waiting.removeKey(row[:2])
        end = None
        if state is not None and self.ends is not None:
            end = self.ends(state)
            if end <= now:
                sent += self.ended(state)
                state, end = None, None
        if state is None:
            self.state.clear()
        else:
            self.state.update(tuple(state))
        self.clock.update((None, now))
        upcoming = [t for t in (later, end) if t is not None]
        if upcoming:
            self._set_alarm(None, now, min(upcoming))
        for out in sent:
            yield self.shape(*key, *out)

    def _set_alarm(self, alarm: int | None, done: int | None, at: int) -> None:
        """The key's timer goes off when the watermark has passed at, unless an earlier one is set."""
        ms = at // 1000 + 1
        if alarm is None or ms < alarm:
            if alarm is not None:
                self.handle.deleteTimer(alarm)
            self.handle.registerTimer(ms)
            self.clock.update((ms, done))

    def close(self) -> None:
        pass


def _run(rows: DataFrame, late: str, key: str, columns: list[str], processor: InOrder, output: str, first: DataFrame | None) -> DataFrame:
    timed = rows.where("ts is not null").withWatermark("ts", late).select(key, "ts", F.unix_micros("ts").alias("at"), F.col("id").cast("long").alias("id"), *columns)
    begin = None if first is None else first.groupBy(key)
    sent = StructType.fromDDL(f"{key} string, {output}")
    processor.shape = Row(*sent.names)
    return timed.groupBy(key).transformWithState(processor, sent, "Append", "EventTime", begin)


def session_stream(messages: DataFrame, gap_seconds: int = 7200, late: str = "2 hours", first: DataFrame | None = None) -> DataFrame:
    """person, started, ended, message_count of sessions that are over, from messages (person, ts, id); a gap of gap_seconds ends one.

    first (person, began, until, n; microseconds) holds the sessions that a batch left open.
    """
    gap = gap_seconds * 1_000_000

    def step(state, at, _id, *_):
        if state is None:
            return (at, at, 1), []
        if at - state[1] >= gap:
            return (at, at, 1), [tuple(state)]
        return (state[0], at, state[2] + 1), []

    p = InOrder("seen boolean", "began long, until long, n long", lambda: None, step, lambda s: s[1] + gap, lambda s: [tuple(s)])
    out = _run(messages.withColumn("seen", F.lit(True)), late, "person", ["seen"], p, "began long, until long, n long", first)
    return out.select("person", F.timestamp_micros("began").alias("started"), F.timestamp_micros("until").alias("ended"), F.col("n").alias("message_count"))


def workspace_stream(steps: DataFrame, late: str = "2 hours", first: DataFrame | None = None, **rules: float) -> DataFrame:
    """person, reason, nth, item, priority, age of what leaves the workspace, by the steps of workspace_fold (person, ts, id, item, priority).

    first (person, gone, slots) holds slots of a snapshot and how many left before it.
    """
    move = workspace_step(**rules)
    step = lambda state, at, _id, item, priority: move((state[0], [tuple(x) for x in state[1]]), item, priority)
    p = InOrder("item string, priority double", "gone int, slots array<struct<item: string, priority: double, age: int>>", lambda: (0, []), step)
    return _run(steps, late, "person", ["item", "priority"], p, "reason string, nth int, item string, priority double, age int", first)


def due_stream(checks: DataFrame, interval: dict[str, int], late: str = "2 hours", first: DataFrame | None = None) -> DataFrame:
    """key, id, due of checks (key, ts, id, level), as due_runs tells them; first (key, last; microseconds) holds the last due ones of a batch."""
    tell = due_step(interval)

    def step(state, at, item, level):
        last, out = tell(None if state is None else state[0], at, item, level)
        return (last,), out

    p = InOrder("level string", "last long", lambda: None, step)
    return _run(checks, late, "key", ["level"], p, "id long, due boolean", first)


def mode_stream(transitions: DataFrame, late: str = "2 hours", first: DataFrame | None = None) -> DataFrame:
    """person, mode, started, ended, seconds of stays that are over, from transitions (person, ts, id, mode); as mode_durations without the open one.

    first (person, mode, since; microseconds) holds the modes that are on.
    """

    def step(state, at, _id, mode):
        if state is not None and (state[0] == mode or mode is None):
            return state, []
        return (mode, at), [] if state is None else [(state[0], state[1], at)]

    p = InOrder("mode string", "mode string, since long", lambda: None, step)
    out = _run(transitions, late, "person", ["mode"], p, "mode string, began long, until long", first)
    return out.select("person", "mode", F.timestamp_micros("began").alias("started"), F.timestamp_micros("until").alias("ended"), F.round((F.col("until") - F.col("began")) / 1e6, 1).alias("seconds"))


def mood_stream(events: DataFrame, decay: tuple[float, float, float] = DECAY, late: str = "2 hours", first: DataFrame | None = None) -> DataFrame:
    """person, id, n, valence, arousal, dominance, mood after each event (person, ts, id, dv, da, dd, intensity), as mood_history.

    first (person, n, last, valence, arousal, dominance; last in microseconds) holds the feelings of a snapshot.
    """
    fold = feel_step(decay, True)
    step = lambda state, at, item, *change: fold(state, at, *change, item)
    p = InOrder(", ".join(f"{c} double" for c in CHANGES), "n long, last long, valence double, arousal double, dominance double", lambda: (0, None, *CALM), step)
    rows = events.select("person", "ts", "id", *[F.col(c).cast("double").alias(c) for c in CHANGES])
    out = _run(rows, late, "person", CHANGES, p, "id long, n long, valence double, arousal double, dominance double", first)
    return out.withColumn("mood", mood(F.col("valence"), F.col("arousal"), F.col("dominance")))
