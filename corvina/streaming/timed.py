"""Streams with timers: out-of-order and late pieces, keyed state that ends by event time.

State is kept by transformWithState (RocksDB store, set by with_store()); it holds only requests and sessions that are
still live, as each has a timer at its last event plus a gap, and the timer's call clears all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corvina.streaming.events import SESSION_TURNS

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(spark: SparkSession) -> None:
    """Set the state store that timers and lists need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _millis(gap: str) -> int:
    return int(pd.Timedelta(gap).total_seconds() * 1000)


class _Timed(StatefulProcessor):
    """A key's whole state as one value, the first of it the time of its latest event, and its one timer, that plus gap.

    Each call of a state is a round trip to the JVM, so a key's rows of a batch are read first, and then its value is written once.
    """

    state: str

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", "latest long, " + self.state)

    def keep(self, old: tuple | None, latest: int, *rest) -> None:
        """Write the value, and move the timer where the latest event is a later one."""
        self.value.update((latest, *rest))
        if old is None or latest != old[0]:
            if old is not None:
                self.handle.deleteTimer(old[0] + self.gap)
            self.handle.registerTimer(latest + self.gap)

    def drop(self, old: tuple | None) -> None:
        """Clear what there was of the key."""
        if old is not None:
            self.handle.deleteTimer(old[0] + self.gap)
            self.value.clear()

    def close(self) -> None:
        pass


class _Deltas(_Timed):
    """The text of a request: deltas in order of seq, those that came early waiting for the ones before them."""

    state = "text string, next long, n long, gaps long, last long, early array<struct<seq: long, delta: string>>"

    @staticmethod
    def _take(text: str, nxt: int, n: int, gaps: int, waiting: dict[int, str], flush: bool) -> tuple[str, int, int, int]:
        """Append what follows without a gap, or all that waits if flush, in order; it leaves waiting."""
        pieces = []
        for seq in sorted(waiting):
            if seq > nxt and not flush:
                break
            gaps += seq - nxt
            nxt, n = seq + 1, n + 1
            pieces.append(waiting.pop(seq))
        return text + "".join(pieces), nxt, n, gaps

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        old = self.value.get()
        latest, text, nxt, n, gaps, last, early = old or (None, "", 0, 0, 0, -1, [])
        waiting = {x[0]: x[1] for x in early}
        for r in rows:
            latest = r.ms if latest is None else max(latest, r.ms)
            if r.seq >= nxt:
                waiting[r.seq] = (r.delta or "") if r.event == "delta" else ""
            if r.event == "done":
                last = r.seq
        text, nxt, n, gaps = self._take(text, nxt, n, gaps, waiting, False)
        if last >= 0 and nxt > last:
            self.drop(old)
            yield Row(request_id=key[0], text=text, n_events=n, n_missing=gaps, finished=True)
        else:
            self.keep(old, latest, text, nxt, n, gaps, last, list(waiting.items()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        old = self.value.get()
        _, text, nxt, n, gaps, _, early = old
        text, _, n, gaps = self._take(text, nxt, n, gaps, {x[0]: x[1] for x in early}, True)
        self.drop(old)
        yield Row(request_id=key[0], text=text, n_events=n, n_missing=gaps, finished=False)


def ordered_deltas(stream: DataFrame, gap: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """request_id, text, n_events, n_missing and finished: one row for each request of a stream (request_id, seq, event, delta, ts).

    seq counts a request's events from 0. Deltas may come in any order and repeatedly: those ahead of a gap wait, those
    already taken are dropped. A request ends, and its state goes, when all up to its "done" event are there (finished), or
    when the watermark (late behind the newest event) passes its last event by gap; it then gives what there is, in order,
    with the number of events missing between. A piece after the end begins the request anew, unless the watermark drops it.
    """
    with_store(stream.sparkSession)
    rows = stream.select(F.col("request_id").cast("string").alias("request_id"), F.col("seq").cast("long").alias("seq"), "event", "delta", "ts", F.unix_millis("ts").alias("ms"))
    rows = rows.filter("request_id IS NOT NULL AND seq >= 0 AND ts IS NOT NULL").withWatermark("ts", late)
    out = "request_id string, text string, n_events long, n_missing long, finished boolean"
    return rows.groupBy("request_id").transformWithState(_Deltas(_millis(gap)), out, "Append", "EventTime")


class _Sessions(_Timed):
    """The last turns of a session, as a list that is rewritten with at most that many entries."""

    state = "n long, kept array<struct<turn: long, role: string, text: string>>"

    def __init__(self, gap: int, turns: int):
        super().__init__(gap)
        self.turns = turns

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        old = self.value.get()
        latest, n, before = old or (None, 0, [])
        kept = {x[0]: tuple(x) for x in before}
        for r in rows:
            latest = r.ms if latest is None else max(latest, r.ms)
            kept[r.turn] = (r.turn, r.role, r.text)
            if len(kept) > self.turns:
                del kept[min(kept)]
            n += 1
        self.keep(old, latest, n, [kept[t] for t in sorted(kept)])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        old = self.value.get()
        _, n, kept = old
        self.drop(old)
        history = "\n".join(f"{r}: {t}" for _, r, t in kept)
        yield Row(session_id=key[0], n_turns=n, n_kept=len(kept), first_turn=kept[0][0], last_turn=kept[-1][0], history=history)


def expiring_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "5 minutes", turns: int = SESSION_TURNS) -> DataFrame:
    """One row for each session of a stream (session_id, turn, role, text, ts) once it is over.

    session_id, n_turns (events seen), n_kept, first_turn, last_turn and history: the last turns of it by turn, whatever
    the order they came in; a turn that comes twice counts once among them. A session is over when the watermark passes its
    last event by gap; its state goes with the row.
    """
    with_store(stream.sparkSession)
    rows = stream.select(F.col("session_id").cast("long").alias("session_id"), F.col("turn").cast("long").alias("turn"), "role", "text", "ts", F.unix_millis("ts").alias("ms"))
    rows = rows.filter("session_id IS NOT NULL AND turn IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    out = "session_id long, n_turns long, n_kept int, first_turn long, last_turn long, history string"
    return rows.groupBy("session_id").transformWithState(_Sessions(_millis(gap), turns), out, "Append", "EventTime")
