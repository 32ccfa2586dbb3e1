"""Streams with timers: order, lateness, repeats, expiry, and the size of what is kept."""

import json
import os
import random

from pyspark.sql import Row

from corvina.streaming import timed

PIECES = "request_id string, seq long, event string, delta string, ts timestamp"
TURNS = "session_id long, turn long, role string, text string, ts timestamp"


def run(spark, tmp_path, batches, schema, make, name):
    """The rows and the progress of a stream that reads one batch after the other."""
    source = tmp_path / "in"
    source.mkdir()
    for i, rows in enumerate(batches):
        (source / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(source / f"{i}.json", (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(200)
        assert query.exception() is None
        return spark.table(name).collect(), query.recentProgress
    finally:
        query.stop()


def piece(request, seq, delta, minute, event="delta"):
    return {"request_id": request, "seq": seq, "event": event, "delta": delta, "ts": f"2024-01-01T{minute // 60:02}:{minute % 60:02}:00"}


def turn(session, number, minute):
    return {"session_id": session, "turn": number, "role": "user", "text": f"t{number}", "ts": f"2024-01-01T{minute // 60:02}:{minute % 60:02}:00"}


def test_deltas_out_of_order_and_repeated(spark, tmp_path):
    """Batches bring a request's pieces in any order, some twice; another's middle never comes."""
    whole = [piece("a", i, f"<{i}>", 1) for i in range(12)] + [piece("a", 12, None, 1, "done")]
    random.Random(3).shuffle(whole)
    batches = [whole[:5], whole[5:9] + whole[:3], whole[9:], [piece("b", 0, "x", 2), piece("b", 3, "z", 3)], [piece("c", 0, "end", 50)], [piece("d", 0, "", 120)]]
    got, progress = run(spark, tmp_path, batches, PIECES, timed.ordered_deltas, "ordered")
    rows = {r.request_id: (r.text, r.n_events, r.n_missing, r.finished) for r in got}
    assert rows["a"] == ("".join(f"<{i}>" for i in range(12)), 13, 0, True)
    assert rows["b"] == ("xz", 2, 2, False) and rows["c"] == ("end", 1, 0, False)
    assert len(got) == 3  # the newest waits for its watermark
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 6  # what is kept is of the one live request


def test_late_pieces_are_dropped(spark, tmp_path):
    """A piece older than the watermark neither changes a request that ended nor begins it anew."""
    batches = [[piece("a", 0, "x", 1)], [piece("b", 0, "y", 100)], [piece("b", 1, "y", 101)], [piece("a", 1, "late", 2), piece("b", 2, None, 102, "done")]]
    got, _ = run(spark, tmp_path, batches, PIECES, timed.ordered_deltas, "late")
    assert sorted((r.request_id, r.text, r.finished) for r in got) == [("a", "x", False), ("b", "yy", True)]


def test_empty_and_null_pieces(spark, tmp_path):
    """Rows without a request, place or time are left out; null deltas are empty."""
    null = piece("a", 0, None, 1) | {"request_id": None}
    batches = [[null, piece("a", -1, "no", 1), piece("a", 0, None, 1), piece("a", 1, None, 1, "done"), piece("e", 0, None, 1, "done")]]
    got, _ = run(spark, tmp_path, batches, PIECES, timed.ordered_deltas, "nulls")
    assert sorted((r.request_id, r.text, r.n_events, r.finished) for r in got) == [("a", "", 2, True), ("e", "", 1, True)]


def test_sessions_end_and_their_state_goes(spark, tmp_path):
    """Many sessions one after the other: each gives its last four turns once, and only live ones are kept."""
    batches = []
    for s in range(6):
        order = [turn(s, t, 100 * s + t) for t in range(7)] + [turn(s, 3, 100 * s + 3)]
        random.Random(s).shuffle(order)
        batches += [order[:4], order[4:]]
    got, progress = run(spark, tmp_path, batches, TURNS, timed.expiring_sessions, "over")
    want = [(s, 8, 4, 3, 6, "\n".join(f"user: t{t}" for t in range(3, 7))) for s in range(5)]
    assert sorted(tuple(r) for r in got) == want
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]) <= 2 * 9


def test_a_session_that_goes_on(spark, tmp_path):
    """A session with less than the gap between its turns is one; with more it is two."""
    batches = [[turn(1, 0, 0)], [turn(1, 1, 20)], [turn(1, 2, 40)], [turn(2, 0, 200)], [turn(2, 1, 201)], [turn(1, 9, 210)], [turn(3, 0, 400)], [turn(3, 1, 401)]]
    got, _ = run(spark, tmp_path, batches, TURNS, timed.expiring_sessions, "goes_on")
    assert [(r.n_turns, r.first_turn, r.last_turn) for r in sorted(got, key=lambda r: r.first_turn) if r.session_id == 1] == [(3, 0, 2), (1, 9, 9)]


class _Handle:
    """One key's states and timers, which counts the calls of them."""

    def __init__(self):
        self.calls, self.values, self.timers = 0, {}, set()

    def getValueState(self, name, schema):  # noqa: N802
        return _Value(self, name)

    getMapState = getListState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.remove(at)


class _Value:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def __getattr__(self, call):
        def run(*args):
            self.handle.calls += 1
            if call in ("update", "clear"):
                self.handle.values[self.name] = args[0] if args else None
            return self.handle.values.get(self.name) if call == "get" else iter(()) if call == "iterator" else call == "exists" and self.handle.values.get(self.name) is not None

        return run


def test_calls_of_state_do_not_grow_with_rows():
    """A key's rows of a batch take a few round trips to its state, however many they are."""
    pieces = [Row(seq=i, event="delta", delta=f"<{i}>", ms=i) for i in range(300)] + [Row(seq=300, event="done", delta=None, ms=300)]
    handle, deltas = _Handle(), timed._Deltas(1000)
    deltas.init(handle)
    assert list(deltas.handleInputRows(("a",), iter(pieces[100:300]), None)) == [] and handle.calls <= 3 and handle.timers == {1299}
    assert [r.text for r in deltas.handleInputRows(("a",), iter(pieces[:100] + pieces[300:]), None)] == ["".join(f"<{i}>" for i in range(300))]
    assert handle.calls <= 6 and not handle.timers and not any(handle.values.values())
    handle, sessions = _Handle(), timed._Sessions(1000, 4)
    sessions.init(handle)
    for part in (range(0, 300, 2), range(1, 300, 2)):
        assert list(sessions.handleInputRows((1,), iter([Row(turn=i, role="user", text="t", ms=i) for i in part]), None)) == []
    assert handle.calls <= 7 and handle.timers == {1299}
    assert [(r.n_turns, r.first_turn, r.last_turn) for r in sessions.handleExpiredTimer((1,), None, None)] == [(300, 296, 299)]
