"""Event streams: framing, accumulation of deltas, session state, upserts, and windows over event time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvina.functions.text import sse_block

SESSION_TURNS = 4


def parse_blocks(rows: DataFrame, text: str) -> DataFrame:
    """seq, event and data of the blocks of a column of event-stream text; several data lines of a block are joined."""
    blocks = rows.select("*", F.posexplode(F.split(F.regexp_replace(F.col(text), "\r\n", "\n"), "\n\n")).alias("seq", "_block")).filter(F.trim("_block") != "")
    lines = F.split("_block", "\n")
    data = F.array_join(F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: F.regexp_replace(x, "^data: ?", "")), "\n")
    event = F.trim(F.regexp_extract(F.col("_block"), r"(?m)^event:(.*)$", 1))
    return blocks.select(*[c for c in rows.columns if c != text], "seq", F.coalesce(F.nullif(event, F.lit("")), F.lit("message")).alias("event"), data.alias("data")).filter(F.col("data") != "")


def framed(rows: DataFrame, key: str, seq: str, text: str) -> DataFrame:
    """key, seq, event and data of the blocks of streams that come in pieces (key, seq, text), cut anywhere.

    A stream's pieces are joined in order, so a block that is cut across them is one event; one without an end is last.
    """
    whole = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("o"), F.coalesce(text, F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("_text"))
    return parse_blocks(whole, "_text")


def frame_stream(stream: DataFrame, timeout: str = "10 minutes") -> DataFrame:
    """request_id, block and n of the whole blocks of a stream of pieces (request_id, seq, text).

    The state of a request is the end of its text that no blank line has closed yet; it is flushed, as it is, after the
    timeout without new pieces. Pieces of one batch are put in order; a stream brings a request's batches in order.
    """
    millis = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, n = state.get if state.exists else ("", 0)
        if state.hasTimedOut:
            state.remove()
            blocks = [rest]
        else:
            rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
            *blocks, rest = (rest + "".join(rows["text"].fillna(""))).replace("\r\n", "\n").split("\n\n")
            state.update((rest, n + len(blocks)))
            state.setTimeoutDuration(millis)
        numbered = [(key[0], b, n + i) for i, b in enumerate(blocks) if b.strip()]
        yield pd.DataFrame(numbered, columns=["request_id", "block", "n"])

    return stream.groupBy("request_id").applyInPandasWithState(step, "request_id string, block string, n long", "rest string, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def line_events(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos and block of replies sent as lines: a JSON reply is one delta, any other text one for each line."""
    is_json = F.try_parse_json(F.col(text)).isNotNull()
    lines = F.when(is_json, F.array(F.replace(F.col(text), F.lit("\n"), F.lit("\\n")))).otherwise(F.split(F.col(text), "\n"))
    delta = rows.select(key, F.posexplode(lines).alias("pos", "v"))
    return delta.select(key, "pos", sse_block(F.lit("delta"), F.to_json(F.struct("v"))).alias("block"))


def encode_blocks(rows: DataFrame) -> DataFrame:
    """The text of rows (event, data)."""
    return rows.withColumn("block", sse_block(F.col("event"), F.col("data")))


def accumulate(rows: DataFrame, key: str, seq: str, delta: str, final: str | None = None) -> DataFrame:
    """key and the text of all its deltas in order; a final text, where there is one, takes its place."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, delta))), lambda x: x[delta]), "")
    agg = [joined.alias("text"), F.count("*").alias("n_deltas")] + ([F.max_by(final, F.when(F.col(final).isNotNull(), F.col(seq))).alias("_final")] if final else [])
    out = rows.groupBy(key).agg(*agg)
    return out.withColumn("text", F.coalesce("_final", "text")).drop("_final") if final else out


def accumulate_stream(stream: DataFrame, timeout: str = "10 minutes") -> DataFrame:
    """The text so far of every request of a stream (request_id, seq, event, delta), by state kept between batches.

    A request's state goes after its "done" event or when nothing has come for the timeout. Deltas of one batch are put in order; a stream is
    expected to bring a request's batches in order.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (text, n) = state.get
            state.remove()
            yield pd.DataFrame({"request_id": [key[0]], "text": [text], "n_deltas": [n], "finished": [True]})
            return
        text, n = state.get if state.exists else ("", 0)
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        text += "".join(rows.loc[rows["event"] == "delta", "delta"].fillna(""))
        n += int((rows["event"] == "delta").sum())
        finished = bool((rows["event"] == "done").any())
        if finished:
            state.remove()
        else:
            state.update((text, n))
            state.setTimeoutDuration(millis)
        yield pd.DataFrame({"request_id": [key[0]], "text": [text], "n_deltas": [n], "finished": [finished]})

    millis = int(pd.Timedelta(timeout).total_seconds() * 1000)
    return stream.groupBy("request_id").applyInPandasWithState(step, "request_id string, text string, n_deltas long, finished boolean", "text string, n long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def session_stream(stream: DataFrame, turns: int = SESSION_TURNS) -> DataFrame:
    """The last turns of every session of a stream (session_id, turn, role, text), as state bounded by turns entries."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(zip(*state.get, strict=True)) if state.exists else []
        for f in frames:
            kept += list(zip(f["turn"].tolist(), f["role"].tolist(), f["text"].tolist(), strict=True))
            kept = sorted(kept, key=lambda x: x[0])[-turns:]
        state.update(tuple(map(list, zip(*kept, strict=True))))
        yield pd.DataFrame({"session_id": [key[0]], "n_kept": [len(kept)], "first_turn": [kept[0][0]], "last_turn": [kept[-1][0]], "history": ["\n".join(f"{r}: {t}" for _, r, t in kept)]})

    out = "session_id long, n_kept int, first_turn long, last_turn long, history string"
    return stream.groupBy("session_id").applyInPandasWithState(step, out, "turn array<long>, role array<string>, text array<string>", "update", GroupStateTimeout.NoTimeout)


def upsert_sink(path: str, key: str, order: str, buckets: int = 64):
    """A foreachBatch function: each batch's latest row of a key replaces the table's.

    The table lies in buckets by a hash of the key, and a batch rewrites only those of its keys. A batch that was written
    once, by its id, is not written again.
    """
    from corvina.operators.memory import upsert
    from corvina.sources import shared

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark, table = f"{path}/batches/{batch_id}", f"{path}/rows"
        if shared.exists(spark, mark):
            return
        new = shared.materialise(batch.withColumn("first_seen", F.col(order)).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "batch")
        touched = [r[0] for r in new.select("bucket").distinct().collect()]
        if touched:
            old = [spark.read.parquet(table).filter(F.col("bucket").isin(touched)).select(new.columns)] if shared.exists(spark, table) else []
            merged = shared.materialise(upsert(reduce(DataFrame.unionByName, old, new), key, [order], "first_seen"), "merged")
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)
            shared.release(merged)
        shared.release(new)
        target, fs = shared.file_system(spark, mark)
        fs.mkdirs(target)

    return write


def read_upserted(spark, path: str) -> DataFrame:
    """The table of upsert_sink()."""
    return spark.read.parquet(f"{path}/rows").drop("bucket")


def event_windows(events: DataFrame, size: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows; batch or stream, late rows dropped past the watermark."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = timed.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.sum("value").alias("sum_value"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n_events", "sum_value")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Sessions of each user: runs of events with less than gap between them."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    out = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n_events"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "n_events")
