"""A full-text index on disk that changes with its documents: segments, tombstones and a manifest.

A segment holds the postings of some documents (a folder for each head of two characters, sorted by term) and their rows
(id, two hashes of what was indexed, copies, tokens); in an index with bounds also the maxima of their blocks. It is never changed. An update compares hashes: documents that are new
or have changed make one new segment, and what they and lost documents had before gets a tombstone in a table beside its
segment. Segments of like size are merged by the four, and so are those that are half dead, from their postings: no text is
read. Last of all the manifest, the table of live segments with their counts, is replaced by a rename: a reader has the old
index or the new one, and a crash leaves the old. Files that neither the last manifest nor this one names are deleted.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.operators import lexical
from corvina.sources import shared, writers

MANIFEST = "segment string, tombstones string, n_docs long, n_dead long, n_rows long, n_tokens long, source string, fields string"
#: Begins the fields of an index with bounds.
BOUNDS = "bounds,"
#: So many segments of a size tier (powers of this number of documents) become one.
FANIN = 4
#: Bytes of a tombstone in a broadcast.
TOMBSTONE = 64


def manifest(spark: SparkSession, path: str) -> list:
    """The live segments of the index at path; none where there is no index."""
    table = f"{path}/manifest"
    writers.recover(spark, table)
    return spark.read.schema(MANIFEST).parquet(table).collect() if shared.exists(spark, table) else []


def _said(weights: dict[str, float], bounded: bool) -> str:
    return (BOUNDS if bounded else "") + ",".join(f"{f}:{w}" for f, w in weights.items())


def _alive(rows: DataFrame, spark: SparkSession, path: str, segment) -> DataFrame:
    """rows (id, ...) of a segment without those of its tombstones."""
    if not segment.n_dead:
        return rows
    dead = spark.read.parquet(f"{path}/segments/{segment.tombstones}").select(F.col("id").alias("_dead"))
    dead = F.broadcast(dead) if segment.n_dead * TOMBSTONE <= shared.BROADCAST_BYTES else dead
    return rows.join(dead, F.col("id").eqNullSafe(F.col("_dead")), "left_anti")


def _postings(spark: SparkSession, path: str, segment) -> DataFrame:
    at = f"{path}/segments/{segment.segment}"
    kind = spark.read.parquet(f"{at}/rows").schema["id"].dataType.simpleString()
    # a segment of documents without a token has no files to tell a schema
    rows = spark.read.schema(f"term string, id {kind}, wtf double, n long, dl long, lcp int, nth int, block long, head string").parquet(f"{at}/postings")
    return _alive(rows, spark, path, segment)


def _blocks(spark: SparkSession, path: str, segment) -> DataFrame:
    """The block maxima of a segment: as written, or grouped from living postings, as counts must not include the dead."""
    if segment.n_dead:
        return lexical.block_rows(_postings(spark, path, segment))
    return spark.read.schema("term string, block long, lcp int, rows long, wtf double, nth int, dl long, head string").parquet(f"{path}/segments/{segment.segment}/blocks")


def _documents(spark: SparkSession, path: str, segment) -> DataFrame:
    return _alive(spark.read.parquet(f"{path}/segments/{segment.segment}/rows"), spark, path, segment)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def read_index(spark: SparkSession, path: str) -> lexical.Index | None:
    """The index at path as its manifest says now; None if there is none."""
    live = manifest(spark, path)
    if not live:
        return None
    n_rows, n_tokens = sum(s.n_rows for s in live), sum(s.n_tokens for s in live)
    totals = spark.createDataFrame([(n_rows, n_tokens / n_rows if n_rows else None)], "n_rows long, avgdl double")
    if not live[0].fields.startswith(BOUNDS):
        return lexical.Index(_union([_postings(spark, path, s) for s in live]).drop("lcp", "nth", "block"), totals)
    apart = [F.col("block") + F.lit(i << 40) for i in range(len(live))]  # blocks of different segments are different blocks
    named = lambda of: _union([of(spark, path, s).withColumn("block", b) for s, b in zip(live, apart, strict=True)])
    return lexical.Index(named(_postings), totals, named(_blocks))


def _hashed(rows: DataFrame, id_: str, weights: dict[str, float]) -> DataFrame:
    """id, h1 and h2 (of all rows of the id, in any order), copies and n_tokens."""
    fields = [F.col(f).cast("string") for f in weights]
    sizes = lexical.field_sizes(weights)
    one = rows.select(F.col(id_).alias("id"), F.xxhash64(F.lit(1), *fields).alias("a"), F.xxhash64(F.lit(2), *fields).alias("b"), sizes.alias("n"))
    return one.groupBy("id").agg(F.sum(F.col("a").cast("decimal(38,0)")).cast("string").alias("h1"), F.bit_xor("b").alias("h2"), F.count("*").alias("copies"), F.sum("n").alias("n_tokens"))


def _write(postings: DataFrame, rows: DataFrame, path: str, bounded: bool) -> tuple:
    """A new segment; its name, tombstones, and counts of documents, dead ones, rows and tokens."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    at = f"{path}/segments/{name}"
    rows.write.parquet(f"{at}/rows")
    n, copies, tokens = spark.read.parquet(f"{at}/rows").agg(F.count("*"), F.sum("copies"), F.sum("n_tokens")).first()
    order = ["head", "term"]
    if bounded:
        postings, order = lexical.with_slots(postings, n), [*order, "block"]
    # rebalancing deals heads to tasks, splits the crowded ones and joins the small
    postings.hint("rebalance", "head").sortWithinPartitions(*order).write.partitionBy("head").parquet(f"{at}/postings")
    if bounded:
        written = spark.read.schema(postings.schema).parquet(f"{at}/postings")
        lexical.block_rows(written).write.partitionBy("head").parquet(f"{at}/blocks")
    return name, "", n, 0, copies or 0, tokens or 0


def _entomb(spark: SparkSession, path: str, segment, gone: DataFrame) -> tuple:
    """A segment's line with the ids of gone among its tombstones, which are written anew: half a segment at most."""
    name = f"{segment.segment}-dead-{uuid.uuid4().hex}"
    old = [spark.read.parquet(f"{path}/segments/{segment.tombstones}")] if segment.n_dead else []
    _union([*old, gone.select("id")]).distinct().write.parquet(f"{path}/segments/{name}")
    dead = spark.read.parquet(f"{path}/segments/{name}").count()
    line = segment._asdict() if hasattr(segment, "_asdict") else segment.asDict()
    probe = type("S", (), line | {"tombstones": name, "n_dead": dead})
    copies, tokens = _documents(spark, path, probe).agg(F.sum("copies"), F.sum("n_tokens")).first()
    return segment.segment, name, segment.n_docs, dead, copies or 0, tokens or 0


def _tier(n: int) -> int:
    return int(math.log(max(1, n), FANIN))


def _compacted(spark: SparkSession, path: str, lines: list[tuple], bounded: bool) -> list[tuple]:
    """The lines after every tier of FANIN segments, and every segment that is half dead, has been merged."""
    fields = [c.split()[0] for c in MANIFEST.split(", ")][:6]
    while True:
        named = [type("S", (), dict(zip(fields, line, strict=True))) for line in lines]
        tiers: dict[int, list] = {}
        for s in named:
            tiers.setdefault(_tier(s.n_docs - s.n_dead), []).append(s)
        some = next((t[:FANIN] for t in tiers.values() if len(t) >= FANIN), None) or [s for s in named if 2 * s.n_dead > s.n_docs][:1]
        if not some:
            return lines
        merged = {s.segment for s in some}
        lines = [line for line in lines if line[0] not in merged]
        if any(s.n_dead < s.n_docs for s in some) or not lines:
            postings = _union([_postings(spark, path, s) for s in some])
            postings = postings if bounded else postings.drop("lcp", "nth", "block")
            lines.append(_write(postings, _union([_documents(spark, path, s) for s in some]), path, bounded))


def _new_postings(rows: DataFrame, id_: str, weights: dict[str, float], bounded: bool) -> DataFrame:
    found = lexical.postings(rows, id_, weights)
    return lexical.placed(found) if bounded else found


def _publish(spark: SparkSession, path: str, before: list, lines: list[tuple], source: str, fields: str) -> None:
    writers.replace_table(spark.createDataFrame([(*line, source, fields) for line in lines], MANIFEST).coalesce(1), f"{path}/manifest")
    kept = {n for s in before for n in (s.segment, s.tombstones)} | {n for line in lines for n in line[:2]}
    root, fs = shared.file_system(spark, f"{path}/segments")
    for status in fs.listStatus(root):
        if status.getPath().getName() not in kept:
            fs.delete(status.getPath(), True)


def write_index(rows: DataFrame, path: str, id_: str, weights: dict[str, float], source: str | None = None, bounded: bool = False) -> None:
    """The index of rows as one segment, with bounds if asked for, whatever was at path before."""
    before = manifest(rows.sparkSession, path)
    line = _write(_new_postings(rows, id_, weights, bounded), _hashed(rows, id_, weights), path, bounded)
    _publish(rows.sparkSession, path, before, [line], source or "", _said(weights, bounded))


def update_index(rows: DataFrame, path: str, id_: str, weights: dict[str, float], source: str | None = None, bounded: bool = False) -> dict[str, int]:
    """Bring the index at path to what rows are now; the numbers of documents written and of tombstones set.

    Only hashes of unchanged documents are compared. Without an index, or with one over other fields, all are written. Rows
    that share an id are one document and change together.
    """
    spark, before = rows.sparkSession, manifest(rows.sparkSession, path)
    if not before or before[0].fields != _said(weights, bounded):
        write_index(rows, path, id_, weights, source, bounded)
        return {"written": sum(s.n_docs for s in manifest(spark, path)), "dead": 0}
    now = _hashed(rows, id_, weights)
    old = _union([_documents(spark, path, s).withColumn("segment", F.lit(s.segment)) for s in before])
    both = now.alias("a").join(old.alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")), "full")
    same = (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")) & (F.col("a.copies") == F.col("b.copies"))
    changed = both.filter(~F.coalesce(same, F.lit(False))).select(F.when(F.col("a.h1").isNotNull(), F.col("a.id")).otherwise(F.col("b.id")).alias("id"), F.col("a.h1").isNotNull().alias("new"), "b.segment", "a.h1", "a.h2", "a.copies", "a.n_tokens")
    changed = shared.materialise(changed, "changed")
    dead = {r.segment: r.n for r in changed.filter("segment IS NOT NULL").groupBy("segment").agg(F.count("*").alias("n")).collect()}
    lines = [tuple(s)[:6] if s.segment not in dead else _entomb(spark, path, s, changed.filter(F.col("segment") == s.segment)) for s in before]
    added = changed.filter("new")
    written = added.count()
    if written:
        ids = added.select(F.col("id").alias("_new"))
        ids = F.broadcast(ids) if written * TOMBSTONE <= shared.BROADCAST_BYTES else ids
        of = rows.join(ids, F.col(id_).eqNullSafe(F.col("_new")), "left_semi")
        lines.append(_write(_new_postings(of, id_, weights, bounded), added.select("id", "h1", "h2", "copies", "n_tokens"), path, bounded))
    _publish(spark, path, before, _compacted(spark, path, lines, bounded), source or "", _said(weights, bounded))
    shared.release(changed)
    return {"written": written, "dead": sum(dead.values())}


def ensure_index(rows: DataFrame | None, path: str, id_: str, weights: dict[str, float], source: str, spark: SparkSession | None = None, bounded: bool = False) -> lexical.Index | None:
    """The index at path, brought up to date from rows where it is missing or was made of another source or fields.

    source: a fingerprint of what rows come from, such as readers.file_fingerprint. Without rows a stale index is no index.
    """
    spark = spark or rows.sparkSession
    live = manifest(spark, path)
    if not live or (live[0].source, live[0].fields) != (source, _said(weights, bounded)):
        if rows is None:
            return None
        update_index(rows, path, id_, weights, source, bounded)
    return read_index(spark, path)
