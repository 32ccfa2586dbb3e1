"""Operator 4: line deduplication over levelled sorted runs of line hashes.

Documents come in batches of falling doc_id. A batch's distinct line keys are sorted by hash and merge-anti-joined with
the runs written so far: a key that no run holds gets its keeper, the largest doc_id of this batch and so of all; a key
that some run holds only adds to the count. The batch then becomes a run of level 0; as soon as a level has two runs
they are compacted into one sorted run of the next level. Runs are tables bucketed and sorted by hash, so joining and
compacting them moves no row of a run between tasks. Keys are 128-bit hashes, so no text is shuffled for them.

Defined results: a null or empty text is one empty line; a row without doc_id keeps nothing and adds nothing to the
counts; rows that share a doc_id count as one document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.llm import common as C

STRIP = " \t\n\x0b\x0c\r"
#: Documents of a batch, and the least number of batches: smaller corpora come in smaller ones.
BATCH_DOCS, LEAST_BATCHES = 10_000_000, 4


def line_key(line: str, min_chars: int) -> bytes | None:
    """128-bit hash of the stripped, A-Z lower-cased line; None below min_chars code points."""
    key = line.strip(STRIP)
    return xxhash.xxh3_128_digest(key.encode("utf-8").lower()) if len(key) >= min_chars else None  # bytes.lower(): A-Z only


def line_keys(docs: DataFrame, min_chars: int, cuts: list[int] | None = None) -> DataFrame:
    """doc_id, batch and h of every distinct key of a document; batch: how many of cuts doc_id does not exceed, -1 without one."""

    def run(batches):
        for batch in batches:
            for part in C.blocks(batch):
                ids, keys = [], []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    found = {line_key(x, min_chars) for x in (text or "").split("\n")} - {None}
                    ids += [doc_id] * len(found)
                    keys += found
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "h"])

    batch = sum(((F.col("doc_id") <= c).cast("int") for c in cuts or []), F.lit(0))
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, h binary").withColumn("batch", F.coalesce(batch, F.lit(-1)) if cuts else F.when(F.col("doc_id").isNull(), -1).otherwise(0))


class Runs:
    """Runs of (h, keeper, n) sorted by h, in levels; n is the documents counted, keeper the doc_id that keeps a line.

    A run is a table in the shared folder, bucketed by h as Spark's shuffles are, and so merged where it lies.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.levels = spark, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(r) for level in self.levels for r in level]

    def merged(self) -> DataFrame:
        """All runs compacted into one, from the smallest levels up."""
        while len(self.runs()) > 1:
            lower = next(i for i, level in enumerate(self.levels) if level)
            upper = next(i for i, level in enumerate(self.levels) if i > lower and level)
            self._compact([self.levels[lower].pop(), self.levels[upper].pop()], upper)
        return self.runs()[0]

    @staticmethod
    def merge(a: DataFrame, b: DataFrame) -> DataFrame:
        """Two runs as one, with the counts of a key added up: a merge join of what is bucketed and sorted alike."""
        a, b = (r.select("h", F.col("keeper").alias(f"keeper{i}"), F.col("n").alias(f"n{i}")) for i, r in enumerate((a, b)))
        both = a.join(b.hint("merge"), "h", "full")
        return both.select("h", F.greatest("keeper0", "keeper1").alias("keeper"), (F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))).alias("n"))

    def joined(self, batch: DataFrame) -> DataFrame:
        """The batch as a run: keys that some run holds have no keeper."""
        held = F.lit(False)
        for i, run in enumerate(self.runs()):
            batch = batch.join(run.select("h", F.lit(True).alias(f"in{i}")).hint("merge"), "h", "left")
            held = held | F.coalesce(f"in{i}", F.lit(False))
        return batch.select("h", F.when(~held, F.col("keeper")).alias("keeper"), "n")

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (h, keeper, n), distinct in h, whose doc_ids lie below those of all runs."""
        self._put(0, self.joined(batch))

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        name = f"corvina_run_{uuid.uuid4().hex}"
        path = f"{C.work_dir(self.spark)}/corvina/{name}"
        run.write.format("parquet").option("path", path).bucketBy(self.buckets, "h").sortBy("h").saveAsTable(name)
        self.levels[level].append(name)
        if len(self.levels[level]) == 2:
            old, self.levels[level] = self.levels[level], []
            self._compact(old, level + 1)

    def _compact(self, old: list[str], level: int) -> None:
        self._put(level, self.merge(*map(self.spark.table, old)))
        self._drop(old)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            C.delete(self.spark, f"{C.work_dir(self.spark)}/corvina/{name}")

    def drop(self) -> None:
        """Delete all runs."""
        for level in self.levels:
            self._drop(level)
        self.levels = []


def batch_cuts(docs: DataFrame, batch_docs: int) -> list[int]:
    """doc_ids, falling, that part the documents into batches of about batch_docs, LEAST_BATCHES of them at least."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(F.col("doc_id").isNotNull())
    batches = max(LEAST_BATCHES, -(-ids.count() // batch_docs))
    steps = [i / batches for i in range(1, batches)]
    return sorted(set(ids.agg(F.percentile_approx("doc_id", steps, max(1000, 10 * batches))).first()[0] or []), reverse=True) if steps else []


def repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batch_docs: int = BATCH_DOCS) -> DataFrame:
    """doc_id and the array drop of the line hashes it loses, for the documents that lose any."""
    cuts = batch_cuts(docs, batch_docs)
    keys = C.materialise(line_keys(docs, min_chars, cuts), "line_keys", "batch")
    runs = Runs(docs.sparkSession)
    for i in range(len(cuts) + 1):
        # a key comes once from each row; rows that share a doc_id are one document
        part = keys.filter(F.col("batch") == i).groupBy("h", "doc_id").agg(F.lit(1).alias("one")).groupBy("h")
        runs.add(part.agg(F.max("doc_id").alias("keeper"), F.count("*").alias("n")))
    dropped = C.materialise(runs.merged().filter(F.col("n") >= min_docs), "dropped")
    runs.drop()
    losing = C.join_counted(keys.select("doc_id", "h"), dropped, "h", 48).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = C.materialise(losing.groupBy("doc_id").agg(F.collect_set("h").alias("drop")), "drops")
    C.release(keys)
    C.release(dropped)
    return drops


def _with_drops(docs: DataFrame, drops: DataFrame, columns: list[str]) -> DataFrame:
    """The columns and, last, the hashes that the row loses."""
    held = drops.agg(F.count("*"), F.sum(F.size("drop"))).first()
    small = 64 * (held[0] or 0) + 24 * (held[1] or 0) <= C.BROADCAST_BYTES
    of, drop = C.free_name(docs, "_of"), C.free_name(docs, "_drop")
    other = drops.select(F.col("doc_id").alias(of), F.col("drop").alias(drop))
    return docs.select(*columns).join(F.broadcast(other) if small else other, F.col("doc_id").eqNullSafe(F.col(of)), "left").drop(of)


def _kept(text: str | None, drop, min_chars: int) -> tuple[list[str], int]:
    lines = (text or "").split("\n")
    if not drop:
        return lines, 0
    gone = {bytes(x) for x in drop}
    kept = [x for x in lines if line_key(x, min_chars) not in gone]
    return kept, len(lines) - len(kept)


def drop_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with the repeated lines taken out of text; n_chars follows. Texts that lose nothing stay as they are."""
    given, docs = docs.columns, C.plainly_named(docs)
    joined = _with_drops(docs, repeated_lines(docs, min_chars, min_docs), docs.columns)
    names, schema = docs.columns, docs.schema

    def run(batches):
        for batch in batches:
            for part in C.blocks(batch):
                drop = part.column(part.num_columns - 1).to_pylist()
                text = [t if not d else "\n".join(_kept(t, d, min_chars)[0]) for t, d in zip(part.column("text").to_pylist(), drop, strict=True)]
                cols = {n: part.column(n) for n in names} | {"text": pa.array(text, part.column("text").type)}
                if "n_chars" in cols:
                    kind, old = cols["n_chars"].type, cols["n_chars"].to_pylist()
                    cols["n_chars"] = pa.array([len(t) if d else o for t, d, o in zip(text, drop, old, strict=True)], kind)
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return joined.mapInArrow(run, schema).toDF(*given)


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every row."""
    joined = _with_drops(docs, repeated_lines(docs, min_chars, min_docs), ["doc_id", "text"])

    def run(batches):
        for batch in batches:
            for part in C.blocks(batch):
                lines, gone, sha = [], [], []
                for text, drop in zip(part.column("text").to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True):
                    kept, lost = _kept(text, drop, min_chars)
                    lines.append(len(kept) + lost)
                    gone.append(lost)
                    sha.append(hashlib.sha256("\n".join(kept).encode("utf-8")).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
