"""Shared helpers: the shared work folder, Arrow text buffers, word hashes and bounded training."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that numpy works on at once; one longer document makes a block of its own.
BLOCK_BYTES = 1 << 19
#: Largest table, in rows times the row width given by the caller, that may be broadcast.
BROADCAST_BYTES = 16 << 20
#: A key of more than this part of all rows counts as hot.
HOT = 100_000


def work_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary folder in local mode (tests), else the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        path = "file://" + tempfile.mkdtemp(prefix="corvina-") if local else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df once as Parquet into the shared folder and read it back: cuts lineage and survives lost executors.

    by: a column of few values that gets a folder for each.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/corvina/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.corvina_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(df: DataFrame) -> None:
    """Delete what materialise() wrote for df, once nothing reads it any more."""
    path = getattr(df, "corvina_path", None)
    if path:
        delete(df.sparkSession, path)


def small_enough(df: DataFrame, row_bytes: int) -> bool:
    """Whether a materialised df may be broadcast: its counted rows times row_bytes stay under BROADCAST_BYTES."""
    return df.count() * row_bytes <= BROADCAST_BYTES


def join_counted(rows: DataFrame, named: DataFrame, on: str, row_bytes: int) -> DataFrame:
    """rows joined by on with a written table named: a row for each key, n being the rows that have it.

    named is broadcast if it is small. Else keys of more than a part in HOT of all rows, fewer than HOT keys, are, so that
    a key of very many rows never makes one task's group; the others are joined by shuffle.
    """
    keys, total = named.agg(F.count("*"), F.sum("n")).first()
    pairs = named.drop("n")
    if keys * row_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(pairs), on)
    hot = named.filter(F.col("n") > total // HOT).drop("n")
    rare = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(pairs, on)
    return rows.join(F.broadcast(hot), on).unionByName(rare)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(name: str) -> str:
    """name as a column reference, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def plainly_named(df: DataFrame) -> DataFrame:
    """df with other names for the columns whose names PySpark would take for paths; toDF() gives the old ones back."""
    return df.toDF(*[free_name(df, f"_column{i}") if set(c) & set(".`") else c for i, c in enumerate(df.columns)])


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(modulus: int, remainder: int):
    """crc32(doc_id as text) mod modulus = remainder; a null doc_id counts as its empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


# ---- text in Arrow batches -------------------------------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, end to end, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about limit bytes of text each."""
    if batch.num_rows == 0:
        return
    _, at = utf8(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


#: ASCII letters and digits and all bytes of longer code points make up words.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = 0x9E3779B97F4A7C15 | 1
_IP = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for i, base in enumerate((_P, _IP)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[i] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Words:
    """Words of a block of texts: byte spans, the document of each and 64-bit hashes of their lower-cased bytes."""

    def __init__(self, column: pa.Array, inside: np.ndarray = WORD, lower=lambda raw: LOWER[raw]):
        self.raw, self.at = utf8(column)
        self.n = len(self.at) - 1
        self.data = lower(self.raw)
        word = inside[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.at] = True
        before = np.concatenate(([False], word[:-1])) if len(word) else word
        after = np.concatenate((word[1:], [False])) if len(word) else word
        self.start = np.flatnonzero(word & (~before | edge[:-1]))
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.doc = np.searchsorted(self.at, self.start, "right") - 1
        power, self._inverse = _grow(len(self.data) + 1)
        self._sum = np.zeros(len(self.data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            terms = self.data.astype(np.uint64)
            terms += np.uint64(1)
            terms *= power[:-1]
            np.cumsum(terms, out=self._sum[1:])

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None, salt: int = 0) -> np.ndarray:
        start, end = (self.start if start is None else start), (self.end if end is None else end)
        with np.errstate(over="ignore"):
            return mix((self._sum[end] - self._sum[start]) * self._inverse[start] + np.uint64(salt * 0x632BE59BD9B4E019 % 2**64))

    def per_doc(self, weight: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.doc, weight, self.n)


def distinct_in_doc(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, keys and counts of the distinct (document, key) pairs, in order of the document."""
    if not len(key):
        return doc[:0], key[:0], np.zeros(0, np.int64)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    first = np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))
    at = np.flatnonzero(first)
    return doc[at], key[at], np.diff(np.append(at, len(key)))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


# ---- training on a bounded sample ------------------------------------------------------------------------------


def bounded_sample(rows: DataFrame, strata: str, per_stratum: int, keys: list[str]) -> DataFrame:
    """About per_stratum rows of each value of strata, chosen by a hash of keys; never over twice that in all.

    One small count per value sets the rate, so what is read later is bounded whatever the input's size.
    """
    counts = rows.groupBy(strata).count().orderBy(F.desc("count"), strata).limit(1000).collect()
    rate = F.lit(0.0)
    for value, n in counts:
        if value is not None:
            rate = F.when(F.col(strata) == value, min(1.0, per_stratum / n)).otherwise(rate)
    share = F.pmod(F.xxhash64(*keys), F.lit(1 << 20)) / float(1 << 20)
    return rows.filter(F.col(strata).isNotNull() & (share < rate)).limit(2 * per_stratum * max(1, len(counts)))


def fit_in_task(sample: DataFrame, fit: Callable[[pa.Table], bytes]) -> bytes:
    """Run fit over a bounded sample in one task; only the model, bounded by its parameters, comes to the driver."""
    schema = sample.schema

    def run(batches):
        got = [b for b in batches]
        from pyspark.sql.pandas.types import to_arrow_schema

        table = pa.Table.from_batches(got) if got else to_arrow_schema(schema).empty_table()
        yield pa.RecordBatch.from_arrays([pa.array([fit(table)], pa.binary())], ["model"])

    out = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return bytes(out[0][0]) if out else fit(pa.table({f.name: pa.array([], pa.string()) for f in schema}))
