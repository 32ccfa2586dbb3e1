"""Operator 6: exact top-k search with vector-approximation files.

The approximation file is a table of blocks: for each component of a vector one byte, its cell, and for each component
of the block the place of the cells and how far a value may lie from the middle of its own. A scan of the file with the
stated queries, broadcast in groups of bounded size, bounds every inner product from both sides without an exact vector.
A pair stays as long as its upper bound reaches the kth lower bound of its query, in its task first and then over all.
Exact vectors are read in the order of their bounds, by two joins: the first k of a query, then those whose upper bound
(a score is a negated distance) reaches the kth exact result, which makes it certain.

Defined results: vectors that are null, empty or hold null, NaN or infinite components take no part, nor do rows without
id; of rows with one id the smallest vector counts; only vectors of a query's own dimension are its candidates; ties go
to the smaller id; scores outside a long are clipped to it. Equal vectors are cut to the k + 1 smallest ids, which is
exact: a later one ties with k smaller ids. Components over 1e15 are beyond the cells: their pairs are all read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvina.llm import common as C

#: Bytes of exact vectors that make a block of the file, and of queries that make a block.
BLOCK_BYTES = 1 << 22
QUERY_BLOCK_BYTES = 1 << 20
#: Bytes of queries that are broadcast at once; more queries mean more scans of the file.
GROUP_BYTES = 8 << 20
CELLS = 256
#: Larger components have no cells.
WIDE = 1e15
MOST = 2.0**63
FILE = "dim int, ids binary, codes binary, base binary, step binary, half binary"
QUERIES = "block long, dim int, ids binary, q binary"
FOUND = "query_id long, vec_id long, low double, high double"


def usable(df: DataFrame, id_: str, vector: str, zero_too: bool) -> DataFrame:
    """Columns id, v (array<double>) and dim of the rows that take part, one for each id."""
    v = F.col(C.quoted(vector)).cast("array<double>")
    # the larger of |x| and its NaN or null shows a component that cannot take part
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(C.quoted(id_)).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(True)))
    if not zero_too:
        rows = rows.filter(F.exists("v", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def fewest_equal(rows: DataFrame, k: int) -> DataFrame:
    """Of equal vectors, the k + 1 rows of smallest id; each task cuts its own before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("_n") <= k + 1).drop("_n")


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of each query."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def matrices(batch: pa.RecordBatch, block_bytes: int):
    """(dim, ids, vectors) of the rows id, v, dim of a batch, in blocks of one dimension."""
    dims = np.asarray(batch.column("dim"))
    for dim in np.unique(dims).tolist():
        of, rows = np.flatnonzero(dims == dim), max(1, block_bytes // (8 * dim))
        for at in range(0, len(of), rows):
            part = batch.take(pa.array(of[at : at + rows]))
            yield dim, np.asarray(part.column("id")), np.asarray(part.column("v").flatten()).reshape(-1, dim)


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(scale * x)


def cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the cells of x, and of each component the first middle, the step between middles and the furthest value's distance."""
    low, high = x.min(0), x.max(0)
    step = (high - low) / CELLS
    code = np.clip(np.floor((x - low) / np.where(step > 0, step, 1)), 0, CELLS - 1).astype(np.uint8)
    base = low + step / 2
    return code, base, step, np.abs(x - (base + step * code)).max(0)


def approximation_file(rows: DataFrame, scale: float, block_bytes: int) -> DataFrame:
    """The blocks of rows (id, v, dim). Vectors without cells make blocks of their own, without codes."""

    def run(batches):
        for batch in batches:
            for dim, ids, v in matrices(batch, block_bytes):
                x = whole(v, scale)
                wide = ~(np.abs(x) < WIDE).all(1)
                for part, of in ((np.flatnonzero(~wide), cells), (np.flatnonzero(wide), None)):
                    if len(part):
                        rest = [a.tobytes() for a in of(x[part])] if of else [None] * 4
                        yield pa.RecordBatch.from_arrays([pa.array([a], t) for a, t in zip([dim, ids[part].tobytes(), *rest], (pa.int32(), *[pa.binary()] * 5), strict=True)], ["dim", "ids", "codes", "base", "step", "half"])

    return rows.select("id", "v", "dim").mapInArrow(run, FILE)


def query_blocks(rows: DataFrame, scale: float, block_bytes: int) -> DataFrame:
    """Blocks of the scaled queries (id, v, dim), named by their first id."""

    def run(batches):
        for batch in batches:
            for dim, ids, v in matrices(batch, block_bytes):
                values = [int(ids[0]), dim, ids.tobytes(), whole(v, scale).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([a], t) for a, t in zip(values, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "dim", "ids", "q"])

    return rows.select("id", "v", "dim").mapInArrow(run, QUERIES)


def bounds(q: np.ndarray, code: np.ndarray, base: np.ndarray, step: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of queries with the vectors of a block, from its cells alone."""
    middle = (base + step * code).astype(np.float32)
    size = np.abs(q)
    # what single precision may be off by: a rounding for each term and sum
    off = (q.shape[1] + 4) * 2.0**-23 * (size @ np.maximum(np.abs(base), np.abs(base + step * (CELLS - 1))))
    around = (size @ half + off)[:, None]
    s = (q.astype(np.float32) @ middle.T).astype(float)
    return np.clip(s - around, -MOST, MOST), np.clip(s + around, -MOST, MOST)


def scan(pairs: DataFrame, k: int, chunk: int = 128) -> DataFrame:
    """query_id, vec_id and bounds of the pairs of blocks' rows that may be among a query's k best.

    A task keeps the k highest lower bounds that it has met of each query.
    """

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row].as_py()  # noqa: B023, E731
                dim, block = get("dim"), get("block")
                q_ids, ids = (np.frombuffer(get(n), np.int64) for n in ("q_ids", "ids"))
                q = np.frombuffer(get("q")).reshape(-1, dim)
                code = get("codes")
                if code is not None:
                    code = np.frombuffer(code, np.uint8).reshape(-1, dim)
                    base, step, half = (np.frombuffer(get(n)) for n in ("base", "step", "half"))
                best_low = held.setdefault(block, np.full((len(q), k), -np.inf))
                order = np.argsort(ids, kind="stable")
                for at in range(0, len(q), chunk):
                    part = slice(at, at + chunk)
                    known = (np.abs(q[part]) < WIDE).all(1) if code is not None else np.zeros(len(q[part]), bool)
                    low, high = np.full((len(known), len(ids)), -MOST), np.full((len(known), len(ids)), MOST)
                    if known.any():
                        low[known], high[known] = bounds(q[part][known], code, base, step, half)
                    own = np.minimum(np.searchsorted(ids, q_ids[part], sorter=order), len(ids) - 1)
                    same = np.flatnonzero(ids[order[own]] == q_ids[part])
                    low[same, order[own[same]]] = high[same, order[own[same]]] = -np.inf
                    both = np.concatenate((best_low[part], low), 1)
                    best_low[part] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                    kept_q, kept = np.nonzero((high >= best_low[part].min(1)[:, None]) & (high > -np.inf))
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in (q_ids[part][kept_q], ids[kept], low[kept_q, kept], high[kept_q, kept])], ["query_id", "vec_id", "low", "high"])

    return pairs.mapInArrow(run, FOUND)


def exact(pairs: DataFrame, scale: float) -> DataFrame:
    """query_id, vec_id and the inner product, as a whole number of any size clipped to a long, of pairs with vectors q and v."""

    def number(x: float) -> int:
        return math.floor(scale * x) if abs(x) < 1e300 else int(scale) * int(x)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.asarray(pc.list_value_length(batch.column("q")))
            score = np.zeros(len(sizes), np.int64)
            for dim in np.unique(sizes).tolist():
                of = np.flatnonzero(sizes == dim)
                q, v = (whole(np.asarray(batch.column(n).take(pa.array(of)).flatten()).reshape(-1, dim), scale) for n in ("q", "v"))
                sure = np.abs(q).max(1) * np.abs(v).max(1) * dim < 2**52  # whole numbers that doubles hold exactly
                score[of[sure]] = (q[sure] * v[sure]).sum(1).astype(np.int64)
                for i in of[~sure].tolist():
                    s = sum(number(a) * number(b) for a, b in zip(batch.column("q")[i].as_py(), batch.column("v")[i].as_py(), strict=True))
                    score[i] = max(-(2**63), min(2**63 - 1, s))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(score)], ["query_id", "vec_id", "score"])

    return pairs.select("query_id", "vec_id", "q", "v").mapInArrow(run, "query_id long, vec_id long, score long")


def approximate(rows: DataFrame, queries: DataFrame, k: int, scale: float) -> DataFrame:
    """The pairs that the bounds leave, with them: query_id, vec_id, low, high."""
    block_bytes, query_bytes = BLOCK_BYTES, QUERY_BLOCK_BYTES
    file = C.materialise(approximation_file(rows, scale, block_bytes), "cells")
    blocks = C.materialise(query_blocks(queries, scale, query_bytes), "query-blocks")
    size = queries.agg(F.sum(8 * F.col("dim") + 8)).first()[0] or 0
    groups, found = max(1, math.ceil(size / GROUP_BYTES)), []
    for g in range(groups):
        some = blocks.filter(F.pmod(F.xxhash64("block"), F.lit(groups)) == g).withColumnRenamed("ids", "q_ids")
        found.append(C.materialise(scan(file.join(F.broadcast(some), "dim"), k), "bounds"))
    both = found[0]
    for f in found[1:]:
        both = both.unionByName(f)
    lows = both.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low")))).filter(F.col("n") <= k)
    kth = lows.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("low")).otherwise(-math.inf).alias("kth"))
    out = C.materialise(both.join(kth, "query_id").filter(F.col("high") >= F.col("kth")).drop("kth"), "candidates")
    for f in (file, blocks, *found):
        C.release(f)
    return out


def search(df: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """What top_k() returns, and how many pairs of exact vectors were read for it."""
    usable_ = usable(df, id_, vector, True)
    rows = C.materialise(fewest_equal(usable_, k), "vectors")
    queries = C.materialise(usable_.filter(F.col("id") % every == 0), "queries")
    left = approximate(rows, queries, k, scale)

    def read(pairs: DataFrame) -> DataFrame:
        pairs = C.materialise(pairs.select("query_id", "vec_id"), "read")
        pairs = F.broadcast(pairs) if C.small_enough(pairs, 48) else pairs
        vectors = rows.select(F.col("id").alias("vec_id"), "v").join(pairs, "vec_id")
        return C.materialise(exact(vectors.join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id"), scale), "scores")

    ordered = left.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("high"), "vec_id")))
    first = read(ordered.filter(F.col("n") <= k))
    kth = first.groupBy("query_id").agg(F.min("score").cast("double").alias("kth"))
    rest = read(left.join(kth, "query_id").filter(F.col("high") >= F.col("kth")).join(first.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_anti"))
    scored = first.unionByName(rest)
    return best(scored, k), scored.count()


def top_k(df: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Best k rows of every row whose id is divisible by every: query_id, rank, vec_id, score (integer inner product)."""
    return search(df, k, every, scale, id_, vector)[0]
