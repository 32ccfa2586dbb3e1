"""Exact nearest neighbours by squared L2 distance, with stored single-precision norms."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvina.sources import shared

#: Bytes of query vectors of a block, and products of queries and rows that a task holds at once.
BLOCK_BYTES, CELLS = 8 << 20, 1 << 21
#: Rows found, over all queries of a block, that a task gathers before it keeps the nearest of each query.
SEEN = 1 << 18
#: How far, in parts of the norms, a product of matrices may be from one that is added up in order.
SLACK = 1e-9


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, by rising index."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_norm(v: Column) -> Column:
    """Rounded to single precision, as it is stored beside the vectors."""
    return dot(as_double(v), as_double(v)).cast("float")


def with_norm(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    return rows.withColumn("sq_norm", squared_norm(F.col(vector)))


def l2(q: Column, q_norm: Column, x: Column, x_norm: Column) -> Column:
    """|q|^2 + |x|^2 - 2 q x with both norms as stored."""
    return q_norm.cast("double") + x_norm.cast("double") - 2 * dot(q, x)


def usable(v: Column) -> Column:
    """Whether a vector takes part: not null or empty, and all components finite."""
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


class _Nearest:
    """The limit nearest rows of every query of a block, seen so far by one task."""

    def __init__(self, queries: np.ndarray, norms: np.ndarray, limit: int):
        self.queries, self.norms, self.limit = queries, norms, limit
        self.far = np.full(len(queries), np.inf)
        self.found = pd.DataFrame({"q": np.zeros(0, np.int64), "near": np.zeros(0), "id": pd.Series([], dtype=object), "distance": np.zeros(0)})

    def see(self, ids: pa.Array, x: np.ndarray, norms: np.ndarray) -> None:
        """A matrix product tells which rows may be among the nearest; the distances of these are then added up by rising
        index, as the SQL form does, so that results do not depend on how blocks are multiplied."""
        step, parts, n_found = max(1, CELLS // len(self.queries)), [], 0
        for at in range(0, len(x), step):
            rows, n = x[at : at + step], norms[at : at + step]
            rough = self.queries @ rows.T
            rough *= -2
            rough += self.norms[:, None]
            rough += n[None, :]
            bound = self.far
            if rough.shape[1] > self.limit:
                bound = np.minimum(bound, np.partition(rough, self.limit - 1, axis=1)[:, self.limit - 1])
            q, r = np.nonzero(rough <= (bound + SLACK * (1 + self.norms + n.max()))[:, None])
            dot = np.zeros(len(q))
            for i in range(x.shape[1]):
                dot += self.queries[q, i] * rows[r, i]
            distance = self.norms[q] + n[r] - 2 * dot
            parts.append(pd.DataFrame({"q": q, "near": _rounded(distance), "id": pd.Series(ids.take(pa.array(r + at)).to_pylist(), dtype=object), "distance": distance}))
            n_found += len(q)
            if n_found > SEEN:  # later rows are then held against nearer ones
                self._keep(parts)
                parts, n_found = [], 0
        self._keep(parts)

    def _keep(self, parts: list[pd.DataFrame]) -> None:
        """The nearest of what was found before and of parts."""
        parts = [p for p in (self.found, *parts) if len(p)] or [self.found]
        both = pd.concat(parts, ignore_index=True).sort_values(["q", "near", "id"], na_position="first")
        self.found = both.groupby("q", sort=False).head(self.limit)
        full = self.found.groupby("q")["distance"].agg(["size", "max"])
        full = full[full["size"] == self.limit]
        self.far[full.index.to_numpy()] = full["max"].to_numpy()


def _rounded(distance: np.ndarray) -> np.ndarray:
    """As Spark rounds to ten places: half up, by the shortest decimal form."""
    out = np.round(distance, 10)
    for i in np.flatnonzero(np.abs(np.abs(distance * 1e10 % 1) - 0.5) < 1e-3):
        out[i] = float(Decimal(repr(float(distance[i]))).quantize(Decimal("1e-10"), ROUND_HALF_UP))
    return out


def _block(x: DataFrame, q: DataFrame, limit: int) -> DataFrame:
    """query_id, id and distance of each task's nearest rows to the queries of one block, which is collected and broadcast."""
    asked = q.collect()
    if not asked:
        return x.limit(0).join(q.limit(0)).select("query_id", "id", F.lit(0.0).alias("distance"))
    dims = len(asked[0].q)
    if any(len(r.q) != dims for r in asked):
        raise ValueError("dimension mismatch")
    names = x.sparkSession.createDataFrame([(i, r.query_id) for i, r in enumerate(asked)], T.StructType([T.StructField("_q", T.LongType()), q.schema["query_id"]]))
    matrix, norms = np.array([r.q for r in asked]), np.array([r.qn for r in asked], np.float64)
    kind = x.schema["id"].dataType
    schema = T.StructType([T.StructField("_q", T.LongType()), T.StructField("id", kind), T.StructField("distance", T.DoubleType())])

    def run(batches):
        state, arrow = _Nearest(matrix, norms, limit), None
        for batch in batches:
            arrow = batch["id"].type
            flat = batch["x"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if batch["x"].value_lengths().to_numpy(zero_copy_only=False).tolist() != [dims] * batch.num_rows:
                raise ValueError("dimension mismatch")
            if batch.num_rows:
                state.see(batch["id"], flat.reshape(-1, dims), batch["sq_norm"].to_numpy(zero_copy_only=False).astype(np.float64))
        if arrow is not None:
            f = state.found
            yield pa.RecordBatch.from_arrays([pa.array(f["q"].to_numpy(), pa.int64()), pa.array(f["id"].tolist(), arrow), pa.array(f["distance"].to_numpy())], ["_q", "id", "distance"])

    near = x.select("id", "x", "sq_norm").mapInArrow(run, schema)
    return near.join(F.broadcast(names), "_q").select("query_id", "id", "distance")  # names: BLOCK_BYTES at most


def knn(vectors: DataFrame, queries: DataFrame, id_: str = "vec_id", vector: str = "embedding", limit: int = 10) -> DataFrame:
    """query_id, id, distance and vector_rank of the limit nearest rows; ties go by id.

    queries: (query_id, query_vector). Vectors are multiplied in blocks with a broadcast matrix of queries, BLOCK_BYTES of
    them at most, and each task keeps the limit best rows of a query, so tasks x queries x limit rows leave the scan. More
    queries are cut into blocks by a hash, each with a scan of its own that is written at once. Vectors that are null, empty
    or hold null or non-finite components take no part on either side. Rows of another dimension are an error.
    """
    if limit < 1:
        raise ValueError("limit must be a positive number")
    q = queries.filter(usable(F.col("query_vector"))).select("query_id", as_double(F.col("query_vector")).alias("q"), squared_norm(F.col("query_vector")).alias("qn"))
    x = with_norm(vectors.filter(usable(F.col(vector))), vector).select(F.col(id_).alias("id"), F.col(vector).alias("x"), "sq_norm")
    size = q.agg(F.sum(8 * F.size("q") + 16)).first()[0] or 0
    blocks = math.ceil(size / BLOCK_BYTES)
    if blocks <= 1:
        near = _block(x, q, limit)
    else:
        dealt = F.pmod(F.xxhash64("query_id"), F.lit(2 * blocks))  # hashes are not quite even
        q = shared.materialise(q.withColumn("_block", dealt), "queries")
        parts = [shared.materialise(_block(x, q.filter(F.col("_block") == b).drop("_block"), limit), "nearest") for b in range(2 * blocks)]
        near = reduce(DataFrame.unionByName, parts)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 10), "id"))
    return near.withColumn("vector_rank", rank).filter(F.col("vector_rank") <= limit).select("query_id", "id", "distance", "vector_rank")
