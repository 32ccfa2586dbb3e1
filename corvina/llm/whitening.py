"""Embedding whitening: the leading principal components by LOBPCG over a distributed covariance, and vectors whitened by them.

Entries become whole numbers, floor(256 * c), and the covariance V is that of the distinct vectors, which are written once.
Spark multiplies V with a block of columns without forming it: each task centres its rows before multiplying and adds up
(x - S/n) ((x - S/n)' B), and the tasks' sums are added by entry, so what comes to the driver is the product alone, rows of
dimensions x columns, whatever the number of vectors.

LOBPCG: each iteration has a basis of the iterate, its residuals and the previous directions, orthonormalised; one product
of V with it gives the Rayleigh-Ritz problem, whose leading vectors are the next iterate, with residuals V u - e u from the
same product. It ends once the residuals of all wanted components are at most TOLERANCE of the largest eigenvalue, or have
stopped falling at rounding error below CERTIFIED of it; residuals that stay above are an error, not a result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import materialise, release

SCALE = 256
COMPONENTS = 4
#: Columns beside the wanted ones that the iterate carries, so that close eigenvalues are told apart in few iterations.
GUARD = 8
TOLERANCE, CERTIFIED, MOST_ITERATIONS = 1e-14, 1e-10, 500
#: An eigenvalue below this share of the trace is rounding error: the vectors do not vary along it.
FLAT = 1e-12
#: Entries of whole numbers beyond this are refused, as their exact sums would not fit.
LARGEST = 1 << 40
#: Rows that numpy works on at once.
ROWS = 4096


def usable(v: Column) -> Column:
    """Whether a vector takes part: neither null nor empty, without null or non-finite entries."""
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))


def whole_numbers(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x of the rows whose vector takes part."""
    def entry(c: Column) -> Column:
        scaled = F.floor(SCALE * c.cast("double"))
        return F.when(F.abs(SCALE * c.cast("double")) < LARGEST, scaled).otherwise(F.raise_error(F.lit("an entry is too large to be whitened exactly")))

    return rows.filter(usable(F.col(vector))).select("vec_id", F.transform(vector, entry).alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * dims:
        raise ValueError(f"vectors of other than {dims} dimensions")
    return flat.reshape(-1, dims)


def summed(fit: DataFrame, dims: int, part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum of part(block of x) over all rows: one matrix a task, added entry by entry between tasks."""

    def run(batches):
        total = None
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            for at in range(0, len(x), ROWS):
                one = part(x[at : at + ROWS])
                total = one if total is None else total + one
        if total is not None:
            flat = total.reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "v"])

    rows = fit.select("x").mapInArrow(run, f"i long, v {kind}").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows), np.int64 if kind == "long" else np.float64)
    for i, v in rows:
        out[i] = v
    return out


def _orthonormal(blocks: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of the blocks' columns, in their order; columns that add nothing are left out."""
    kept: list[np.ndarray] = []
    for block in blocks:
        for column in block.T:
            size = np.linalg.norm(column)
            if size == 0 or len(kept) == len(column):
                continue
            v = column / size
            for _ in range(3):  # repeated, as one projection leaves rounding errors of close columns
                for k in kept:
                    v = v - (k @ v) * k
                left = np.linalg.norm(v)
                if left < 1e-8:
                    break
                v = v / left
            else:
                kept.append(v)
    return np.column_stack(kept) if kept else blocks[0][:, :0]


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The wanted largest eigenvalues, their unit eigenvectors as columns, the residuals' norms, and the iterations made.

    product(B): the symmetric matrix times B.
    """
    size = min(dims, wanted + GUARD)
    x = np.random.default_rng(seed).standard_normal((dims, size))
    residual, direction = x[:, :0], x[:, :0]
    best, stalled = np.inf, 0
    for iteration in range(1, MOST_ITERATIONS + 1):
        # the iterate is the first block of the basis, so that the later coordinates are the step away from it
        basis = _orthonormal([x, residual, direction])
        image = product(basis)
        small = basis.T @ image
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1][:size], vectors[:, ::-1][:, :size]
        step = vectors.copy()
        step[: min(size, len(step))] = 0
        direction = basis @ step
        x = basis @ vectors
        residual = image @ vectors - x * values
        norms = np.linalg.norm(residual, axis=0)[:wanted]
        scale = max(abs(values[0]), np.finfo(float).tiny)
        worst = norms.max() / scale
        stalled = stalled + 1 if worst > best / 2 else 0
        best = min(best, worst)
        if worst <= TOLERANCE or basis.shape[1] == dims and iteration > 2 or best <= CERTIFIED and stalled >= 4:
            break
    if worst > CERTIFIED:
        raise ArithmeticError(f"residuals of {worst:.1e} after {iteration} iterations")
    return values[:wanted], x[:, :wanted], norms, iteration


def components(fit: DataFrame) -> dict | None:
    """What the distinct vectors fit (x) say: n, the sums S, the trace of V, eigenvalues and vectors, residuals and iterations.

    None of no vectors. Components along which the vectors do not vary are left out.
    """
    head = fit.select(F.size("x")).first()
    if head is None:
        return None
    dims = head[0]
    sums = summed(fit, dims, lambda x: np.append(x.sum(0), len(x)), "long")
    n, s = int(sums[-1]), sums[:-1]
    mean = s / n
    variances = summed(fit, dims, lambda x: ((x - mean) ** 2).sum(0)) / n
    trace = float(variances.sum())
    found = {"n": n, "sums": s, "mean": mean, "trace": trace, "values": np.zeros(0), "vectors": np.zeros((dims, 0)), "residuals": np.zeros(0), "iterations": 0}
    if trace <= 0:
        return found

    def product(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ block)

        return summed(fit, dims, part).reshape(dims, -1) / n

    values, vectors, residuals, iterations = lobpcg(product, dims, min(COMPONENTS, dims))
    live = values > FLAT * trace
    values, vectors, residuals = values[live], vectors[:, live], residuals[live]
    # one sign for all rows: the largest entry of a component is positive
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    return found | {"values": values, "vectors": vectors, "residuals": residuals, "iterations": iterations}


def identity_error(fit: DataFrame, model: dict) -> float:
    """The largest entry of the whitened distinct vectors' covariance minus the identity."""
    mean, matrix = model["mean"], model["vectors"] / np.sqrt(model["values"])
    k = matrix.shape[1]

    def part(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ matrix
        return np.append(w.T @ w, w.sum(0))

    got = summed(fit, len(mean), part) / model["n"]
    covariance = got[: k * k].reshape(k, k) - np.outer(got[k * k :], got[k * k :])
    return float(np.abs(covariance - np.eye(k)).max())


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"


def whiten(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error and residual of every vector that takes part.

    Rows that repeat a vec_id or a vector each have their own; equal vectors count once in the fit. Vectors that do not vary
    along four directions have fewer components, one vector alone none. Vectors of several dimensions, entries of more than
    2^40 and deviations beyond a long are errors. An empty table gives no rows.
    """
    spark = rows.sparkSession
    taken = whole_numbers(rows, vector)
    fit = materialise(taken.select("x").distinct(), "whitening")
    model = components(fit)
    if model is None or not len(model["values"]):
        release(fit)
        return spark.createDataFrame([], OUT)
    error = identity_error(fit, model)
    release(fit)
    n, sums, mean, scaled = model["n"], model["sums"], model["mean"], model["vectors"] / np.sqrt(model["values"])
    explained, residuals, k, dims = model["values"] / model["trace"], model["residuals"], len(model["values"]), len(mean)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            for at in range(0, len(x), ROWS):
                block, ids = x[at : at + ROWS], batch.column("vec_id").slice(at, ROWS)
                spread = np.abs(block).max(initial=0) * n + np.abs(sums).max()
                if dims * float(spread) ** 2 < 2.0**62:
                    deviation = ((n * block - sums) ** 2).sum(1)
                else:  # whole numbers of any size; one beyond a long fails as it is written
                    deviation = ((n * block.astype(object) - sums.astype(object)) ** 2).sum(1)
                whitened = (block - mean) @ scaled
                each = lambda v: pa.array(np.tile(v, len(block)))
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(np.repeat(np.arange(len(block)), k))), each(np.arange(1, k + 1, dtype=np.int32)), pa.array(np.full(len(block) * k, n)), pa.array(np.repeat(deviation, k).tolist(), pa.int64()),
                    pa.array(whitened.reshape(-1)), each(explained), pa.array(np.full(len(block) * k, error)), each(residuals),
                ], [c.split()[0] for c in OUT.split(", ")])

    return taken.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, OUT)
