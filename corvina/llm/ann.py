"""Operator 2: approximate nearest neighbours by learned partitions.

On a bounded sample of vectors a neighbour graph is built and cut into balanced partitions, by balanced bisection and
moves that lower the cut within a size limit. A small softmax classifier learns the partition of a vector. It files
every row under its most probable partition, and routes a query to its most probable partitions, whose rows are then
ranked by exact cosine. How much probability the visited partitions must sum to is set on sample rows kept from
training, so that they find the wanted share of their true neighbours; a query visits on until the partitions it has
visited hold k rows besides itself, so it never gets fewer than there are. The number of partitions grows with the
square root of the rows, from 16 to MOST_PARTS, and the sample with it. Partitions are dealt in blocks of bounded size,
so a crowded one is many tasks.

Defined results: vectors that are null, empty, zero or hold null, NaN or infinite components take no part, nor do rows
without id; of rows with one id the smallest vector counts; only vectors of a query's own dimension are candidates; ties
go to the smaller id. Vectors of another dimension than the sample's commonest are filed under partition 0.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm import common as C
from corvina.llm.topk import best, fewest_equal, usable

SCHEMA = "id long, v array<double>, dim int, parts array<int>"
#: Bounds of the router: its partitions, the sample rows for each of them, and the least sample.
LEAST_PARTS, MOST_PARTS, SAMPLE_OF_PART, LEAST_SAMPLE = 16, 256, 75, 6000


def parts_for(n: int) -> int:
    """Partitions for n rows: half the square root, within the bounds."""
    return int(min(MOST_PARTS, max(LEAST_PARTS, round(n**0.5 / 2))))


#: Most queries and vectors of a block, and the shards that partitions are dealt to: a task ranks a query once for a shard.
QUERIES, VECTORS, SHARDS = 16_384, 16_384, 16


def by_block(queries: DataFrame, vectors: DataFrame, n_queries: int, n_vectors: int, search, schema: str) -> DataFrame:
    """Run search(vectors, queries), two pandas frames, for every pair of blocks of a shard, of n_vectors rows at most."""
    i, j = max(1, math.ceil(n_vectors / VECTORS)), max(1, math.ceil(n_queries / QUERIES))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = vectors.withColumn("shard", F.col("part") % SHARDS).withColumn("i", deal(i)).withColumn("j", spread(j))
    shards = F.array_distinct(F.transform("parts", lambda p: p % SHARDS))
    right = queries.withColumn("shard", F.explode(shards)).withColumn("j", deal(j)).withColumn("i", spread(i))
    key = ["dim", "shard", "i", "j"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, schema)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def balanced_partition(x: np.ndarray, parts: int, neighbours: int = 10, sweeps: int = 8) -> np.ndarray:
    """Partition of every row of x, each of about equal size and cutting few edges of the neighbour graph."""
    n = len(x)
    near = np.zeros((n, min(neighbours, max(n - 1, 1))), np.int64)
    for at in range(0, n, 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        near[at : at + 512] = np.argpartition(-s, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
    label = np.zeros(n, np.int64)
    groups = [np.arange(n)]
    while len(groups) < parts:  # halve along the main direction
        groups.sort(key=len)
        g = groups.pop()
        if len(g) < 2:
            break
        y = x[g] - x[g].mean(0)
        side = y @ np.linalg.svd(y, full_matrices=False)[2][0]
        order = np.argsort(side, kind="stable")
        groups += [g[order[: len(g) // 2]], g[order[len(g) // 2 :]]]
    for i, g in enumerate(groups):
        label[g] = i
    k = len(groups)
    a = np.repeat(np.arange(n), near.shape[1])
    ends = np.concatenate((a, near.ravel())), np.concatenate((near.ravel(), a))
    limit = int(1.1 * n / k) + 1
    for _ in range(sweeps):
        tie = np.zeros((n, k))
        np.add.at(tie, (ends[0], label[ends[1]]), 1)
        gain = tie.max(1) - tie[np.arange(n), label]
        size, moved = np.bincount(label, minlength=k), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            to = int(tie[i].argmax())
            if size[to] < limit:
                size[label[i]] -= 1
                size[to] += 1
                label[i] = to
                moved += 1
        if not moved:
            break
    return label


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def needed(x: np.ndarray, w: np.ndarray, b: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """For the k nearest of each of rows, the probability of all partitions more probable than the neighbour's own."""
    s = x[rows] @ x.T
    s[np.arange(len(rows)), rows] = -np.inf
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    part, p = (x @ w + b).argmax(1), softmax(x[rows] @ w + b)
    own = np.take_along_axis(p, part[near], 1)
    return (p[:, None, :] * (p[:, None, :] > own[:, :, None])).sum(2).ravel()


def fit(table: pa.Table, parts: int, recall: float, k: int = 5, steps: int = 400, rate: float = 8.0) -> bytes:
    """Partition a sample of id, v and train the softmax router on it; npz bytes of weights, bias and probability.

    Every fourth row is kept from training; the probability finds the wanted share of neighbours for these and for the rest.
    """
    out = io.BytesIO()
    rows = sorted(zip(table.column("id").to_pylist(), table.column("v").to_pylist(), strict=True)) if table.num_rows else []
    dims = [len(v) for _, v in rows]
    dim = max(set(dims), key=lambda d: (dims.count(d), -d)) if dims else 1
    x = np.array([v for _, v in rows if len(v) == dim], float).reshape(-1, dim)
    w, b, probability = np.zeros((dim, 1)), np.zeros(1), 2.0
    if len(x):
        x = unit(x)
        kept = np.arange(len(x)) % 4 == 3
        t = x[~kept]
        label = balanced_partition(t, parts)
        n = label.max() + 1
        w, b = np.stack([t[label == i].mean(0) for i in range(n)], 1) * 4, np.zeros(n)
        y = np.eye(n)[label]
        for _ in range(steps):
            p = (softmax(t @ w + b) - y) / len(t)
            w -= rate * (t.T @ p + 1e-5 * w)
            b -= rate * p.sum(0)
        for _ in range(60):  # even out what is filed under each partition
            size = np.bincount((t @ w + b).argmax(1), minlength=n)
            b -= 0.1 * np.log((size + 1) / (len(t) / n + 1))
        if kept.sum() >= 25 and len(x) > k:
            own = [np.quantile(needed(x, w, b, np.flatnonzero(g)[:2000], k), recall, method="higher") for g in (kept, ~kept)]  # rows it learned from look surer
            probability = 2.0 if recall >= 1 else float(max(own)) + 1e-9
    np.savez(out, w=w, b=b, probability=probability)
    return out.getvalue()


def build(rows: DataFrame, parts: int, sample: int, recall: float) -> bytes:
    """The router, fitted on about sample rows of id, v (the documented bound)."""
    return C.fit_in_task(C.bounded_sample(rows.select("id", "v", F.lit(0).alias("all")), "all", sample, ["id"]).select("id", "v"), lambda t: fit(t, parts, recall))


def route(rows: DataFrame, router: bytes, probability: float | None, sizes: np.ndarray | None = None, least: int = 0) -> DataFrame:
    """rows with parts: the most probable partitions, as many as reach a probability (0: the first; None: the router's own).

    sizes: the rows of each partition; the partitions of a row go on until they hold least rows, or all.
    """

    def run(batches):
        m = np.load(io.BytesIO(router))
        w, b = m["w"], m["b"]
        wanted = float(m["probability"]) if probability is None else probability
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = np.asarray(batch.column("dim"))
            parts = [[0]] * len(dims)
            known = np.flatnonzero(dims == len(w))
            if len(known):
                x = unit(np.asarray(batch.column("v").take(pa.array(known)).flatten()).reshape(-1, len(w)))
                p = softmax(x @ w + b)
                order = np.argsort(-p, axis=1, kind="stable")
                short = np.cumsum(np.take_along_axis(p, order, 1), 1) < wanted
                if sizes is not None:
                    short |= np.cumsum(sizes[order], 1) < least
                n = np.minimum(short.sum(1) + 1, p.shape[1])
                for i, row, m in zip(known.tolist(), order, n.tolist(), strict=True):
                    parts[i] = row[:m].tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "v", "dim")), pa.array(parts, pa.list_(pa.int32()))], ["id", "v", "dim", "parts"])

    return rows.select("id", "v", "dim").mapInArrow(run, SCHEMA)


def rank_block(ids: np.ndarray, x: np.ndarray, parts: np.ndarray, query_ids: np.ndarray, q: np.ndarray, visits: list, k: int, chunk: int = 64) -> list[tuple]:
    """(query_id, vec_id, cosine) of each query's k best rows in the partitions it visits.

    Scores of the nearest are taken anew, pair by pair, before they are ranked.
    """
    order = np.argsort(parts, kind="stable")
    ids, x, parts = ids[order], x[order], parts[order]
    names, first = np.unique(parts, return_index=True)
    last = np.append(first[1:], len(ids))
    visited = np.array([np.isin(names, v) for v in visits])
    out, ux, uq = [], unit(x), unit(q)
    norm = np.sqrt((x * x).sum(1))
    for at in range(0, len(q), chunk):
        s = np.full((len(q[at : at + chunk]), len(ids)), -np.inf)
        for p, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
            rows = np.flatnonzero(visited[at : at + chunk, p])
            if len(rows):
                s[rows, a:b] = uq[at + rows] @ ux[a:b].T
        for row in range(len(s)):
            qi, qv = query_ids[at + row], q[at + row]
            s[row, ids == qi] = -np.inf
            m = min(k, len(ids))
            near = np.flatnonzero((s[row] >= np.partition(s[row], len(ids) - m)[len(ids) - m] - 1e-9) & (s[row] > -np.inf))
            exact = (x[near] * qv).sum(1) / (norm[near] * np.sqrt((qv * qv).sum()))
            bad = ~np.isfinite(exact) | (norm[near] < 1e-150)
            exact = np.where(bad, (ux[near] * uq[at + row]).sum(1), exact)  # squares out of a double's range
            top = np.lexsort((ids[near], -exact))[:k]
            out += [(int(qi), int(i), float(e)) for i, e in zip(ids[near][top], exact[top], strict=True)]
    return out


def search(df: DataFrame, k: int = 5, every: int = 50, parts: int | None = None, recall: float = 0.96, sample: int | None = None, id_: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """What nearest() returns, and the routed queries (id, dim, part and n_rows, the rows of this partition)."""
    whole = C.materialise(usable(df, id_, vector, False), "vectors")
    parts = parts or parts_for(whole.count())
    router = build(whole, parts, sample or max(LEAST_SAMPLE, SAMPLE_OF_PART * parts), recall)
    rows = C.materialise(route(fewest_equal(whole, k), router, 0.0).select("id", "v", "dim", F.col("parts")[0].alias("part")), "filed")
    held = rows.groupBy("dim", "part").agg(F.count("*").alias("n_rows"))
    dim, n_parts = np.load(io.BytesIO(router))["w"].shape
    sizes = np.zeros(n_parts, np.int64)
    for part, n in held.filter(F.col("dim") == dim).select("part", "n_rows").collect():  # one row for each partition
        sizes[part] = n
    queries = C.materialise(route(whole.filter(F.col("id") % every == 0), router, None, sizes, k + 1), "routed")
    C.release(whole)

    def ranked(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(v) and len(q):
            x, y = (np.stack(f["v"].to_list()).astype(float) for f in (v, q))
            found = rank_block(v["id"].to_numpy(), x, v["part"].to_numpy(), q["id"].to_numpy(), y, q["parts"].to_list(), k)
        return pd.DataFrame({"query_id": pd.Series([f[0] for f in found], dtype="int64"), "vec_id": pd.Series([f[1] for f in found], dtype="int64"), "score": pd.Series([f[2] for f in found], dtype="float64")})

    fullest = held.groupBy("dim", F.col("part") % SHARDS).agg(F.sum("n_rows").alias("n")).agg(F.max("n")).first()[0] or 0
    found = by_block(queries, rows, queries.count(), fullest, ranked, "query_id long, vec_id long, score double")
    return best(found, k), queries.select("id", "dim", F.explode("parts").alias("part")).join(F.broadcast(held), ["dim", "part"])


def nearest(df: DataFrame, k: int = 5, every: int = 50, parts: int | None = None, recall: float = 0.96, sample: int | None = None, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """k nearest found of every row whose id is divisible by every: query_id, rank, vec_id, score (cosine).

    recall: the share of neighbours that the routing is set to find; 1 or more visits every partition. parts and sample:
    the router's partitions and training rows; by default they grow with the rows (parts_for, SAMPLE_OF_PART).
    """
    return search(df, k, every, parts, recall, sample, id_, vector)[0]
