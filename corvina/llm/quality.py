"""Operator 1: quality classifier, a factorisation machine.

Features are hashed words, bucketed structure statistics and metadata (text length; n_chars against it). The pairwise
part is scored in time linear in the features by the identity
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

Defined results: null and empty texts get the score of a text without words; repeated rows equal scores; an empty table
no rows; without labelled rows every score is 0.5; other columns are ignored. A doc_id labelled twice counts once, by
its smallest label.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm import common as C

WORD_BUCKETS = 1 << 17
STEPS = 16
OUT = "doc_id long, score double"


def _ratio(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def structure(w: C.Words, n_chars: np.ndarray) -> np.ndarray:
    """Structure statistics and metadata of each text, each as a step from 0 to STEPS - 1."""
    doc = np.repeat(np.arange(w.n), np.diff(w.at))
    size = np.diff(w.at)
    share = lambda mask: _ratio(np.bincount(doc[mask], minlength=w.n), size)
    raw = w.raw
    words = w.per_doc()
    h = w.hashes()
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    d, _, count = C.distinct_in_doc(w.doc, h)
    distinct = np.bincount(d, minlength=w.n)
    most = np.zeros(w.n)
    np.maximum.at(most, d, count)
    pair = C.mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) else h
    inside = w.doc[1:] == w.doc[:-1] if len(h) else np.zeros(0, bool)
    pd, _, _ = C.distinct_in_doc(w.doc[:-1][inside], pair[inside])
    pairs, all_pairs = np.bincount(pd, minlength=w.n), np.bincount(w.doc[:-1][inside], minlength=w.n)
    upper, digit = (raw >= 65) & (raw <= 90), (raw >= 48) & (raw <= 57)
    symbol = ~C.WORD[raw] & (raw > 32) & ~np.isin(raw, [44, 46, 39, 45])
    ratios = [
        share(upper), share(digit), share(symbol), share((raw == 44) | (raw == 46)), share(raw == 10), share(raw == 124), share(raw == 33), share(raw >= 128),
        _ratio(np.bincount(w.doc[again], minlength=w.n), words), 1 - _ratio(distinct, words), _ratio(most, words), 1 - _ratio(pairs, all_pairs),
    ]
    logs = [np.log2(1 + size), np.log2(1 + words), np.log2(1 + np.maximum(n_chars, 0)), 2 * _ratio(w.per_doc(w.end - w.start), words), np.log2(1 + np.abs(n_chars - size))]
    steps = [np.minimum(np.sqrt(x) * STEPS, STEPS - 1).astype(np.int64) for x in ratios] + [np.clip(x, 0, STEPS - 1).astype(np.int64) for x in logs]
    return np.stack(steps, 1) + STEPS * np.arange(len(steps))


N_STATS = 17
SIZE = WORD_BUCKETS + STEPS * N_STATS


def features(column: pa.Array, n_chars: np.ndarray):
    """Per block: document, feature and value triples, in order of the document."""
    w = C.Words(column)
    doc, key, count = C.distinct_in_doc(w.doc, (w.hashes() % np.uint64(WORD_BUCKETS)).astype(np.int64))
    value = np.sqrt(count.astype(float))
    value /= np.sqrt(np.bincount(doc, value * value, w.n))[doc] if len(doc) else 1
    stats = structure(w, n_chars)
    doc = np.concatenate((doc, np.repeat(np.arange(w.n), N_STATS)))
    key = np.concatenate((key, (stats + WORD_BUCKETS).ravel()))
    value = np.concatenate((value, np.full(w.n * N_STATS, 0.5)))
    return w.n, doc, key, value


def fm_score(n: int, doc, key, value, bias: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """w0 + w x + 1/2 sum_f ((V x)_f^2 - (V^2 x^2)_f) for every document, linear in the number of features."""
    out = bias + np.bincount(doc, w[key] * value, n)
    for f in range(v.shape[1]):
        t = v[:, f][key] * value
        out += 0.5 * (np.bincount(doc, t, n) ** 2 - np.bincount(doc, t * t, n))
    return out


def _n_chars(part: pa.RecordBatch) -> np.ndarray:
    return np.asarray(part.column("n_chars").cast(pa.float64()).fill_null(0.0))


def fit(table: pa.Table, factors: int = 4, epochs: int = 6, rate: float = 0.1, seed: int = 7) -> bytes:
    """Train on a table of doc_id, text, n_chars, y by AdaGrad on the logistic loss; the model as npz bytes."""
    rng = np.random.default_rng(seed)
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if table.num_rows else table
    rows, y = [], np.asarray(table.column("y").to_pylist(), float)
    for batch in table.to_batches():
        for part in C.blocks(batch):
            n, doc, key, value = features(part.column("text"), _n_chars(part))
            order = np.argsort(doc, kind="stable")
            cut = np.searchsorted(doc[order], np.arange(n + 1))
            rows += [(key[order[cut[i] : cut[i + 1]]], value[order[cut[i] : cut[i + 1]]]) for i in range(n)]
    bias = 0.0
    w, v = np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, factors))
    gw, gv = np.full(SIZE, 1e-3), np.full((SIZE, factors), 1e-3)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            at, x = rows[i]
            va = v[at]
            t = va * x[:, None]
            s = t.sum(0)
            z = bias + w[at] @ x + 0.5 * float((s * s - (t * t).sum(0)).sum())
            g = float(C.sigmoid(z)) - y[i]
            bias -= 0.02 * g
            d = g * x + 1e-5 * w[at]
            gw[at] += d * d
            w[at] -= rate * d / np.sqrt(gw[at])
            e = g * (x[:, None] * (s - t)) + 1e-4 * va
            gv[at] += e * e
            v[at] = va - 0.3 * rate * e / np.sqrt(gv[at])
    v[gv.sum(1) <= 1.5e-3 * factors] = 0  # rows that no example moved keep no random start
    out = io.BytesIO()
    np.savez_compressed(out, bias=bias, w=w.astype(np.float32), v=v.astype(np.float32))
    return out.getvalue()


def _with_n_chars(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select("doc_id", "text", F.coalesce(n_chars, F.length("text").cast("double")).alias("n_chars"))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, test: tuple[int, int]) -> DataFrame:
    """doc_id, text, n_chars and y of about per_class labelled rows of each class outside the held-out split.

    The sample is drawn on the labels, so the side that is broadcast holds at most 4 * per_class ids.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~C.held_out(*test))
    known = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    sample = C.bounded_sample(known, "y", per_class, ["doc_id"])
    return _with_n_chars(docs).join(F.broadcast(sample), "doc_id").limit(8 * per_class)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000, test: tuple[int, int] = (5, 0)) -> bytes:
    """Fit on about per_class rows of each label (the bound on the sample)."""
    return C.fit_in_task(training_rows(docs, labels, "quality", per_class, test), fit)


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of every row."""

    def run(batches):
        m = np.load(io.BytesIO(model))
        bias, w, v = float(m["bias"]), m["w"], m["v"]
        for batch in batches:
            for part in C.blocks(batch):
                n, doc, key, value = features(part.column("text"), _n_chars(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(C.sigmoid(fm_score(n, doc, key, value, bias, w, v)))], ["doc_id", "score"])

    return _with_n_chars(docs).mapInArrow(run, OUT)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, test: tuple[int, int] = (5, 0), per_class: int = 4000) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs, train(docs, labels, per_class, test))
    return scored.select("doc_id", C.held_out(*test).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
