"""Operator 7: language identification by hierarchical discrimination.

A linear classifier first names the language family, then one-versus-one linear support vector machines (hinge
loss) separate the languages inside it. Both score hashed byte trigrams, 4-grams and words by their mean weight over
the whole text, so a document of any length costs one pass and no shuffle.

Defined results: a null text, and one without any letter, is ``und`` with score 0; repeated and tied rows give equal
rows; an empty table gives no rows; with no training rows every text is ``und``; other columns are ignored.
"""

from __future__ import annotations

import io
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvina.llm import common as C

#: Fixed value: families of some languages; a language that is not listed is a family of its own.
FAMILIES = {
    **dict.fromkeys(("en", "de", "nl", "sv", "da", "no", "is", "af"), "germanic"),
    **dict.fromkeys(("fr", "es", "it", "pt", "ro", "ca", "gl"), "romance"),
    **dict.fromkeys(("ru", "pl", "cs", "uk", "bg", "sr", "hr", "sk", "sl"), "slavic"),
}
BUCKETS = 1 << 16
UNDETERMINED = "und"


def _features(column: pa.Array):
    """Three arrays of (document, bucket): byte trigrams, 4-grams and words, over letters with one space between."""
    w = C.Words(column)
    letters = C.WORD[w.data] & ~((w.data >= 48) & (w.data <= 57))
    data = np.where(letters, w.data, 32).astype(np.uint32)
    n = len(data)
    doc = np.repeat(np.arange(w.n, dtype=np.int32), np.diff(w.at))
    out = []
    for size, base in ((3, 0), (4, BUCKETS)):
        if n < size:
            out.append((doc[:0], np.zeros(0, np.int32)))
            continue
        h = np.zeros(n - size + 1, np.uint32)
        for i in range(size):
            h = h * np.uint32(0x01000193) ^ data[i : n - size + 1 + i]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        same = doc[: n - size + 1] == doc[size - 1 :]
        out.append((doc[: n - size + 1][same], ((h >> np.uint32(16)).astype(np.int32) + base)[same]))
    out.append((w.doc, (w.hashes() % np.uint64(BUCKETS)).astype(np.int64) + 2 * BUCKETS))
    return w.n, out


def _scores(column: pa.Array, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """weights: classifiers x (3 * BUCKETS). Mean weight of each feature kind, summed."""
    n, kinds = _features(column)
    out = np.tile(bias, (n, 1))
    for doc, bucket in kinds:
        total = np.maximum(np.bincount(doc, minlength=n), 1)
        for k in range(len(weights)):
            out[:, k] += np.bincount(doc, weights[k][bucket], n) / total
    return out


def _svm(rows, y: np.ndarray, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Hinge-loss linear classifier by averaged AdaGrad; y is +1 or -1; rows are (buckets, values) of unit-mean features."""
    w, g, b, total = np.zeros(3 * BUCKETS), np.full(3 * BUCKETS, 1e-6), 0.0, np.zeros(3 * BUCKETS)
    rng, steps, total_b = np.random.default_rng(seed), 0, 0.0
    balance = {1: 0.5 * len(y) / max(1, (y > 0).sum()), -1: 0.5 * len(y) / max(1, (y < 0).sum())}
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            at, x = rows[i]
            if y[i] * (w[at] @ x + b) < 1:
                d = balance[int(y[i])] * y[i] * x
                g[at] += d * d
                w[at] += 0.5 * d / np.sqrt(g[at])
                b += 0.02 * y[i]
        total += w
        total_b += b
        steps += 1
    return total / max(steps, 1), total_b / max(steps, 1)


def fit(table: pa.Table, families: dict[str, str] = FAMILIES, epochs: int = 6) -> bytes:
    """The model of a table of doc_id, text, lang, as the bytes of an npz file."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if table.num_rows else table
    langs = np.array([str(x) for x in table.column("lang").to_pylist()], object)
    rows = []
    for batch in table.to_batches():
        for part in C.blocks(batch):
            n, kinds = _features(part.column("text"))
            found = [[] for _ in range(n)]
            for doc, bucket in kinds:
                d, key, count = C.distinct_in_doc(doc, bucket)
                total = np.maximum(np.bincount(doc, minlength=n), 1)
                cut = np.searchsorted(d, np.arange(n + 1))
                for i in range(n):
                    s = slice(cut[i], cut[i + 1])
                    found[i].append((key[s].astype(np.int32), (count[s] / total[i]).astype(np.float32)))
            rows += [(np.concatenate([a for a, _ in x]), np.concatenate([b for _, b in x])) for x in found]
    names = sorted(set(langs))
    family = {x: families.get(x, x) for x in names}
    groups = sorted(set(family.values()))
    members = {g: [x for x in names if family[x] == g] for g in groups}
    tasks = []  # (kind, a, b): family g against the rest, or language a against b
    if len(groups) > 1:
        tasks += [("family", g, "") for g in groups]
    for g in groups:
        tasks += [("pair", a, b) for a, b in combinations(members[g], 2)]
    weights, bias = [], []
    for k, (kind, a, b) in enumerate(tasks):
        y = np.where([family[x] == a for x in langs], 1, -1) if kind == "family" else np.where(langs == a, 1, np.where(langs == b, -1, 0))
        use = np.flatnonzero(y)
        w, c = _svm([rows[i] for i in use], y[use], epochs, k)
        weights.append(w.astype(np.float32))
        bias.append(c)
    out = io.BytesIO()
    np.savez_compressed(out, names=np.array(names, str), groups=np.array(groups, str), of=np.array([groups.index(family[x]) for x in names], int), kinds=np.array([t[0] for t in tasks], str), a=np.array([t[1] for t in tasks], str), b=np.array([t[2] for t in tasks], str), weights=np.array(weights, np.float32).reshape(len(tasks), 3 * BUCKETS), bias=np.array(bias))
    return out.getvalue()


def _predict(m, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    names, groups = m["names"], list(m["groups"])
    if not len(names):
        return np.full(len(column), UNDETERMINED, object), np.zeros(len(column))
    s = 2 * _scores(column, m["weights"], m["bias"])
    n = len(s)
    which = [i for i, k in enumerate(m["kinds"]) if k == "family"]
    if which:
        e = C.sigmoid(s[:, which])
        best = e.argmax(1)
        # the winner's own probability, by how far it stands from the next; the number of families does not enter
        first, second = np.sort(e, 1)[:, -1], np.sort(e, 1)[:, -2]
        p_family = first * first / (first + second)
    else:
        best, p_family = np.zeros(n, int), np.ones(n)
    votes, margin = np.zeros((n, len(names))), np.zeros((n, len(names)))
    index = {x: i for i, x in enumerate(names)}
    for i, kind in enumerate(m["kinds"]):
        if kind == "pair":
            a, b, p = index[m["a"][i]], index[m["b"][i]], C.sigmoid(s[:, i])
            votes[:, a] += p > 0.5
            votes[:, b] += p <= 0.5
            margin[:, a] += p
            margin[:, b] += 1 - p
    inside = m["of"][None, :] == best[:, None]
    rank = np.where(inside, votes + margin / (len(names) + 1), -1)
    choice = rank.argmax(1)
    rivals = np.maximum(inside.sum(1) - 1, 0)
    p_lang = np.where(rivals > 0, margin[np.arange(n), choice] / np.maximum(rivals, 1), 1.0)
    return names[choice].astype(object), p_family * p_lang


def train(docs: DataFrame, per_language: int = 1000, keep=None) -> bytes:
    """Fit on about per_language labelled rows of each language (the bound on the sample); keep is an extra filter."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    if keep is not None:
        rows = rows.filter(keep)
    return C.fit_in_task(C.bounded_sample(rows, "lang", per_language, ["doc_id", "text"]), fit)


def languages(model: bytes) -> list[str]:
    """The languages that a model can tell."""
    return np.load(io.BytesIO(model))["names"].tolist()


def label(docs: DataFrame, model: bytes) -> DataFrame:
    """docs with two more columns, last: the language and its score, named _lang_pred and _lang_score or the like."""
    given, docs = docs.columns, C.plainly_named(docs)
    can, lang_pred, lang_score = (C.free_name(docs, n) for n in ("_can", "_lang_pred", "_lang_score"))
    schema = T.StructType([*docs.schema.fields, T.StructField(can, T.BooleanType()), T.StructField(lang_pred, T.StringType()), T.StructField(lang_score, T.DoubleType())])

    def run(batches):
        m = dict(np.load(io.BytesIO(model)))
        for batch in batches:
            for part in C.blocks(batch):
                lang, score = _predict(m, part.column("text"))
                none = ~np.asarray(part.column(part.num_columns - 1), bool) | (lang == UNDETERMINED)
                added = [pa.array(np.where(none, UNDETERMINED, lang), pa.string()), pa.array(np.where(none, 0.0, score))]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, lang_pred, lang_score])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn(can, lettered).mapInArrow(run, schema).drop(can).toDF(*given, lang_pred, lang_score)


def predict(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs."""
    return label(docs.select("doc_id", "text"), model).select("doc_id", F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"))


def identify(docs: DataFrame, per_language: int = 1000, test: tuple[int, int] = (4, 2)) -> DataFrame:
    """Learn from the rows outside the held-out split, then label every row: doc_id, held_out, lang_pred, score."""
    model = train(docs, per_language, ~C.held_out(*test))
    return predict(docs, model).select("doc_id", C.held_out(*test).alias("held_out"), "lang_pred", "score")
