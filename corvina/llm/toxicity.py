"""Operator 10: toxicity, a logistic classifier with counterfactual regularisation.

Each training text that names an identity group gets a counterfactual twin in which the identity terms are swapped for
others of their list. A labelled corpus may name no group at all, so every other training text is given a mention: one
identity term, its counterpart in the swapped twin, and none in the text itself. The squared changes of the logit
between these are penalised, so that neutral mentions of a group do not raise the score. That matters as features are
also word beginnings, which a group's name may share with an insult. The mentions are bounded by the training sample: one
a text, dealt over the terms that share a feature with the model, as only these can change a score.

Features are the presence of whole words and of word beginnings that are, beyond chance, commoner in
toxic texts; their weights are never negative, so long clean text cannot hide an insult. They are kept as exact 64-bit
hashes, so a word never seen in training adds nothing to a score.

Defined results: null and empty texts get the score of a text without words; repeated rows equal scores; an empty table
no rows; without labelled rows every score is 0.5; other columns are ignored.
"""

from __future__ import annotations

import io
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm import common as C
from corvina.llm.quality import training_rows

#: Lists of identity terms; terms are swapped inside a list.
IDENTITY = (
    ("women", "men", "girls", "boys", "trans", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("moroccan", "algerian", "tunisian", "egyptian", "turkish", "kurdish", "pathan", "punjabi", "bengali", "mexican", "cuban", "polish", "irish", "korean", "somali"),
    ("moroccans", "algerians", "tunisians", "egyptians", "turks", "kurds", "pathans", "punjabis", "bengalis", "mexicans", "cubans", "poles", "koreans", "somalis"),
    ("immigrants", "refugees", "natives", "foreigners", "migrants"),
    ("deaf", "blind", "disabled", "autistic"),
    ("old", "young", "elderly"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
OUT = "doc_id long, score double"
_SWAP = {t: group[(i + 1) % len(group)] for group in IDENTITY for i, t in enumerate(group)}
_TERMS = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, _SWAP), key=len, reverse=True)) + r")(?!\w)", re.I)


def counterfactual(text: str) -> str:
    """The text with every identity term swapped for the next of its list."""
    return _TERMS.sub(lambda m: _SWAP[m[0].lower()], text)


def _keys(column: pa.Array, prefixes=(4, 5, 6)):
    w = C.Words(column)
    doc, key = [w.doc], [w.hashes()]
    for p in prefixes:
        long = w.end - w.start > p
        doc.append(w.doc[long])
        key.append(w.hashes(w.start[long], w.start[long] + p, p))
    return w.n, np.concatenate(doc), np.concatenate(key)


def _rows(texts: list[str]) -> list[np.ndarray]:
    out = []
    for part in C.blocks(pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])):
        n, doc, key = _keys(part.column("text"))
        d, k, _ = C.distinct_in_doc(doc, key)
        cut = np.searchsorted(d, np.arange(n + 1))
        out += [k[cut[i] : cut[i + 1]] for i in range(n)]
    return out


def mention(text: str, term: str) -> str:
    """The text with a neutral mention of a group before it."""
    return f"{term} {text}"


def fit(table: pa.Table, epochs: int = 8, rate: float = 0.15, l1: float = 2e-4, penalty: float = 0.5, prune: float = 0.05, z: float = 3.0, seed: int = 11) -> bytes:
    """Train on a table of doc_id, text, y: AdaGrad with soft thresholds; penalty weighs the counterfactual term.

    The model also holds n_twins, the swapped texts, and n_mentions, the texts given a mention.
    """
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if table.num_rows else table
    texts, y = [x or "" for x in table.column("text").to_pylist()], np.asarray(table.column("y").to_pylist(), float)
    twins = {i: counterfactual(t) for i, t in enumerate(texts) if _TERMS.search(t)}
    rows, twin_rows = _rows(texts), dict(zip(twins, _rows(list(twins.values())) if twins else [], strict=True))
    seen, at = np.unique(np.concatenate([*rows, np.zeros(0, np.uint64)]), return_inverse=True)
    n, toxic = len(y), y.sum()
    of = np.repeat(y, [len(k) for k in rows])
    count, hits = np.bincount(at, minlength=len(seen)), np.bincount(at, of, len(seen))
    p = toxic / max(n, 1)
    seen = seen[(hits >= 2) & (hits - p * count > z * np.sqrt(count * p * (1 - p)))]

    def index(k):
        at = np.searchsorted(seen, k)
        at[at == len(seen)] = 0
        return at[seen[at] == k] if len(seen) else at[:0]

    rows, twin_rows = [index(k) for k in rows], {i: index(k) for i, k in twin_rows.items()}
    of_term = {t: index(k) for t, k in zip(_SWAP, _rows(list(_SWAP)), strict=True)}
    live = [t for t in _SWAP if len(of_term[t])]
    mentioned = {i: live[k % len(live)] for k, i in enumerate(i for i in range(n) if live and i not in twins)}
    w, g, b = np.zeros(len(seen)), np.full(len(seen), 1e-3), 0.0
    positive = y.mean() if len(y) else 0.5
    cost = {1.0: 0.5 / max(positive, 1e-9), 0.0: 0.5 / max(1 - positive, 1e-9)}
    rng = np.random.default_rng(seed)

    def step(at, d):
        g[at] += d * d
        r = rate / np.sqrt(g[at])
        u = w[at] - r * d
        w[at] = np.maximum(u - r * l1, 0)

    def pull(at, other):
        """Lower the squared change of the logit between two texts."""
        more, less = np.setdiff1d(at, other), np.setdiff1d(other, at)
        change = 2 * penalty * float(w[more].sum() - w[less].sum())
        step(more, change)
        step(less, -change)

    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            at = rows[i]
            d = cost[y[i]] * (float(C.sigmoid(b + w[at].sum())) - y[i])
            b -= 0.02 * d
            step(at, d)
            if i in twin_rows:
                pull(at, twin_rows[i])
            elif penalty and i in mentioned:  # the features of mention() are those of the text and of the term
                term = mentioned[i]
                one, two = np.union1d(at, of_term[term]), np.union1d(at, of_term[_SWAP[term]])
                pull(one, two)
                pull(one, at)
    keep = np.abs(w) >= prune
    out = io.BytesIO()
    np.savez_compressed(out, keys=seen[keep], w=w[keep], bias=b, n_twins=len(twins), n_mentions=len(mentioned))
    return out.getvalue()


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000, test: tuple[int, int] = (5, 0)) -> bytes:
    """Fit on about per_class rows of each label (the bound on the sample)."""
    return C.fit_in_task(training_rows(docs, labels, "toxic", per_class, test), fit)


def scorer(model: bytes):
    """A function that scores a column of texts."""
    m = np.load(io.BytesIO(model))
    keys, w, bias = m["keys"], m["w"], float(m["bias"])
    # a bitmap of low hash bits lets most words skip the exact look-up
    near = np.zeros(1 << 20, bool)
    near[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def scores(column: pa.Array) -> np.ndarray:
        n, doc, key = _keys(column)
        hit = near[(key & np.uint64((1 << 20) - 1)).astype(np.int64)]
        doc, key = doc[hit], key[hit]
        at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
        same = keys[at] == key if len(keys) else np.zeros(len(key), bool)
        d, k, _ = C.distinct_in_doc(doc[same], at[same])
        return C.sigmoid(bias + np.bincount(d, w[k] if len(k) else None, n))

    return scores


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier toxic) of every row."""

    def run(batches):
        scores = scorer(model)
        for batch in batches:
            for part in C.blocks(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(scores(part.column("text")))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, OUT)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, test: tuple[int, int] = (5, 0), per_class: int = 4000) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs, train(docs, labels, per_class, test))
    return scored.select("doc_id", C.held_out(*test).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
