"""Classifiers against their split and held-out labels, vector searches against brute force, and the pipeline."""

import io
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvina.llm import ann, common, language, packing, quality, queries, topk, toxicity

from .conftest import EDGES


@pytest.fixture(scope="module")
def sf01(sf):
    return sf.replace("sf0.001", "sf0.01")


def auc(score, y):
    order = score.rank()
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


# ---- factorisation machine


def test_fm_identity():
    rng = np.random.default_rng(0)
    w, v = rng.normal(size=9), rng.normal(size=(9, 3))
    doc, key, value = np.array([0, 0, 0, 2, 2]), np.array([1, 4, 7, 0, 8]), rng.normal(size=5)
    got = quality.fm_score(3, doc, key, value, 0.3, w, v)
    for d in range(3):
        x = np.zeros(9)
        x[key[doc == d]] = value[doc == d]
        pairs = sum(v[i] @ v[j] * x[i] * x[j] for i in range(9) for j in range(i))
        assert math.isclose(got[d], 0.3 + w @ x + pairs, abs_tol=1e-12)


def plain_features(text, n_chars):
    """Features of a text for the factorisation machine, by plain counts."""
    raw, words = text.encode(), plain_words(text)
    counts = Counter(plain_hash(w) % quality.WORD_BUCKETS for w in words)
    norm = math.sqrt(sum(counts.values())) or 1
    out = {k: math.sqrt(n) / norm for k, n in counts.items()}
    share = lambda *which: sum(c in which for c in raw) / max(len(raw), 1)
    word = lambda c: 48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 or c >= 128
    pairs = list(zip(words, words[1:]))
    n = max(len(words), 1)
    ratios = [
        share(*range(65, 91)), share(*range(48, 58)), sum(not word(c) and c > 32 and c not in b",.'-" for c in raw) / max(len(raw), 1), share(44, 46), share(10), share(124), share(33), share(*range(128, 256)),
        sum(a == b for a, b in pairs) / n, 1 - len(set(words)) / n, max(Counter(words).values(), default=0) / n, 1 - len(set(pairs)) / max(len(pairs), 1),
    ]
    logs = [math.log2(1 + len(raw)), math.log2(1 + len(words)), math.log2(1 + max(n_chars, 0)), 2 * sum(map(len, words)) / n, math.log2(1 + abs(n_chars - len(raw)))]
    steps = [min(int(min(math.sqrt(x) * 16, 15)), 15) for x in ratios] + [min(max(int(x), 0), 15) for x in logs]
    return out | {quality.WORD_BUCKETS + 16 * i + s: 0.5 for i, s in enumerate(steps)}


def test_quality_scores_equal_plain_pair_sums(labelled):
    table, texts, _ = labelled
    few = table.slice(0, 300)
    model = quality.fit(few.append_column("n_chars", pa.array([float(len(t or "")) for t in few.column("text").to_pylist()])), epochs=2)
    m = np.load(io.BytesIO(model))
    tried = ["", "One", "BUY NOW!! BUY NOW!! | é\n", "a a a b", *[t[:400] for t in texts[:10]]]
    got = []
    for t in tried:
        x = plain_features(t, len(t))
        v = {k: m["v"][k].astype(float) for k in x}
        keys = list(x)
        pairs = sum(float(v[a] @ v[b]) * x[a] * x[b] for i, a in enumerate(keys) for b in keys[:i])
        got.append(float(m["bias"]) + sum(float(m["w"][k]) * x[k] for k in keys) + pairs)
    n, doc, key, value = quality.features(pa.array(tried), np.array([float(len(t)) for t in tried]))
    assert np.allclose(quality.fm_score(n, doc, key, value, float(m["bias"]), m["w"], m["v"]), got, atol=1e-4)
    assert len({round(x, 6) for x in got}) > 8


@pytest.mark.parametrize(("query", "label", "cut"), [(queries.op1_quality, "quality", 0.3), (queries.op10_toxicity, "toxic", 0.5)])
def test_classifiers_hold_out(spark, sf01, query, label, cut):
    got = query(spark, sf01).toPandas()
    labels = pd.read_parquet(f"{sf01}/labels.parquet")
    assert len(got) == spark.read.parquet(f"{sf01}/documents.parquet").count()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= cut)).all()
    test = got[got.held_out].merge(labels, on="doc_id")
    assert auc(test.score, test[label]) > (0.95 if label == "quality" else 0.8)  # 6 toxic rows at this size


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifier_edges(spark, edges, empty, make, module, label):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)] + [(None, 1, 1), (3, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = module.classify(edges, labels).toPandas()
    assert len(got) == len(EDGES) + 1 and got.score.between(0, 1).all()
    assert got[got.doc_id == 0].score.iloc[0] == got[got.doc_id == 1].score.iloc[0]
    none = module.classify(edges, labels.limit(0)).toPandas()
    assert (none.score == 0.5).all()
    assert module.classify(empty, labels).count() == 0


def test_labels_do_not_reach_scores_of_held_out_rows(spark, make):
    texts = ["good plain prose here"] * 40 + ["BAD!! BAD!! BAD!!"] * 40
    docs = make(texts)
    labels = [(i, int(i < 40), 0) for i in range(80)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    a, b = (quality.classify(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).toPandas().sort_values("doc_id").score.to_numpy() for x in (labels, flipped))
    assert (a == b).all()


def test_counterfactual_penalty_lowers_the_change():
    texts = [f"muslim people are idiot {i}" for i in range(30)] + [f"christian people are kind {i}" for i in range(30)]
    table = pa.table({"doc_id": range(60), "text": texts, "y": [1] * 30 + [0] * 30})

    def change(penalty):
        m = np.load(io.BytesIO(toxicity.fit(table, penalty=penalty)))
        w = dict(zip(m["keys"].tolist(), m["w"].tolist(), strict=True))
        score = lambda t: sum(w.get(k, 0) for k in toxicity._rows([t])[0].tolist())
        return abs(score("the muslim family") - score(toxicity.counterfactual("the muslim family")))

    assert change(5.0) < 0.5 * change(0.0)
    assert toxicity.counterfactual("A Muslim and women") == "A christian and men"


@pytest.fixture(scope="module")
def labelled(sf):
    """Training table and held-out (text, toxic) of the largest given tables."""
    sf1 = sf.replace("sf0.001", "sf0.1")
    rows = pd.read_parquet(f"{sf1}/documents.parquet", columns=["doc_id", "text"]).merge(pd.read_parquet(f"{sf1}/labels.parquet"), on="doc_id").sort_values("doc_id")
    test = np.array([zlib.crc32(str(d).encode()) % 5 == 0 for d in rows.doc_id])
    train = rows[~test]
    table = pa.table({"doc_id": train.doc_id, "text": train.text, "y": train.toxic.astype(int)})
    return table, rows[test].text.fillna("").tolist(), rows[test].toxic.to_numpy()


def test_mentions_of_groups_leave_scores_alone(labelled):
    table, texts, toxic = labelled
    clean = [t for t, y in zip(texts, toxic, strict=True) if not y][:100]
    false, moved = {}, {}
    for penalty in (0.0, 0.5):
        model = toxicity.fit(table, penalty=penalty)
        assert np.load(io.BytesIO(model))["n_mentions"] > 3000  # the given texts name no group
        scores = toxicity.scorer(model)
        plain = scores(pa.array(clean))
        named = np.array([scores(pa.array([toxicity.mention(t, term) for t in clean])) for term in ("moroccan", "pathans", "women", "muslim")])
        false[penalty], moved[penalty] = (named >= 0.5).mean(), np.abs(named - plain).max()
        got = scores(pa.array(texts))
        assert (got[toxic == 1] >= 0.5).mean() > 0.9 and (got[toxic == 0] >= 0.5).mean() < 0.02
    assert moved[0.5] < 0.01 < 0.1 < moved[0.0]  # moron and pathetic share their beginnings with these names
    assert false[0.5] < false[0.0] and false[0.5] <= (plain >= 0.5).mean()


def plain_hash(word, salt=0):
    """The hash of common.Words in plain integers."""
    m = 2**64
    h = sum((c + 1) * pow(common._P, i, m) for i, c in enumerate(word)) + salt * 0x632BE59BD9B4E019
    h = (h % m ^ h % m >> 31) * 0xBF58476D1CE4E5B9 % m
    return h ^ h >> 29


def plain_words(text):
    low = bytes(c + 32 if 65 <= c < 91 else c for c in text.encode())
    return re.findall(rb"[0-9a-z\x80-\xff]+", low)


def test_toxicity_scores_equal_plain_sums(labelled):
    table, texts, _ = labelled
    model = toxicity.fit(table.slice(0, 900))
    m = np.load(io.BytesIO(model))
    w = dict(zip(m["keys"].tolist(), m["w"].tolist(), strict=True))
    texts = ["", "idiot", "Idiots, and a STUPID clown", "moron ÉCOLE", *texts[:12]]
    want = []
    for t in texts:
        found = {(0, x) for x in plain_words(t)} | {(p, x[:p]) for x in plain_words(t) for p in (4, 5, 6) if len(x) > p}
        want.append(1 / (1 + math.exp(-float(m["bias"]) - sum(w.get(plain_hash(x, p), 0) for p, x in found))))
    assert np.allclose(toxicity.scorer(model)(pa.array(texts)), want, atol=1e-12) and len(set(want)) > 3


# ---- language


def test_language_holds_out(spark, sf01):
    got = queries.op7_language(spark, sf01).toPandas()
    docs = spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "lang").toPandas()
    test = got.merge(docs, on="doc_id")
    assert (test.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in test.doc_id]).all()
    assert (test[test.held_out].lang_pred == test[test.held_out].lang).mean() > 0.95
    assert got.score.between(0, 1).all()


def plain_language(model, text):
    """The language of a text and its score by plain sums, one document and one pair of languages at a time."""
    m = np.load(io.BytesIO(model))
    low = bytes(c + 32 if 65 <= c < 91 else c for c in text.encode())
    line = bytes(c if 97 <= c < 123 or c >= 128 else 32 for c in low)

    def bucket(gram):
        h = 0
        for c in gram:
            h = (h * 0x01000193 ^ c) % 2**32
        return ((h ^ h >> 15) * 0x85EBCA6B % 2**32) >> 16

    kinds = [[bucket(line[i : i + n]) + base for i in range(len(line) - n + 1)] for n, base in ((3, 0), (4, 1 << 16))]
    kinds.append([plain_hash(w) % (1 << 16) + (2 << 16) for w in plain_words(text)])
    score = [float(b) + sum(float(np.mean([w[k] for k in keys])) for keys in kinds if keys) for w, b in zip(m["weights"], m["bias"], strict=True)]
    p = [1 / (1 + math.exp(-2 * s)) for s in score]
    family = {g: x for kind, g, x in zip(m["kinds"], m["a"], p, strict=True) if kind == "family"}
    best = max(family, key=family.get)
    members = [n for n, g in zip(m["names"], m["of"], strict=True) if m["groups"][g] == best]
    won, sure = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
    for kind, a, b, x in zip(m["kinds"], m["a"], m["b"], p, strict=True):
        if kind == "pair" and a in won:
            won[a if x > 0.5 else b] += 1
            sure[a] += x
            sure[b] += 1 - x
    choice = max(members, key=lambda n: (won[n], sure[n]))
    first, second = sorted(family.values())[-1:-3:-1]
    return choice, first * first / (first + second) * (sure[choice] / (len(members) - 1) if len(members) > 1 else 1)


def test_language_votes_equal_plain_ones():
    texts = {"en": "the cat and the dog sat on this mat", "de": "der hund und die katze auf dem tisch", "nl": "de hond en het kind op een stoel", "fr": "le chat et le chien sur la table", "es": "el gato y el perro en la mesa", "pl": "kot i pies na stole"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation(t.split())), k) for i, (k, t) in enumerate(list(texts.items()) * 8)]
    model = language.fit(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "lang": [r[2] for r in rows]}))
    tried = [*texts.values(), "Der CHAT y the dog 12", "zzz", "é", "la de en", "hund chien perro pies"]
    lang, score = language._predict(dict(np.load(io.BytesIO(model))), pa.array(tried))
    want = [plain_language(model, t) for t in tried]
    assert lang.tolist() == [w[0] for w in want] and np.allclose(score, [w[1] for w in want], atol=1e-9)
    assert lang[:6].tolist() == list(texts)


def test_language_edges(edges, empty, make):
    got = language.identify(edges).toPandas()
    assert len(got) == len(EDGES) + 1 and (got.lang_pred == "und").all()
    assert language.identify(empty).count() == 0
    texts = ["the cat sat on the mat", "le chat est sur la table"] * 20 + [None, "1 2 3 !", ""]
    docs = make(texts, langs={i: ["en", "fr"][i % 2] for i in range(40)} | {41: "en"})
    got = language.identify(docs).toPandas().set_index("doc_id")
    assert (got.lang_pred[:40] == ["en", "fr"] * 20).all() and (got.lang_pred[40:] == "und").all() and (got.score[40:] == 0).all()


# ---- vectors


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, v string")


def brute_top(vectors, every, k, score):
    out = []
    for q, a in vectors.items():
        if q % every == 0:
            best = sorted((-score(a, b), i) for i, b in vectors.items() if i != q and len(b) == len(a))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def whole(a, b):
    return sum(math.floor(1024 * x) * math.floor(1024 * y) for x, y in zip(a, b, strict=True))


def cosine(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def loaded(spark, sf):
    return {r.vec_id: list(r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}


def test_exact_top_k(spark, sf, monkeypatch):
    got = sorted(map(tuple, queries.op6_topk(spark, sf).collect()))
    want = brute_top(loaded(spark, sf), 100, 10, whole)
    assert got == want
    for name, size in (("BLOCK_BYTES", 512 * 50), ("QUERY_BLOCK_BYTES", 512), ("GROUP_BYTES", 520)):
        monkeypatch.setattr(topk, name, size)
    assert sorted(map(tuple, queries.op6_topk(spark, sf).collect())) == want


def test_few_exact_vectors_are_read(spark, sf):
    df = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    found, read = topk.search(df)
    n, queries_ = df.count(), df.filter("vec_id % 100 = 0").count()
    assert found.count() == 10 * queries_ and 10 * queries_ <= read < 0.02 * n * queries_


def test_cells_bound_every_product():
    rng = np.random.default_rng(3)
    x, q = np.floor(rng.normal(0, 300, (400, 24))), np.floor(rng.normal(0, 300, (30, 24)))
    x[:, 3], x[:, 4] = 7, rng.integers(0, 2, 400) * 1e9
    low, high = topk.bounds(q, *topk.cells(x))
    assert (low <= q @ x.T).all() and (q @ x.T <= high).all()


VECTORS = [(0, [1.0, 0.5]), (100, [0.5, 1.0]), (200, None), (300, [None, 1.0]), (400, [float("nan"), 1.0]), (500, [float("inf"), 1.0]), (600, [0.0, 0.0]), (700, []), (800, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (3, [0.5, 1.0]), (0, [1.0, 0.5])]


def test_vector_edges(spark):
    df = frame(spark, [(i, v, 1, "x") for i, v in VECTORS] + [(1000 + i, [0.25, 0.25], 1, "x") for i in range(40)])
    usable = {0: [1.0, 0.5], 100: [0.5, 1.0], 600: [0.0, 0.0], 800: [1.0, 2.0, 3.0], 3: [0.5, 1.0]} | {1000 + i: [0.25, 0.25] for i in range(40)}
    assert sorted(map(tuple, topk.top_k(df).collect())) == brute_top(usable, 100, 10, whole)
    del usable[600]
    got = sorted(map(tuple, ann.nearest(df, every=100, recall=1.0).collect()))
    want = brute_top(usable, 100, 5, cosine)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)
    assert topk.top_k(df.limit(0)).count() == 0 and ann.nearest(df.limit(0)).count() == 0


def test_huge_components_stay_exact(spark):
    df = frame(spark, [(0, [3e7, 1.0], 1, ""), (1, [3e7, 1.0], 1, ""), (2, [3e7, -1.0], 1, ""), (3, [3e30, 1.0], 1, "")])
    got = [tuple(r) for r in topk.top_k(df, k=2).collect()]
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 2, 2**63 - 1)]  # clipped scores tie, so the smaller ids come first
    vast = spark.createDataFrame([(i, [(-1) ** i * 1e308, 1.0 + i]) for i in range(4)], "vec_id long, embedding array<double>")
    got = [tuple(r)[2:] for r in topk.top_k(vast, k=3).collect()]
    assert got == [(2, 2**63 - 1), (1, -(2**63)), (3, -(2**63))]
    df = frame(spark, [(0, [3e5, 0.001], 1, ""), (1, [3e5, 1.0], 1, ""), (2, [3e5, -1.0], 1, "")])
    assert [tuple(r) for r in topk.top_k(df, k=2).collect()] == [(0, 1, 1, (1024 * 300_000) ** 2 + 1024), (0, 2, 2, (1024 * 300_000) ** 2 - 1024)]


def test_recall(spark, sf01):
    vectors = loaded(spark, sf01)
    got = queries.op2_nearest(spark, sf01).collect()
    want = {(q, i) for q, _, i, _ in brute_top(vectors, 50, 5, cosine)}
    assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)
    for r in got:
        assert abs(r.score - cosine(vectors[r.query_id], vectors[r.vec_id])) < 1e-12


@pytest.mark.parametrize("seed", range(2))
def test_small_clusters_get_all_their_neighbours(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = [2, 3, 2, 3, *[40] * 12]
    centres = rng.normal(size=(16, 8)) * 10
    points = np.concatenate([c + 0.01 * rng.normal(size=(n, 8)) for c, n in zip(centres, sizes, strict=True)])
    df = frame(spark, [(i * 5, list(map(float, p)), 1, "x") for i, p in enumerate(points[rng.permutation(len(points))])])
    got = ann.nearest(df, every=5).toPandas()
    assert (got.groupby("query_id").size() == 5).all() and got.query_id.nunique() == len(points)


def test_visited_share_on_clusters(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 32))
    points = centres[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 32))
    df = frame(spark, [(i, list(map(float, p)), 1, "x") for i, p in enumerate(points)])
    found, routed = ann.search(df, every=20)
    got, visits = found.toPandas(), routed.toPandas().groupby("id").n_rows.sum()
    x = ann.unit(points)
    hits = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(g.vec_id) & set(np.argsort(-s)[:5].tolist()))
    assert len(got) == 5 * 200 and hits >= 0.9 * len(got)
    assert len(visits) == 200 and visits.mean() < 0.25 * 4000  # of vectors with structure, a small share is ranked


def test_partitions_are_balanced():
    x = ann.unit(np.random.default_rng(4).normal(size=(800, 16)))
    size = np.bincount(ann.balanced_partition(x, 8))
    assert len(size) == 8 and size.max() <= 1.1 * 100 + 1


# ---- pipeline


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == spark.read.parquet(f"{sf}/documents.parquet").columns, name
        docs = corpus_pipeline.materialise(out, name)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert docs.count() == len(kept[name])
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert kept["language"] == source  # each of the four languages is told
    assert kept["line_dedup"].keys() == kept["language"].keys() and kept["line_dedup"] != kept["language"]
    from .test_text_operators import brute_components, brute_fingerprint, check_packing

    groups = brute_components([(d, brute_fingerprint(t)) for d, t in kept["line_dedup"].items()])
    assert kept["near_duplicates"].keys() == {c for _, _, c in groups}
    assert kept["personal_data"].keys() == kept["near_duplicates"].keys()
    assert not any("@mail" in t for t in kept["personal_data"].values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    bins, least = check_packing(packed, [*kept["personal_data"].items()])
    assert bins <= least + 1


def test_pipeline_keeps_one_row_of_each_component(spark, make):
    text = {n: " ".join(f"{n}{i * k % 97}" for i, k in enumerate([7] * 60)) for n in ("red", "blue", "green", "grey")}
    near = text["red"].replace("red7 ", "red7  ")  # the same words
    rows = [(7, "red"), (7, "blue"), (8, "green"), (3, "green"), (None, "green"), *[(None, "grey")] * 40]
    docs = make([text[t] for _, t in rows] + [near], [i for i, _ in rows] + [9]).repartition(3)
    got = sorted((r.doc_id or 0, r.text.split("0")[0]) for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect())
    assert got == [(0, "grey"), (3, "green"), (7, "blue"), (7, "red")]


def test_pipeline_tells_languages(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    kinds = dict(docs.select("doc_id", "lang").collect())
    unlabelled = docs.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang")))
    other = ["Привет мир как дела сегодня", "日本語のテキストです", "1 2 3 + 4", "", None]
    strange = spark.createDataFrame([(10**9 + i, t, None, "x", 1) for i, t in enumerate(other)], "doc_id long, text string, lang string, source string, n_chars int")
    got = corpus_pipeline.keep_known_languages(spark, unlabelled.unionByName(strange.select(*docs.columns)), "")
    told = {r.doc_id: r.lang for r in got.collect()}
    assert told.keys() == kinds.keys()  # no document goes but those in no language that was learned
    assert sum(told[d] == k for d, k in kinds.items()) > 0.99 * len(kinds)


def test_pipeline_keeps_documents_of_many_languages(spark):
    rng = np.random.default_rng(9)
    letters = list("abcdefghijklmnopqrstuvwxyz")

    def tongue():
        words = ["".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(150)]
        return lambda: " ".join(rng.choice(words, rng.integers(15, 60)))

    tongues = {f"l{i:02}": tongue() for i in range(30)}
    rows = [(i, says(), lang) for i, (lang, says) in enumerate(item for item in tongues.items() for _ in range(60))]
    strange = [(10_000 + i, t, None) for i, t in enumerate(["Привет мир как дела сегодня", "日本語のテキストです"] * 10)]
    rows = [(i, t, lang if i % 3 else None) for i, t, lang in rows]
    told = [lang for lang, _ in (item for item in tongues.items() for _ in range(60))]
    docs = spark.createDataFrame(rows + strange, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.lang for r in corpus_pipeline.keep_known_languages(spark, docs, "").collect()}
    lost = [i for i, _, _ in rows if i not in kept]
    assert len(lost) < 0.01 * len(rows) and sum(kept[i] == told[i] for i in range(len(rows)) if i in kept) > 0.99 * len(rows)
    assert not any(i >= 10_000 for i in kept)


def test_pipeline_stages_on_edges(spark, edges, empty):
    same, words = "same text here and there", "word " * 40_000
    want = {
        # of the languages there is none to learn, so a letter is enough
        "language": [t for t in EDGES if t and any(c.isalpha() for c in t)] + [same],
        "line_dedup": [*EDGES, same],
        "near_duplicates": [None, "one", "a b", words, "x" * 60_000, same, EDGES[-2], EDGES[-1]],
        "personal_data": [*EDGES[:-2], "ÀÉß ﬁ \x1c [IP] 😀", "[PHONE] " * 50, same],
    }
    dotted = edges.withColumn("a.b", F.lit(1)).withColumn("c`d", F.lit(2))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
        got = stage(spark, dotted, "")
        if name in want:
            assert got.columns == dotted.columns, name
            texts = [r.text for r in got.collect()]
            assert sorted(t or "" for t in texts) == sorted(t or "" for t in want[name]), name
    assert packing.best_fit_packing(edges, public_tokenizers.path(queries.WORD_BPE)).count() >= len(EDGES)
