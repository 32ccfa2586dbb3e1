"""Filter audit, Merkle fingerprints and whitening: against SQL, brute force, and the cases that the docstrings define."""

import hashlib
import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corvina.llm import audit, fingerprints, queries, whitening

TABLES = "documents embeddings labels".split()


@pytest.mark.parametrize("name", ["op11_audit", "op12_fingerprints"])
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf), con.sql(queries.ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


# ---- op11


def audited(docs, labels):
    """By the contract, document by document and order by order. docs: (doc_id, text, source)."""
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, t in labels if t == 1} - {None}
    rows = []
    for i, text, source in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        }
        rows.append((source or "", fails, i in good, i in toxic))
    out, shares = {}, {}
    for part in {r[0] for r in rows}:
        of = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = of
            for step, f in enumerate(order, 1):
                here = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                failing = sum(r[1][f] for r in of)
                alone = sum(r[1][f] and sum(r[1].values()) == 1 for r in of)
                out[part, "".join(order), step] = [len(left), len(here), failing - len(here), alone, sum(r[2] for r in here), sum(r[3] for r in here), f]
                shares[part, f] = shares.get((part, f), 0) + len(here)
    return {k: (*v[:-1], shares[k[0], v[-1]]) for k, v in out.items()}


def test_audit_of_edge_cases(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    long_ = " ".join(words)
    docs = [
        (1, None, None), (2, "", ""), (None, "", "s"), (None, long_, "s"), (3, long_, "s"), (4, long_, "s"), (4, long_, "t"), (5, "word " * 50_000, "s"), (6, long_.upper(), "s"), (7, long_ + " $", "t"),
        (8, "A" * 1000, None), (9, " \x1c ".join(words), "s"), (9, "é" * 99 + "A", "t"),
    ] + [(10 + i, " ".join(rng.choice(["Aa", "b", "c#", *words]) for _ in range(rng.choice([5, 250]))), rng.choice("stu")) for i in range(40)]
    labels = [(i % 30, i % 2, i % 3 == 0) for i in range(45)] + [(None, 1, 1), (3, None, None)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, n int, A string")
    marks = spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, quality int, toxic int, good int")
    got = {(r[0], r[1], r[2]): tuple(r[3:]) for r in audit.filter_audit(frame, marks).collect()}
    assert got == audited(docs, labels)
    assert audit.filter_audit(frame.filter("false"), marks).count() == 0
    assert audit.filter_audit(frame, marks.filter("false")).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_audit_of_all_parts(spark, sf):
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    left = audit.survivors(audit.flagged(read("documents"), read("labels")))
    whole = audit.audit(left, whole=True)
    by_part = audit.audit(left)
    sums = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    added = by_part.groupBy("filter_order", "step").agg(*[F.sum(c).alias(c) for c in sums])
    assert whole.count() == 600
    assert whole.select("filter_order", "step", *sums).exceptAll(added).count() == 0


# ---- op12


def tree(text):
    """The fingerprint, and the codes of the distinct pieces, in plain Python."""
    sha = lambda x: hashlib.sha256(x.encode("utf-8")).hexdigest()
    sections, new = [], True
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        cut = re.findall(fingerprints.PIECE, line)
        assert "".join(cut) == line
        codes = [int(sha(p)[:12], 16) * 128 + len(p) for p in cut]
        paragraph = (sha("".join(map(sha, cut))), codes)
        if new or re.match("#{1,6} ", line):
            sections.append([])
        sections[-1].append(paragraph)
        new = bool(re.fullmatch(r"[ \t\r]*\n", line)) or paragraph[0][0] in "0123"
    hashes = [sha("".join(h for h, _ in s)) for s in sections]
    shown = "".join(f"|{h[:16]}:" + ";".join(p[:16] + "=" + ",".join(f"{c:x}" for c in codes) for p, codes in s) for h, s in zip(hashes, sections, strict=True))
    return sha("".join(hashes)) + shown, {c for s in sections for _, codes in s for c in codes}


def alike(a, b):
    weigh = lambda codes: sum(c % 128 for c in codes)
    return 2 * weigh(a & b) / (weigh(a) + weigh(b)) if a or b else 1.0


TEXTS = [
    "", None, "one", "a.b!c?d", "A sentence. Another one...   and more\nSecond paragraph\n\nAfter a blank\n# Heading\ntext under it\n", "x" * 60_000, "." * 500, "\n" * 50, "😀é" * 300 + "\n" + "ß. " * 40,
    "line of text. " * 2000, " ", "one",
]


def test_fingerprints_against_plain_trees(make):
    rng = random.Random(5)
    texts = TEXTS + ["\n".join(" ".join(rng.choice(["ab", "cd.", "ef", "# gh"]) for _ in range(rng.randrange(40))) for _ in range(rng.randrange(20))) for _ in range(30)]
    ids = [7 * i % 101 for i in range(len(texts))]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(make(texts, ids)).collect()}
    ordered = sorted(zip(ids, (t or "" for t in texts), strict=True))
    for at, (i, text) in enumerate(ordered):
        following = ordered[(at + 1) % len(ordered)][1]
        k = len(text) // 4
        edited = text[: len(text) - k] + following[:k]
        r = got[i]
        (own, mine), (other, theirs) = tree(text), tree(edited)
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(text), own, other)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(alike(mine, theirs)) and r.near_next == pytest.approx(alike(mine, tree(following)[1]))
        # what is left outside the found edit is the same in both, and the edit is cut no wider than a piece on each side
        tail = len(text) - r.edit_end
        assert text[: r.edit_start] == edited[: r.edit_start] and tail == len(edited) - r.edited_end
        assert not tail or text[-tail:] == edited[-tail:]
        if edited != text:
            same = next((j for j in range(min(len(text), len(edited))) if text[j] != edited[j]), min(len(text), len(edited)))
            assert same - 64 <= r.edit_start <= same


def test_next_document_over_many_groups(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "GROUP_BYTES", 200)
    rows = [(i * i % 1009, f"text {i} " * 5) for i in range(300)] + [(None, "no id"), (None, "no id either"), (4, "again"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.with_next(docs, {}, ["text"]).collect()
    ordered = sorted(((i if i is not None else 1 << 70, t or "") for i, t in rows))
    want = sorted((t, ordered[(k + 1) % len(ordered)][1]) for k, (_, t) in enumerate(ordered))
    assert sorted((r.text, r.next_text) for r in got) == want
    assert fingerprints.edited_fingerprints(docs.filter("false")).count() == 0
    alone = fingerprints.edited_fingerprints(docs.filter("text = 'no id'")).first()
    assert alone.edited_sha256 == hashlib.sha256(b"no in").hexdigest()


def test_pieces_of_fingerprints(make):
    rows = make([t for t in TEXTS if t]).select(fingerprints.fingerprint(F.col("text")).alias("f"), fingerprints.pieces(fingerprints.sections(F.col("text"))).alias("p"))
    assert rows.filter(fingerprints.pieces_of(F.col("f")) != F.col("p")).count() == 0


# ---- op13


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, x int, component double")


def whitened_by_eigh(rows):
    x = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64) for i, v in rows}
    fit = np.array(sorted({tuple(v) for v in x.values()}), dtype=np.int64)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    values, u = np.linalg.eigh(centred.T @ centred / n)
    values, u = values[::-1], u[:, ::-1]
    k = min(4, int((values > 1e-12 * values.sum()).sum()))
    return {i: (n, sum(int(d) ** 2 for d in n * v - s), (v - s / n) @ u[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()) for i, v in x.items()}


def check_whitening(spark, rows, extra=()):
    got = {}
    for r in whitening.whiten(vectors(spark, [*rows, *extra])).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    want = whitened_by_eigh(rows)
    k = len(next(iter(want.values()))[3])
    signs = {}
    assert got.keys() == (want.keys() if k else set())
    for i, parts in got.items():
        n, deviation, w, explained = want[i]
        assert sorted(parts) == list(range(1, k + 1))
        for c, r in parts.items():
            assert (r.n, r.deviation) == (n, deviation) and r.identity_error < 1e-9
            assert r.explained == pytest.approx(explained[c - 1], rel=1e-9)
            if abs(w[c - 1]) > 1e-3:
                signs.setdefault(c, np.sign(r.whitened) * np.sign(w[c - 1]))
                assert r.whitened == pytest.approx(signs[c] * w[c - 1], rel=1e-6, abs=1e-7)
    return got


def test_whitening_against_eigh(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((400, 24)))]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(200)]  # a third of all rows are copies of three
    extra = [(5000, None), (5001, [None] * 24), (5002, [float("nan")] * 24), (5003, [float("inf")] * 24), (5004, [])]
    check_whitening(spark, rows, extra)


def test_whitening_of_close_and_flat_spectra(spark):
    rng = np.random.default_rng(4)
    base = np.linalg.qr(rng.standard_normal((12, 12)))[0]
    wide = (rng.standard_normal((600, 12)) * np.array([9, 8.9, 8.8, 8.7, 8.6, 5, 4, 3, 2, 1, 1, 1])) @ base
    check_whitening(spark, [(i, v.tolist()) for i, v in enumerate(wide)])
    check_whitening(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)])  # one direction only
    check_whitening(spark, [(i, [float(i % 5), 3.0 * (i // 5)]) for i in range(25)])
    check_whitening(spark, [(1, [0.5, -0.25]), (2, [0.5, -0.25])])  # no variance
    assert whitening.whiten(vectors(spark, []).filter("false")).count() == 0


def test_whitening_of_the_given_vectors(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check_whitening(spark, rows)


def test_lobpcg_certifies():
    rng = np.random.default_rng(6)
    a = rng.standard_normal((200, 80))
    v = a.T @ a / 200
    values, vectors_, residuals, iterations = whitening.lobpcg(lambda b: v @ b, 80, 4)
    assert residuals.max() <= whitening.CERTIFIED * values[0] and iterations < 100
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:4], rtol=1e-12)
    assert np.allclose(vectors_.T @ vectors_, np.eye(4), atol=1e-12)
