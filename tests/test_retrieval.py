"""Full text against SQLite's own index, vectors, fusion, confidence, decisions and memory on fixtures."""

import random
import sqlite3
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvina.functions.providers import CharacterEmbedder, OverlapReranker, reranked, with_embedding
from corvina.operators import confidence, evaluation, fusion, lexical, memory, ocr, ontology, routing, vector
from corvina.plans import build, hybrid
from corvina.sources import shared

WEIGHTS = {"doc": 8.0, "chunk_id": 4.0, "content": 1.0}


def sqlite_bm25(rows, match, limit):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(doc, chunk_id, content, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO t(rowid, doc, chunk_id, content) VALUES (?, ?, ?, ?)", rows)
    return con.execute("SELECT rowid, bm25(t, 8.0, 4.0, 1.0) AS s FROM t WHERE t MATCH ? ORDER BY s LIMIT ?", (match, limit)).fetchall()


def ours(spark, rows, queries, mode, limit=100):
    df = spark.createDataFrame(rows, "id long, doc string, chunk_id string, content string")
    q = spark.createDataFrame(queries, "query_id int, query string")
    out = {}
    for r in lexical.search(df, q, "id", WEIGHTS, limit, mode).collect():
        out.setdefault(r.query_id, {})[r.id] = r.bm25
    return out


GOLDEN = [
    (1, "fuel-a.md", "fuel-a", "Fuel tank grounding fuelling static discharge"), (2, "win-b.md", "win-b", "windshield frame rivet flushness structural repair fuel"),
    (3, "door-c.md", "door-c", "door frame repair été reservoir"), (4, "e.md", "e", "nothing here at all"), (5, "f.md", "f", "more nothing"),
]


def test_bm25_golden(spark):
    got = ours(spark, GOLDEN, [(1, "fuel frame")], "or")[1]
    assert got == pytest.approx({1: -0.6729444732424259, 2: -0.5921911364533348, 3: -0.3218430089420298}, abs=1e-12)
    assert ours(spark, GOLDEN, [(1, "repair frame")], "and")[1] == pytest.approx({3: -0.6436860178840595, 2: -0.5921911364533348}, abs=1e-12)


def test_bm25_against_sqlite(spark):
    rng = random.Random(8)
    words = ["fuel", "fuelled", "tank", "rivet", "pare", "brise", "Été", "x1", "x12", "door", "frame", "naïve"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))
    rows = [(i, text(2), text(1), text(12)) for i in range(60)]
    queries = [(i, " ".join(rng.sample(["fu", "fuel", "tank", "ri", "ete", "x1", "do", "zz", "nai"], rng.randint(1, 3)))) for i in range(12)]
    for mode, joiner in (("and", " AND "), ("or", " OR ")):
        got = ours(spark, rows, queries, mode)
        for i, q in queries:
            match = joiner.join(f'"{t}"*' for t in dict.fromkeys(q.split()))
            assert got.get(i, {}) == pytest.approx(dict(sqlite_bm25(rows, match, 1000)), abs=1e-9), q


def test_fallback_and_empty_queries(spark):
    got = ours(spark, GOLDEN, [(1, "fuel zzz"), (2, "zzz"), (3, "  "), (4, "fuel tank")], "fallback")
    assert set(got) == {1, 4} and set(got[1]) == {1, 2} and set(got[4]) == {1}


def test_knn(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.8, 0.2])], "id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_vector array<float>")
    got = [(r.id, r.vector_rank, round(r.distance, 6)) for r in vector.knn(v, q, "id", limit=2).orderBy("vector_rank").collect()]
    assert got == [(1, 1, 0.0), (3, 2, 0.08)]
    wrong = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id int, query_vector array<float>")
    with pytest.raises(Exception, match="dimension mismatch"):
        vector.knn(v, wrong, "id").collect()


def test_knn_edges_and_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, []), (6, [0.0, 1.0]), (7, [1.0, 0.0])], "id long, embedding array<float>")
    q = v.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    want = {(a, b): 0.0 if {a, b} <= {1, 7} or a == b else 2.0 for a in (1, 6, 7) for b in (1, 6, 7)}
    assert {(r.query_id, r.id): r.distance for r in vector.knn(v, q, "id").collect()} == want
    assert vector.knn(v.limit(0), q, "id").count() == vector.knn(v, q.limit(0), "id").count() == 0
    monkeypatch.setattr(vector, "BLOCK_BYTES", 32)
    blocked = vector.knn(v, q, "id")
    assert {(r.query_id, r.id): r.distance for r in blocked.collect()} == want


def test_knn_keeps_ties_in_any_order_of_blocks(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i if i else None, [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(300)] + [(1000 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(150)]
    asked = [(f"q{i}", [rng.random() * 2 - 1 for _ in range(4)]) for i in range(9)] + [("q", [1.0, 1.0, 1.0, 1.0])]
    single = lambda v: [struct.unpack("f", struct.pack("f", x))[0] for x in v]

    def dot(a, b):
        total = 0.0
        for x, y in zip(a, b, strict=True):
            total += x * y
        return total

    norm = lambda v: single([dot(v, v)])[0]
    want = set()
    for name, q in [(n, single(q)) for n, q in asked]:
        near = sorted((round(norm(q) + norm(x) - 2 * dot(q, x), 10), i is not None, i) for i, x in rows)
        want |= {(name, i, rank, d) for rank, (d, _, i) in enumerate(near[:7], 1)}
    v = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    q = spark.createDataFrame(asked, "query_id string, query_vector array<float>")
    for cells, block in ((1 << 20, 1 << 20), (30, 1 << 20), (100, 64)):
        monkeypatch.setattr(vector, "CELLS", cells)
        monkeypatch.setattr(vector, "BLOCK_BYTES", block)
        assert {(r.query_id, r.id, r.vector_rank, round(r.distance, 10)) for r in vector.knn(v, q, "id", limit=7).collect()} == want
    with pytest.raises(ValueError):
        vector.knn(v, q, "id", limit=0)


def test_keyword_scores_meet_names_by_pairs(spark):
    names = ["Fuel_tank.md", "x", "", None, "tan ktank", "été-fuel.pdf"]
    rows = spark.createDataFrame([(i, n, "fuel fuel tank") for i, n in enumerate(names)], "id int, name string, text string")
    q = spark.createDataFrame([(1, "fuel tank tank"), (2, "tan"), (3, "")], "query_id int, query string")
    found = lexical.keyword_scores(rows, q, "id", "name", "text")
    text = {1: 2 * 2 + 2 * 2, 2: 0}
    want = {(k, i): s for k, tokens in ((1, ["fuel", "tank", "tank"]), (2, ["tan"])) for i, n in enumerate(names) if (s := text[k] + 5 * sum(t in (n or "").lower() for t in tokens))}
    assert {(r.query_id, r.id): r.score for r in found.collect()} == want
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_index_is_read_and_rebuilt(spark, tmp_path):
    from corvina.sources import readers, segments

    df = spark.createDataFrame(GOLDEN, "id long, doc string, chunk_id string, content string")
    source, path = str(tmp_path / "source"), str(tmp_path / "index")
    df.write.parquet(source)
    mark = readers.file_fingerprint(spark, source)
    assert segments.ensure_index(None, path, "id", WEIGHTS, mark, spark) is None
    index = segments.ensure_index(spark.read.parquet(source), path, "id", WEIGHTS, mark)
    q = spark.createDataFrame([(1, "fuel frame")], "query_id int, query string")
    found = lexical.search_index(index, q, mode="or")
    assert {r.id: r.bm25 for r in found.collect()} == pytest.approx({1: -0.6729444732424259, 2: -0.5921911364533348, 3: -0.3218430089420298}, abs=1e-12)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all(content" not in plan and "PartitionFilters: [head" in plan
    before = (tmp_path / "index" / "manifest").stat().st_mtime_ns
    assert segments.ensure_index(None, path, "id", WEIGHTS, mark, spark) is not None
    assert (tmp_path / "index" / "manifest").stat().st_mtime_ns == before
    spark.createDataFrame([(9, "z.md", "z", "fuel")], df.schema).write.mode("append").parquet(source)
    other = readers.file_fingerprint(spark, source)
    assert other != mark and segments.ensure_index(None, path, "id", WEIGHTS, other, spark) is None
    index = segments.ensure_index(spark.read.parquet(source), path, "id", WEIGHTS, other)
    assert {r.id for r in lexical.search_index(index, q, mode="or").collect()} == {1, 2, 3, 9}


def test_one_changed_document_rewrites_one_segment(spark, tmp_path, monkeypatch):
    from corvina.sources import segments, writers

    path, schema, rng = str(tmp_path / "index"), "id long, doc string, chunk_id string, content string", random.Random(4)
    words = [f"{a}{b}" for a in ("fuel", "frame", "rib", "é") for b in ("", "s", "ing", "1")]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(12)))
    docs = {i: (f"d{i}", f"c{i}", text()) for i in range(40)}
    q = spark.createDataFrame([(1, "fuel"), (2, "fuel fr"), (3, "rib e 1")], "query_id int, query string")

    def frame():
        return spark.createDataFrame([(i, *d) for i, d in docs.items()] + [(7, "d7", "again", "fuel")], schema)

    def same():
        found = [{(r.query_id, r.id, r.lexical_rank, round(r.bm25, 9)) for r in lexical.search_index(i, q, 20).collect()} for i in (segments.read_index(spark, path), lexical.indexed(frame(), "id", WEIGHTS))]
        assert found[0] == found[1]
        return [(s.segment, s.n_docs, s.n_dead) for s in segments.manifest(spark, path)]

    assert segments.update_index(frame(), path, "id", WEIGHTS) == {"written": 40, "dead": 0}
    first = same()
    docs[3] = ("d3", "c3", "fuel frames")
    assert segments.update_index(frame(), path, "id", WEIGHTS) == {"written": 1, "dead": 1}
    second = same()
    assert [n for _, n, _ in second] == [40, 1] and second[0][0] == first[0][0]
    assert segments.update_index(frame(), path, "id", WEIGHTS) == {"written": 0, "dead": 0} and same() == second
    del docs[5]
    docs[100] = ("d100", "c", "rib")
    assert segments.update_index(frame(), path, "id", WEIGHTS) == {"written": 1, "dead": 1}
    with monkeypatch.context() as m:  # a crash before the manifest is replaced leaves the index as it was
        docs[101] = docs[100]
        before = segments.manifest(spark, path)
        m.setattr(writers, "replace_table", lambda *a, **b: (_ for _ in ()).throw(OSError))
        with pytest.raises(OSError):
            segments.update_index(frame(), path, "id", WEIGHTS)
        assert segments.manifest(spark, path) == before
        del docs[101]
        same()
    for i in (9, 10, 11):  # four small segments become one
        docs[i] = ("new", "c", "fuel")
        segments.update_index(frame(), path, "id", WEIGHTS)
    same()
    assert len(segments.manifest(spark, path)) < 6 and sum(s.n_docs - s.n_dead for s in segments.manifest(spark, path)) == 40
    for i in range(30):  # most of the first segment dies, so it is merged
        docs[i] = ("n", "c", text())
    segments.update_index(frame(), path, "id", WEIGHTS)
    assert first[0][0] not in {s for s, _, _ in same()}
    docs.clear()
    segments.update_index(frame().filter("false"), path, "id", WEIGHTS)
    assert segments.read_index(spark, path).postings.count() == 0


def test_hybrid_fusion(spark):
    docs = spark.createDataFrame([("tech-fuel", "tech-fuel.md", "c1", "fuel tank grounding wiring"), ("tech-window", "tech-window.md", "c2", "windshield rivet flushness")], "id string, doc string, chunk_id string, content string")
    v = spark.createDataFrame([("tech-fuel", [1.0, 0.0]), ("tech-window", [0.0, 1.0])], "id string, embedding array<float>")
    q = spark.createDataFrame([(1, "fuel tank grounding right wing", "tech_docs")], "query_id int, query string, corpus string")
    qv = spark.createDataFrame([(1, b, [1.0, 0.0]) for b in range(4)], "query_id int, batch int, query_vector array<float>")
    found = hybrid.search(q, docs, "id", WEIGHTS, v, qv)
    top = found.orderBy("retrieval_rank").first()
    assert (top.identity, top.retrieval_channels, top.rrf_score) == ("tech-fuel", ["lexical", "vector"], round(2 / 61, 8))
    level = hybrid.with_confidence(q, ("tech_docs", found)).first()
    assert level.level in ("medium", "high")
    only = hybrid.search(q, docs, "id", WEIGHTS).first()
    assert only.retrieval_channels == ["lexical"] and only.vector_distance is None


def test_repeated_rows_count_in_a_batch(spark):
    rows = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 2, "a"), (1, 0, 3, "b"), (1, 1, 1, "b")], "query_id int, batch int, rank int, identity string")
    got = {r.identity: (r.rrf, r.variant_hits, r.rank) for r in fusion.fuse_batches(rows).collect()}
    assert got["a"] == (pytest.approx(1 / 61 + 1 / 62), 1, 1) and got["b"] == (pytest.approx(1 / 61 + 1 / 63), 2, 2)


def test_confidence(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    rows = spark.createDataFrame([(1, "tech", 1, ["vector"], 1.22, 0.01), (2, "tech", 1, ["lexical", "vector"], 0.72, 0.034), (2, "nc", 1, ["lexical", "vector"], 0.81, 0.033)], "query_id int, corpus string, rank int, ch array<string>, d double, r double")
    rows = rows.withColumn("signal", confidence.signal(F.col("ch"), F.col("d"), F.col("r"), F.lit(True)))
    got = {r.query_id: (r.level, r.signals) for r in confidence.assess(q, rows).collect()}
    assert got == {1: ("low", [0]), 2: ("high", [4, 4]), 3: ("low", [])}


def test_stratified_sample(spark):
    rows = spark.createDataFrame([("a", "small"), ("b", "small"), ("c", "medium"), ("d", "large"), ("e", "multi"), ("f", "multi")], "doc string, stratum string")
    assert sorted(r.doc for r in evaluation.stratified_sample(rows, "doc", "doc", 4).collect()) == ["a", "c", "d", "e"]
    assert evaluation.stratified_sample(rows, "doc", "doc", 0).count() == 0
    for n in (1, 2, 3, 7, 10):
        rows = spark.createDataFrame([(i, "x") for i in range(23)], "i int, g string")
        want = [0] if n == 1 else sorted({int(i * 22 / (n - 1) + 0.5) for i in range(n)})
        assert sorted(r.i for r in evaluation.even_picks(rows, "g", "i", n).collect()) == want


def test_hits(spark):
    rows = spark.createDataFrame([(1, r, n) for r, n in enumerate(["x.md", "Étude-9", "z"], 1)], "case_id int, rank int, doc string")
    relevant = evaluation.starts_with_any(F.col("doc"), F.array(F.lit("etude")))
    assert evaluation.hits(rows, (1, 5), relevant).first().asDict() == {"case_id": 1, "hit_1": 0, "hit_5": 1}


def test_caption_routes(spark):
    cases = [
        ("wiring_signal_bus_diagram", 0, 0, "x", "gpt-5.4"), ("technical_photo", 9, 9, "x", "nano"), ("technical_table", 20, 20, "x", "nano"),
        ("cockpit_panel_or_display", 7, 5, "avionics_electrical", "nano"), ("cockpit_panel_or_display", 9, 5, "flight_controls", "gpt-5.4"), ("cover_page", 9, 9, "x", "nano"), ("other", 6, 4, "x", "gpt-5.4"),
    ]
    df = spark.createDataFrame(cases, "kind string, e int, r int, dom string, want string")
    route = routing.caption_route(F.col("kind"), F.lit(True), F.lit(True), F.col("e"), F.col("r"), F.lit(0), F.array("dom"), F.lit(""), F.lit(True))
    assert df.filter(route["route"] != F.col("want")).count() == 0
    labels = spark.createDataFrame([("nano", "deep_required", "false_nano"), ("gpt-5.4", "nano_sufficient", "false_gpt54"), ("nano", None, "unlabeled"), ("nano", "ambiguous", "ambiguous"), ("nano", "nano_sufficient", "match")], "route string, label string, want string")
    assert labels.filter(routing.outcome(F.col("route"), F.col("label")) != F.col("want")).count() == 0
    ok = spark.createDataFrame([("nano", "match")] * 22 + [("gpt-5.4", "match")] * 8, "route string, outcome string")
    assert routing.calibration(ok).first().decision == "accept_matrix"
    assert routing.calibration(ok.limit(0)).first().decision == "pending_labels"


def test_execution(spark):
    df = spark.createDataFrame([("100", "simple", "draft_simple", "low"), ("100", "deep", "analysis_deep", "high"), ("000", "deep", "draft_standard_000", "low")], "role string, c string, want string, effort_wanted string")
    cols = routing.execution(F.lit("assistant_response"), F.col("role"), F.col("c"), F.lit("high"), F.lit(None).cast("string"))
    got = routing.with_profiles(df.select("want", "effort_wanted", *[c.alias(n) for n, c in cols.items()]))
    assert got.filter("profile <> want OR effort <> effort_wanted OR model <> 'gpt-5.4-nano'").count() == 0
    with pytest.raises(Exception, match="unknown complexity"):
        spark.range(1).select(routing.complexity_level(F.lit("hard"))).collect()


def test_memory(spark):
    turns = spark.createDataFrame([("s", i, f"t{i}") for i in range(6)] + [("r", 1, "x")], "session string, at int, text string")
    got = {r.session: [x.text for x in r.recent] for r in memory.last_turns(turns, "session", ["at"], ["at", "text"]).collect()}
    assert got == {"s": ["t2", "t3", "t4", "t5"], "r": ["x"]}
    e = spark.createDataFrame([("v1", "fuel tank grounding", True, 1, None), ("v2", "fuel tank grounding", True, 2, "v1"), ("v3", "fuel tank grounding", False, 3, None)] + [(f"o{i}", "other words", True, 0, None) for i in range(6)], "episode_id string, summary string, validated boolean, updated_at int, supersedes string")
    e = memory.supersede(e, "episode_id", "supersedes").withColumns({c: F.lit("") for c in ("case_ref", "label", "corrections")})
    q = spark.createDataFrame([(1, "fuel tank grounding")], "query_id int, query string")
    assert [r.episode_id for r in memory.search(e, q).collect()] == ["v2"]
    up = memory.upsert(spark.createDataFrame([("a", 1, 1), ("a", 3, 3), ("b", 2, 2)], "k string, updated int, created int"), "k", ["updated"], "created")
    assert sorted(map(tuple, up.collect())) == [("a", 3, 1), ("b", 2, 2)]


def test_neighbours(spark):
    e = spark.createDataFrame([(i, f"t{i:02}", "ATA-36", None) for i in range(12)] + [(99, "x", "ATA-9", "z")], "id int, title string, ata string, zone string")
    got = ontology.neighbours(e, ["ata", "zone"], "id", "title").collect()
    assert len([r for r in got if r.entity == 0]) == 10 and not [r for r in got if r.entity == 99]
    assert [r.neighbour for r in sorted((r for r in got if r.entity == 3), key=lambda r: r.n)] == [i for i in range(11) if i != 3]


def test_neighbours_share_one_of_several_values(spark):
    e = spark.createDataFrame([(1, "a", ["ATA-36", "ATA-21"]), (2, "b", [" ata-21", "ATA-36"]), (3, "c", ["Ata-36", ""]), (4, "d", [""]), (5, "e", None), (6, "f", ["ATA-21"])], "id int, title string, ata array<string>")
    got = {(r.entity, r.n): r.neighbour for r in ontology.neighbours(e, ["ata"], "id", "title", 2).collect()}
    assert got == {(1, 1): 2, (1, 2): 3, (2, 1): 1, (2, 2): 3, (3, 1): 1, (3, 2): 2, (6, 1): 1, (6, 2): 2}


def test_parts_list_some_documents_and_keep_all_edges(spark):
    rows = [(i, f"d{i}", f"c{i % 4}", "text", "", "fuel door") for i in range(9)] + [(9, None, None, "text", "", "Fuel  door; oil pump")]
    found = ontology.candidates(spark.createDataFrame(rows, "row_idx long, doc string, chunk_id string, content string, ata string, parts string"))
    cut = {r.slug: r for r in ontology.parts(found, most=3).collect()}
    assert (cut["fuel-door"].supporting_docs, cut["fuel-door"].n_supporting_docs, cut["fuel-door"].n_supporting_chunks) == (["d0", "d1", "d2"], 9, 4)
    assert (cut["oil-pump"].supporting_docs, cut["oil-pump"].n_supporting_docs) == ([], 0)
    images = spark.createDataFrame([("i", "d8", "the fuel door", None, [], [], [], [])], "id string, doc string, caption string, technical_description string, part_or_zone_candidates array<string>, visible_identifiers array<string>, figure_or_table_refs array<string>, relationships_or_flows array<string>")
    whole = ontology.image_relations(images, ontology.parts(found)).collect()
    assert whole == ontology.image_relations(images, ontology.parts(found, most=3), ontology.supports(found)).collect() and whole[0].score == 4


def test_pages_list_all_documents_of_parts_whose_rows_list_some(spark):
    rows = [(i, f"d{i}", "c", "text", "", "fuel door") for i in range(9)] + [(9, None, None, "text", "", "oil pump")]
    found = ontology.candidates(spark.createDataFrame(rows, "row_idx long, doc string, chunk_id string, content string, ata string, parts string"))
    none = spark.createDataFrame([], "doc string, part_numbers array<string>")
    pages = {r.slug: r.markdown for r in build.wiki_pages(ontology.parts(found, most=3), none, supported=ontology.supports(found)).collect()}
    assert [line[3 : line.index("]")] for line in pages["fuel-door"].splitlines() if line.startswith("- [")] == [f"d{i}" for i in range(9)]
    assert "Fuel Door in 9 documents." in pages["fuel-door"] and "- No linked technical document recorded." in pages["oil-pump"]


def test_a_task_gathers_few_neighbours_of_many_queries_at_once(monkeypatch):
    monkeypatch.setattr(vector, "SEEN", 100)
    monkeypatch.setattr(vector, "CELLS", 400)
    sizes, keep = [], vector._Nearest._keep
    monkeypatch.setattr(vector._Nearest, "_keep", lambda self, parts: (sizes.append(sum(map(len, parts))), keep(self, parts)))
    x = np.random.default_rng(1).integers(-3, 4, (500, 4)).astype(float)
    norms = (x * x).sum(1)
    state = vector._Nearest(x[:40], norms[:40], 3)
    state.see(pa.array(range(500)), x, norms)
    assert max(sizes) <= 100 + 400 and len(sizes) > 2
    far = ((x[:40, None, :] - x[None]) ** 2).sum(2)
    found = state.found.sort_values(["q", "near", "id"])
    assert [found["id"][found["q"] == q].tolist() for q in range(40)] == [sorted(range(500), key=lambda i: (far[q, i], i))[:3] for q in range(40)]


def test_edges_are_the_relations_of_all_parts(spark, tmp_path):
    rows = [(i, f"d{i % 3}", "c", f"ATA {i % 4 + 20} near frame {i} in the RH zone", f"{i % 2}", "fuel door; oil pump" if i % 2 else "") for i in range(30)] + [(30, "d", "c", None, None, "bare part")]
    spark.createDataFrame(rows, "row_idx long, doc string, chunk_id string, content string, ata string, parts string").coalesce(1).write.parquet(str(tmp_path / "r"))
    found = ontology.candidates(spark.read.parquet(str(tmp_path / "r")))
    tasks = found.rdd.getNumPartitions()
    assert tasks == 2 * spark.sparkContext.defaultParallelism  # one file, but not one task
    dealt = spark.read.parquet(str(tmp_path / "r")).repartition(3)
    assert shared.spread(dealt) is dealt
    whole = sorted(map(tuple, ontology.relations(ontology.parts(found)).collect()))
    assert sorted(map(tuple, ontology.edges(found).collect())) == whole and len(whole) > 30


def test_images_meet_parts_by_any_value(spark):
    values = ["P2", "rame", "shie", "A", "", "xno 1 a by", "zz"]
    images = spark.createDataFrame([(f"i{k}", "d", "", None, [], [v], [], []) for k, v in enumerate(values)], "id string, doc string, caption string, technical_description string, part_or_zone_candidates array<string>, visible_identifiers array<string>, figure_or_table_refs array<string>, relationships_or_flows array<string>")
    names = ["Pump P2", "frame", "windshield", "No 1 A B"]
    parts = spark.createDataFrame([(f"s{k}", n, [], []) for k, n in enumerate(names)], "slug string, canonical_name string, aliases array<string>, supporting_docs array<string>")
    got = {(r["from"], r.to) for r in ontology.image_relations(images, parts).collect()}
    assert got == {(f"part:s{j}", f"image:i{k}") for k, v in enumerate(values) for j, n in enumerate(names) if v.lower() in n.lower() or n.lower() in v.lower()}


def test_images_meet_parts_as_a_cross_product_does(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("ab C-") for _ in range(rng.randint(1, n)))
    images = [(f"i{k}", f"d{k % 3}", word(12), word(30) if k % 4 else None, [word(5) for _ in range(rng.randint(0, 2))], [word(3) for _ in range(rng.randint(0, 2))], [], ["x"] if k % 2 else []) for k in range(40)]
    parts = [(f"s{k}", word(9), [word(4) for _ in range(rng.randint(0, 2))], [f"d{k % 4}"]) for k in range(30)]
    low = lambda x: x.lower()
    want = {}
    for i, doc, caption, said, listed, seen, refs, flows in images:
        for slug, name, aliases, docs in parts:
            names = [low(a.strip(" ")) for a in {name, *aliases, slug} if len(a.strip(" ")) >= 3]
            meets = lambda values: any(low(v) in a or a in low(v) for v in values for a in names)  # noqa: B023, E731
            tells = any(a in low(caption) or (said and a in low(said)) for a in names)
            score = 5 * meets(listed) + 4 * meets(seen) + 3 * tells + (doc in docs) + bool(refs) + bool(flows)
            if (meets(listed) or meets(seen) or tells) and score >= 3:
                want[f"part:{slug}", f"image:{i}"] = score
    df = spark.createDataFrame(images, "id string, doc string, caption string, technical_description string, part_or_zone_candidates array<string>, visible_identifiers array<string>, figure_or_table_refs array<string>, relationships_or_flows array<string>")
    p = spark.createDataFrame(parts, "slug string, canonical_name string, aliases array<string>, supporting_docs array<string>")
    assert {(r["from"], r.to): r.score for r in ontology.image_relations(df, p).collect()} == want and len(want) > 50


def test_image_scores(spark):
    image = [("a220-1", "A220_page_1.pdf", "Starter Air Valve location", "The starter air valve feeds", ["Starter Air Valve"], ["starter air valve"], ["Fig 1"], ["feeds"], "wiki/x.png")]
    images = spark.createDataFrame(image, "id string, doc string, caption string, technical_description string, part_or_zone_candidates array<string>, visible_identifiers array<string>, figure_or_table_refs array<string>, relationships_or_flows array<string>, asset_path string")
    parts = spark.createDataFrame([("starter-air-valve", "Starter Air Valve", [], ["A220_page_1.pdf"]), ("door", "Door", [], [])], "slug string, canonical_name string, aliases array<string>, supporting_docs array<string>")
    edges = ontology.image_relations(images, parts)
    assert [(r["from"], r.score) for r in edges.collect()] == [("part:starter-air-valve", 15)]
    assert ontology.linked_images(edges, images).count() == 1
    pages = spark.createDataFrame([("door",), ("gone",)], "slug string")
    lost = ocr.violations(pages, edges.withColumn("to", F.lit("image:none")), images, parts).collect()
    assert {(r.kind, r.id) for r in lost} == {("missing-image", "image:none"), ("page-without-part", "gone")}


def test_providers(spark):
    df = spark.createDataFrame([("ab",), ("",), (None,)], "t string")
    got = [r.embedding for r in with_embedding(df, "t", CharacterEmbedder()).collect()]
    assert got[0] == pytest.approx([(97 + 98) % 97 / 100, (97 + 196) % 101 / 100, 0.02]) and got[1] == got[2] == [0, 0, 0]

    class Broken(CharacterEmbedder):
        def embed(self, texts):
            if "" in texts:
                raise ValueError("blank")
            return super().embed(texts)

    assert [r.embedding_error for r in with_embedding(df, "t", Broken()).collect()] == [None, "blank", "blank"]
    rows = spark.createDataFrame([(1, "fuel tank", "a fuel line"), (1, "fuel tank", "none")], "query_id int, query string, content string")
    assert [r.relevance_score for r in reranked(rows, OverlapReranker()).collect()] == [0.5, 0.0]


def test_one_bad_text_costs_its_row_only(spark, tmp_path):
    from corvina.functions.providers import embed_all, write_embedded

    calls = []

    class Picky(CharacterEmbedder):
        def embed(self, texts):
            calls.append(len(texts))
            if any(t == "bad" for t in texts):
                raise RuntimeError("refused")
            return super().embed(texts)

    texts = [f"t{i}" for i in range(500)]
    texts[123] = "bad"
    vectors, errors = embed_all(Picky(), texts)
    assert [i for i, e in enumerate(errors) if e] == [123] == [i for i, v in enumerate(vectors) if v is None] and errors[123] == "refused"
    assert len(calls) <= 1 + 2 * 9 and vectors[7] == CharacterEmbedder().embed(["t7"])[0]
    short = type("Short", (), {"embed": lambda self, t: [[0.0]] if len(t) == 1 else []})()
    assert embed_all(short, ["a", "b"]) == ([[0.0], [0.0]], [None, None])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts[100:150])] + [(99, None)], "id int, t string")
    good, dead = write_embedded(df, "t", Picky(), str(tmp_path / "e"))
    assert good.count() == 50 and good.filter("embedding IS NULL").count() == 0
    assert [(r.id, r.embedding_error) for r in dead.collect()] == [(23, "refused")]


def test_latency_sketches_stay_within_their_error(spark):
    runs = spark.range(200_000).selectExpr("'m' AS model", "'ok' AS status", "(id * 7919) % 200000 AS millis")
    got = routing.latency(routing.latency_sketches(runs, "millis")).first()
    assert got.n == 200_000 and got.most == 199_999 and abs(got.p50 - 100_000) < 200 and abs(got.p90 - 180_000) < 200


def test_updates_count_tokens_of_bounded_texts(spark, tmp_path, monkeypatch):
    from corvina.sources import segments

    monkeypatch.setattr(lexical, "TASK_BYTES", 1000, raising=False)
    tasks, write, path = [], segments._write, str(tmp_path / "index")
    monkeypatch.setattr(segments, "_write", lambda postings, *a: tasks.append(postings.rdd.getNumPartitions()) or write(postings, *a))
    rows = spark.createDataFrame([(i, f"word{i:03} door " * 10) for i in range(100)], "id long, text string")
    now = rows.withColumn("text", F.when(F.col("id") % 2 == 0, F.upper("text")).otherwise(F.col("text"))).withColumn("text", F.replace("text", F.lit("DOOR"), F.lit("PUMP")))
    assert segments.update_index(rows, path, "id", {"text": 1.0})["written"] == 100
    assert segments.update_index(now, path, "id", {"text": 1.0}) == {"written": 50, "dead": 50}
    assert tasks == [13, 7]  # of 13,000 and 6,500 bytes
    index, asked = segments.read_index(spark, path), spark.createDataFrame([(1, "pump"), (2, "door")], "query_id int, query string")
    assert {(r.query_id, r.id % 2) for r in lexical.search_index(index, asked, 100).collect()} == {(1, 0), (2, 1)}
