"""Queries of search over several sources, of the ontology and wiki of a corpus, and of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvina.functions.providers import CharacterEmbedder, OverlapReranker, reranked, with_embedding, write_embedded
from corvina.operators import ocr, ontology, patterns, rewrite, vector
from corvina.plans import build, hybrid, ocr_queries, sql
from corvina.plans.registry import WEIGHTS, dealt, dealt_sql, documents_index, given, query, table
from corvina.sources import readers, shared, writers
from corvina.streaming import events as stream
from corvina.streaming import timed

# ---- three sources, and the arms of the evaluation

#: Queries without expansions, so that a query is its only variant; those of vectors 1 to 4 ask the vector channel.
SEARCHES = [(1, "und der keit"), (2, "les que ment"), (3, "thing hand"), (4, "steel brass ando")]
DOC_ROWS = "SELECT doc_id AS id, doc_id, source, text FROM documents"
EVENT_ROWS = "SELECT doc_id AS id, doc_id, source, text FROM documents WHERE lang <> 'en'"
VECTOR_ROWS = "SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings"
VECTOR_ASKED = "SELECT CAST(vec_id AS INT) AS query_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings WHERE vec_id BETWEEN 1 AND 4"


def _hybrid_sql(name: str, rows: str, vectors: bool) -> str:
    """CTE name (query_id, identity, rank, score, channels) of one corpus; its parts are nested, so that names do not meet."""
    channels = "SELECT query_id, 'lexical' AS channel, lexical_rank AS rank, id AS identity FROM bm25_found"
    knn = ""
    if vectors:
        knn = f", {sql.knn(VECTOR_ASKED, VECTOR_ROWS, 15)}"
        channels += " UNION ALL SELECT query_id, 'vector', vector_rank, id FROM knn_found"
    asked = f"SELECT query_id, query FROM {sql.values(SEARCHES, 'query_id, query')}"
    return f"""
{name} AS (WITH {sql.bm25(asked, rows, WEIGHTS, 15)}{knn}, both_ AS ({channels}),
  summed AS (SELECT query_id, identity, sum(1.0 / (60 + rank)) AS raw, min(rank) AS best_rank, array_to_string(list_sort(list(DISTINCT channel)), ',') AS channels FROM both_ GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 12) DESC, best_rank, identity) AS rank FROM summed)
  SELECT query_id, identity, rank, round(raw, 8) AS score, channels FROM ranked WHERE rank <= 10)"""


def _sources(spark, sf_dir):
    q, _ = given(spark, SEARCHES, "query_id int, query string")
    v = table(spark, sf_dir, "embeddings")
    asked = v.filter("vec_id BETWEEN 1 AND 4").select(F.col("vec_id").cast("int").alias("query_id"), F.lit(0).alias("batch"), F.col("embedding").alias("query_vector"))
    tech = hybrid.Source("tech_docs", documents_index(spark, sf_dir), v.select(F.col("vec_id").alias("id"), "embedding"), asked)
    events = hybrid.Source("non_conformities", documents_index(spark, sf_dir, "lang <> 'en'"))
    wiki = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slug"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_brand", "p_type").alias("metadata"))
    return q, tech, events, wiki


_WIKI_SQL = f"""
wiki AS (SELECT query_id, p_partkey AS id, p_name, CAST(sum(CASE WHEN list_contains({sql.tokens('p_name')}, token) THEN 3 WHEN list_contains({sql.tokens("p_brand || ' ' || p_type")}, token) THEN 1 ELSE 0 END) AS DOUBLE) AS score
  FROM (SELECT query_id, unnest(list_distinct({sql.tokens('query')})) AS token FROM {sql.values(SEARCHES, 'query_id, query')}), part GROUP BY ALL),
pages AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p_name, id) AS rank FROM wiki WHERE score > 0)"""


@query(f"""
WITH {_hybrid_sql('tech', DOC_ROWS, True)}, {_hybrid_sql('events_', EVENT_ROWS, False)}, {_WIKI_SQL}
SELECT 'tech_docs' AS source, query_id, CAST(identity AS VARCHAR) AS identity, CAST(rank AS INT) AS rank, score, channels FROM tech UNION ALL SELECT 'non_conformities', query_id, CAST(identity AS VARCHAR), CAST(rank AS INT), score, channels FROM events_
UNION ALL SELECT 'entities_wiki', query_id, CAST(id AS VARCHAR), CAST(rank AS INT), score, 'wiki' FROM pages WHERE rank <= 10""")
def three_source_search(spark, sf_dir):
    return hybrid.three_sources(*_sources(spark, sf_dir))[0]


@query(f"""
WITH q AS (SELECT * FROM {sql.values(SEARCHES, 'query_id, query')})
SELECT 'tech_docs' AS source, query_id, true AS vector_enabled, true AS ready, query AS variants FROM q UNION ALL SELECT 'non_conformities', query_id, false, true, query FROM q
UNION ALL SELECT 'entities_wiki', query_id, false, true, array_to_string({sql.tokens('query')}, '|') FROM q""")
def three_source_debug(spark, sf_dir):
    found = hybrid.three_sources(*_sources(spark, sf_dir))[1]
    return found.withColumn("variants", F.array_join("variants", "|"))


@query(f"""
WITH {_hybrid_sql('events_', EVENT_ROWS, False)} SELECT query_id, identity, CAST(rank AS INT) AS retrieval_rank, score AS rrf_score FROM events_ WHERE rank <= 3""")
def corpus_search(spark, sf_dir):
    q, _, events, _ = _sources(spark, sf_dir)
    return hybrid.search_corpus(q, events, 3).select("query_id", "identity", "retrieval_rank", "rrf_score")


@query(f"""
WITH {_hybrid_sql('tech', DOC_ROWS, True)}, {sql.knn(VECTOR_ASKED, VECTOR_ROWS, 10)},
runs AS (SELECT 'vector' AS arm, query_id, id AS identity, vector_rank AS rank FROM knn_found UNION ALL SELECT 'rrf', query_id, identity, rank FROM tech UNION ALL SELECT 'rewritten', query_id, identity, rank FROM tech),
cases AS (SELECT query_id, arm FROM {sql.values(SEARCHES, 'query_id, query')}, (SELECT unnest(['vector', 'rrf', 'rewritten']) AS arm)),
h AS (SELECT c.arm, c.query_id, max(CASE WHEN rank <= 5 AND identity IN (SELECT doc_id FROM documents WHERE doc_id % 4 = 0) THEN 1 ELSE 0 END) AS h5, max(CASE WHEN rank <= 10 AND identity IN (SELECT doc_id FROM documents WHERE doc_id % 4 = 0) THEN 1 ELSE 0 END) AS h10 FROM cases c LEFT JOIN runs USING (arm, query_id) GROUP BY ALL),
u AS (SELECT arm, 5 AS k, h5 AS hit FROM h UNION ALL SELECT arm, 10, h10 FROM h)
SELECT arm, 'tech_docs' AS corpus, k, CAST(sum(hit) AS BIGINT) AS hits, count(*) AS total, round(avg(hit), 3) AS ratio FROM u GROUP BY arm, k""")
def evaluation_arms(spark, sf_dir):
    q, tech, _, _ = _sources(spark, sf_dir)
    every = F.explode(F.array(*[F.lit(n) for n, _ in SEARCHES])).alias("query_id")
    relevant = table(spark, sf_dir, "documents").filter("doc_id % 4 = 0").select(every, F.col("doc_id").alias("identity"))
    return hybrid.arms(q, tech, relevant)


GATES = [(1, "fuel pump grounding", "tech_docs"), (2, "ATA 28 fuel", "tech_docs"), (3, "ata 52", "tech_docs"), (4, "fuel tank", "non_conformities"), (5, "fuel pump grounding", "tech_docs"), (6, "static", "tech_docs")]


@query(f"""
WITH q AS (SELECT *, {sql.tokens('query')} AS t FROM {dealt_sql('documents', 'doc_id', [g[1:2] for g in GATES], 'query')})
SELECT id AS query_id, (list_has_any(t, {list(rewrite.FUEL)}) AND list_has_any(t, {list(rewrite.ELECTRICAL)})) OR (list_contains(t, 'ata') AND list_contains(t, 'fuel')) AS asked FROM q""")
def model_rewrite_gate(spark, sf_dir):
    rows = dealt(spark, sf_dir, "documents", "doc_id", [g[1:2] for g in GATES], "query string")
    return rows.select(F.col("id").alias("query_id"), rewrite.wants_model(F.col("query")).alias("asked"))


@query("""
SELECT doc_id AS query_id, batch, variant FROM documents JOIN (VALUES (0, 0, 'ATA 28 fuel'), (0, 1, 'ATA 28 fuel system fuel tank collector tank surge tank'), (0, 2, 'said'), (0, 3, 'h1 h2'), (1, 0, 'ata 52')) AS v(i, batch, variant) ON i = doc_id % 2""")
def model_rewrite_variants(spark, sf_dir):
    rows = dealt(spark, sf_dir, "documents", "doc_id", [g[1:] for g in GATES if g[0] in (2, 3)], "query string, corpus string").withColumnRenamed("id", "query_id").drop("source")
    said = lambda asked: asked.select("query", "corpus", F.array(F.lit("said"), F.col("query")).alias("variants"), F.array(F.lit("h1"), F.lit("h2")).alias("hints"))
    return rewrite.expand_with_model(rows, said).select("query_id", "batch", "variant")


@query("""
WITH l AS (SELECT doc_id, text AS t, list_transform(regexp_extract_all(text, '(?s).'), lambda c: CAST(unicode(c) AS BIGINT)) AS u FROM documents)
SELECT doc_id, round(CAST(CAST(coalesce(list_sum(u), 0) % 97 / 100 AS FLOAT) AS DOUBLE), 4) AS a, round(CAST(CAST(coalesce(list_sum(list_transform(u, lambda x, i: x * i)), 0) % 101 / 100 AS FLOAT) AS DOUBLE), 4) AS b, round(CAST(CAST(length(t) % 89 / 100 AS FLOAT) AS DOUBLE), 4) AS c FROM l""")
def offline_embeddings(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))
    e = with_embedding(rows, "t", CharacterEmbedder())
    return e.select("doc_id", *[F.round(F.col("embedding")[i].cast("double"), 4).alias(n) for i, n in enumerate("abc")])


@query("""
WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ') AS w FROM documents)
SELECT doc_id, (CAST(list_contains(w, 'the') AS INT) + CAST(list_contains(w, 'of') AS INT) + CAST(list_contains(w, 'zzz') AS INT)) / 3 AS relevance_score FROM d""")
def offline_reranking(spark, sf_dir):
    return reranked(table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("query_id"), F.lit("The of zzz").alias("query"), F.col("text").alias("content")), OverlapReranker()).select("doc_id", "relevance_score")


class _Strict(CharacterEmbedder):
    """Refuses a batch that holds an address, as a provider's filter would."""

    def embed(self, texts):
        if any("@" in t for t in texts):
            raise RuntimeError("refused")
        return super().embed(texts)


@query("SELECT contains(text, '@') AS dead, CASE WHEN contains(text, '@') THEN 'refused' END AS error, doc_id FROM documents")
def embedding_dead_letters(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    good, dead = write_embedded(rows, "text", _Strict(), shared.new_path(spark, "embedded"))
    said = dead.select(F.lit(True).alias("dead"), F.col("embedding_error").alias("error"), "doc_id")
    return good.filter(F.size("embedding") == 3).select(F.lit(False).alias("dead"), F.lit(None).cast("string").alias("error"), "doc_id").unionByName(said)


# ---- ontology and wiki


PATHS = [(1, "/wiki/a/b.md"), (2, "wiki/images/x.PNG"), (3, "../a.md"), (4, "a/../b.md"), (5, "images/x/y.png"), (6, "a%20b.md"), (7, ""), (8, "a.txt"), (9, "%2Fwiki%2Fc.md"), (10, "images/p.jpeg"), (11, "a\\b.md"), (12, "//x.md"), (13, "%zz.md")]


@query("""
SELECT page_id AS id, path FROM pages JOIN (VALUES (1, 'a/b.md'), (2, 'images/x.PNG'), (3, NULL), (4, NULL), (5, NULL), (6, 'a b.md'), (7, NULL), (8, NULL), (9, 'c.md'), (10, 'images/p.jpeg'), (11, NULL), (12, 'x.md'), (13, NULL)) AS v(i, path) ON i - 1 = page_id % 13""")
def wiki_paths(spark, sf_dir):
    return dealt(spark, sf_dir, "pages", "page_id", [p[1:] for p in PATHS], "raw string").select("id", ontology.wiki_path(F.col("raw")).alias("path"))


@query("""
SELECT s_suppkey, concat_ws(' · ', nullif(s_name, ''), 'ATA: ' || s_nationkey, 'Zone: LH', 'Zone: RH', CASE WHEN s_suppkey % 2 = 0 THEN 'Alias: x' END, 'Part number: p' || s_suppkey, array_to_string(list_transform(range(least(5, s_suppkey % 8)), lambda i: 'Supporting doc: d' || i), ' · ')) AS content FROM supplier WHERE s_suppkey % 8 > 0""")
def wiki_contents(spark, sf_dir):
    n, key = F.col("s_nationkey").cast("string"), F.col("s_suppkey")
    docs = F.transform(F.sequence(F.lit(0), (key % 8 - 1).cast("int")), lambda i: F.concat(F.lit("d"), i.cast("string")))
    alias = F.when(key % 2 == 0, F.array(F.lit("x")))
    text = ontology.wiki_content(F.col("s_name"), F.array(n), F.array(F.lit("LH"), F.lit("RH")), alias, F.array(F.concat(F.lit("p"), key.cast("string"))), docs)
    return table(spark, sf_dir, "supplier").filter("s_suppkey % 8 > 0").select("s_suppkey", text.alias("content"))


#: Records of a corpus made of parts: three chunks a document, codes and zones in the text.
RECORDS_SQL = """
SELECT p_partkey AS row_idx, concat('d', p_partkey // 3, '.pdf') AS doc, concat('d', p_partkey // 3, ' ', p_partkey % 3) AS chunk_id, concat('ATA ', p_size + 10, ' door in the RH zone of ', p_name) AS content, '' AS ata, concat(p_type, ' door') AS parts FROM part"""


def _records(spark, sf_dir):
    p = shared.spread(table(spark, sf_dir, "part"))
    doc = F.concat(F.lit("d"), F.floor(F.col("p_partkey") / 3).cast("string"))
    return p.select(
        F.col("p_partkey").alias("row_idx"), F.concat(doc, F.lit(".pdf")).alias("doc"), F.concat_ws(" ", doc, (F.col("p_partkey") % 3).cast("string")).alias("chunk_id"),
        F.concat(F.lit("ATA "), (F.col("p_size") + 10).cast("string"), F.lit(" door in the RH zone of "), "p_name").alias("content"), F.lit("").alias("ata"), F.concat("p_type", F.lit(" door")).alias("parts"),
    )


_SLUG = "trim(regexp_replace(lower(parts), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"""
WITH r AS (SELECT *, {_SLUG} AS slug, 'ATA-' || regexp_extract(content, 'ATA (\\d\\d)', 1) AS code FROM ({RECORDS_SQL})), f AS (SELECT slug, arg_min(parts, row_idx) AS seed FROM r GROUP BY slug)
SELECT r.slug, CASE WHEN r.slug LIKE '%brass%' THEN 'Given ' || r.slug ELSE array_to_string(list_transform(string_split(any_value(seed), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') END AS canonical_name,
  array_to_string(list_sort(list(DISTINCT code)), '|') AS ata, count(DISTINCT doc) AS n_docs, array_to_string((list(left(content, 280) ORDER BY row_idx))[1:3], '|') AS snippets FROM r JOIN f USING (slug) GROUP BY r.slug""")
def canonical_parts(spark, sf_dir):
    found = ontology.candidates(_records(spark, sf_dir))
    names = found.filter(F.contains("slug", F.lit("brass"))).select("slug", F.concat(F.lit(" Given  "), "slug").alias("name")).distinct()
    return ontology.parts(found, names).select("slug", "canonical_name", F.array_join("ata_codes", "|").alias("ata"), F.size("supporting_docs").cast("long").alias("n_docs"), F.array_join("snippets", "|").alias("snippets"))


@query(f"SELECT 'ATA-' || regexp_extract(content, 'ATA (\\d\\d)', 1) AS value, min(row_idx) AS first_row FROM ({RECORDS_SQL}) GROUP BY 1")
def dimension_entries(spark, sf_dir):
    return ontology.dimension(ontology.candidates(_records(spark, sf_dir)), "ata_codes")


@query(f"SELECT doc, chunk_id, 'ATA-' || regexp_extract(content, 'ATA (\\d\\d)', 1) AS ata, 'RH' AS zones, '' AS numbers, regexp_extract(doc, '^(\\d{{3}})$', 1) AS task_kind FROM ({RECORDS_SQL})")
def occurrence_rows(spark, sf_dir):
    rows = ontology.occurrences(_records(spark, sf_dir).select("doc", "chunk_id", "content"))
    return rows.select("doc", "chunk_id", F.array_join("ata_codes", "|").alias("ata"), F.array_join("zones", "|").alias("zones"), F.array_join("part_numbers", "|").alias("numbers"), "task_kind")


_IMAGES_SQL = f"""
WITH {ocr_queries.CAPTIONS_SQL},
p AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END END AS n, {ocr_queries.PAGE_NAME} AS doc FROM documents WHERE doc_id % 9 <> 0),
i AS (SELECT doc_id, doc, unnest(range(n)) AS image_index FROM p),
c2 AS (SELECT i.*, m.* EXCLUDE (doc_id), row_number() OVER (PARTITION BY i.doc_id, image_index ORDER BY m.pos DESC) AS last FROM i JOIN m ON m.doc_id = i.doc_id AND m.pos <= image_index),
k AS (SELECT *, category IN ('front_matter', 'blank_page') OR empty AS e FROM c2 WHERE last = 1),
pol AS (SELECT *, CASE WHEN category = 'unreadable' THEN 'exclude' WHEN e AND confidence >= 0.75 THEN 'exclude' WHEN e THEN 'downweight' WHEN action <> 'index' THEN action WHEN confidence < 0.55 THEN 'downweight' ELSE 'index' END AS act FROM k)
SELECT trim(regexp_replace(lower(doc), '[^a-z0-9]+', '-', 'g'), '-') || '-' || (image_index + 1) AS id, doc, CAST(image_index AS INT) AS image_index, summary AS caption, act AS retrieval_action, md5('ABC') AS bytes_md5 FROM pol WHERE act <> 'exclude' AND summary <> ''"""


@query(_IMAGES_SQL)
def image_nodes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.expr(ocr_queries.PAGE_NAME)
    pages = ocr.parse_documents(docs.select(name.alias("doc"), F.expr(ocr_queries.OCR_JSON).alias("value")), "doc", "value")
    said = ocr.captions(docs.select(name.alias("doc"), F.expr(ocr_queries.CAPTIONS).alias("value")), "doc", "value")
    nodes = ontology.image_nodes(pages, ocr.with_policy(said))
    return nodes.select("id", "doc", "image_index", "caption", "retrieval_action", F.md5("content").alias("bytes_md5"))


@query(f"""
WITH {ocr_queries.CAPTIONS_SQL},
w AS (SELECT *, category IN ('front_matter', 'blank_page') OR empty AS e FROM m WHERE pos = 0),
s AS (SELECT doc_id, '> Image description: ' || summary AS said FROM w WHERE NOT (e AND confidence >= 0.75) AND (e OR action <> 'exclude')),
r AS (SELECT {ocr_queries.PAGE_NAME} AS doc, doc_id, {ocr_queries.PAGE_TEXT_SQL} AS t, doc_id % 6 IN (0, 2) AS bare, CASE WHEN doc_id % 11 = 0 THEN 2 ELSE 1 END AS n_listed FROM documents)
SELECT doc, rtrim(CASE WHEN said IS NULL THEN t WHEN bare THEN rtrim(t) || chr(10) || chr(10) || said ELSE regexp_replace(t, '!\\[[^\\]]*\\]\\([^)]*\\)', said, 'g') END) || chr(10) AS markdown, n_listed FROM r LEFT JOIN s USING (doc_id)""")
def enriched_sidecars(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.expr(ocr_queries.PAGE_NAME)
    pages = docs.select(name.alias("doc"), F.expr(ocr_queries.PAGE_TEXT.replace("\n", "\\n")).alias("markdown"))
    said = ocr.captions(docs.select(name.alias("doc"), F.expr(ocr_queries.CAPTIONS).alias("value")), "doc", "value")
    got = ocr.sidecars(pages, said)
    listed = F.size(F.from_json(F.get_json_object("json", "$.image_caption_analyses"), "array<string>"))
    return got.select("doc", "markdown", listed.alias("n_listed"))


@query("SELECT doc_id AS doc, doc_id % 2 = 0 AS again FROM documents")
def pages_read_once(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"))
    done = pages.filter("doc % 2 = 1").withColumn("value", F.lit("kept"))
    return ocr.read_pages(pages, done, lambda todo: todo.withColumn("value", F.lit("read"))).select("doc", (F.col("value") == "read").alias("again"))


@query("SELECT 'missing-image' AS kind, 'image:i' || s_suppkey AS id FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'missing-part', 'part:s' || s_suppkey FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT 'page-without-part', 's' || s_suppkey FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT 'too-few', 'pages: 2 of 5'")
def artefact_violations(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("k"))
    relations = s.select(F.concat(F.lit("part:s"), "k").alias("from"), F.concat(F.lit("image:i"), "k").alias("to"))
    images, parts = s.filter("s_suppkey % 3 <> 0").select(F.concat(F.lit("i"), "k").alias("id")), s.filter("s_suppkey % 4 <> 0").select(F.concat(F.lit("s"), "k").alias("slug"))
    found = ocr.violations(s.select(F.concat(F.lit("s"), "k").alias("slug")), relations, images, parts)
    return found.unionByName(ontology.minimum_counts({"pages": spark.range(2), "images": spark.range(3)}, {"pages": 5, "images": 3}))


_WIKI_PAGE_SQL = f"""
WITH r AS (SELECT *, {_SLUG} AS slug, 'ATA-' || regexp_extract(content, 'ATA (\\d\\d)', 1) AS code FROM ({RECORDS_SQL})),
p AS (SELECT slug, arg_min(parts, row_idx) AS seed, list_sort(list(DISTINCT code)) AS codes, list_sort(list(DISTINCT parts)) AS aliases, list_sort(list(DISTINCT doc)) AS docs FROM r GROUP BY slug),
t AS (SELECT *, array_to_string(list_transform(string_split(seed, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS title FROM p)
SELECT slug, title, array_to_string(['# ' || title, '', title || ' in ' || len(docs) || ' documents.', '', '## Canonical identity', '', '- Slug: `' || slug || '`', '- ATA: ' || array_to_string(codes, ', '), '- Zones: RH', '- Aliases: ' || array_to_string(aliases, ', '), '', '## Technical documents', '',
  array_to_string(list_transform(docs, lambda d: '- [' || d || '](../../pages/' || d || ')'), chr(10)), '', '## Linked occurrences', '', ''], chr(10)) AS markdown FROM t"""


@query(_WIKI_PAGE_SQL)
def built_wiki_pages(spark, sf_dir):
    records = _records(spark, sf_dir)
    path, mark = shared.new_path(spark, "knowledge"), "one"
    none = records.limit(0).select("doc", "chunk_id", "content")
    states = [build.ensure(rows, none, path, CharacterEmbedder(), m) for rows, m in ((None, mark), (records, mark), (records, mark))]
    assert states == ["missing", "built", "fresh"], states
    return spark.read.parquet(f"{path}/wiki")


@query(f"""
WITH r AS (SELECT *, {_SLUG} AS slug, regexp_extract(content, 'ATA (\\d\\d)', 1) AS code FROM ({RECORDS_SQL})), n AS (SELECT count(DISTINCT slug) AS p, count(DISTINCT (slug, code)) + count(DISTINCT slug) AS e, count(*) AS v FROM r)
SELECT v AS vectors_count, p AS parts_count, e AS relations_count, 0 AS occurrences_count, p AS wiki_count, 'built_of-mismatch' AS reasons FROM n""")
def built_manifest(spark, sf_dir):
    records = _records(spark, sf_dir)
    path = shared.new_path(spark, "knowledge")
    out = build.build(records, records.limit(0).select("doc", "chunk_id", "content"), path, CharacterEmbedder())
    counts = [f"{n}_count" for n in ("vectors", "parts", "relations", "occurrences", "wiki")]
    found = out.select(*counts).withColumn("built_of", F.lit("a"))
    reasons = writers.mismatches(found, {"built_of": "b", "occurrences_count": 0}).select(F.array_join("reasons", ",").alias("reasons"))
    return out.select(*counts[:3], F.col(counts[3]).cast("int").alias(counts[3]), counts[4]).join(F.broadcast(reasons))


@query("""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS pattern FROM benchmark)
SELECT w.pattern, count(*) AS n_docs, min(d.doc_id) AS first_doc FROM w JOIN documents d ON contains(lower(d.text), w.pattern) GROUP BY w.pattern""")
def patterns_in_documents(spark, sf_dir):
    """In how many documents each long word of the benchmark occurs, as part of a longer word too."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0)))
    named = table(spark, sf_dir, "benchmark").select(words.alias("pattern"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    return patterns.holding(texts, named).groupBy("pattern").agg(F.count("*").alias("n_docs"), F.min("id").alias("first_doc"))


# ---- streams


@query("""
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS seq, CASE turn % 2 WHEN 0 THEN 'delta' ELSE 'message' END AS event, 'x ' || role || CASE WHEN turn % 3 = 0 THEN chr(10) || 'more' ELSE '' END AS data FROM conversations""")
def framed_pieces(spark, sf_dir):
    """Blocks cut every seven characters: pieces of a conversation, in any order of rows."""
    block = F.concat(F.when(F.col("turn") % 2 == 0, "event: delta\n").otherwise(""), F.lit("data: x "), "role", F.when(F.col("turn") % 3 == 0, "\ndata: more").otherwise(""))
    whole = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("t"))
    cuts = F.transform(F.sequence(F.lit(0), F.floor(F.length("t") / 7)), lambda i: F.substring("t", (i * 7 + 1).cast("int"), F.lit(7)))
    pieces = whole.select("conv_id", F.posexplode(cuts).alias("seq", "text"))
    return stream.framed(pieces.repartition(3), "conv_id", "seq", "text")


@query("""
WITH r AS (SELECT conv_id, turn, CASE turn % 2 WHEN 0 THEN '{"a": ' || turn || '}' ELSE 'line ' || role || chr(10) || 'two' END AS t FROM conversations),
l AS (SELECT conv_id, turn, unnest(CASE turn % 2 WHEN 0 THEN [t] ELSE string_split(t, chr(10)) END) AS v, unnest(CASE turn % 2 WHEN 0 THEN [0] ELSE [0, 1] END) AS pos FROM r)
SELECT conv_id * 100 + turn AS id, pos, 'event: delta' || chr(10) || 'data: {"v":"' || replace(v, '"', '\\"') || '"}' || chr(10) || chr(10) AS block FROM l""")
def line_stream(spark, sf_dir):
    reply = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('{"a": '), F.col("turn").cast("string"), F.lit("}"))).otherwise(F.concat(F.lit("line "), "role", F.lit("\ntwo")))
    return stream.line_events(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), reply.alias("t")), "id", "t")


def _streamed(spark, sf_dir, name, plan):
    """The rows that a streaming plan over conversations gives until all of them are read."""
    source = shared.new_path(spark, "stream")
    table(spark, sf_dir, "conversations").write.parquet(source)
    rows = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    target = name + "_" + source[-8:]
    q = plan(rows).writeStream.format("memory").queryName(target).outputMode("update").option("checkpointLocation", shared.new_path(spark, "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    q.stop()
    return spark.table(target)


@query("""
WITH r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT conv_id AS session_id, CAST(count(*) AS INT) AS n_kept, CAST(min(turn) AS BIGINT) AS first_turn, CAST(max(turn) AS BIGINT) AS last_turn, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS history_md5 FROM r WHERE n <= 4 GROUP BY conv_id""")
def session_state_stream(spark, sf_dir):
    plan = lambda rows: stream.session_stream(rows.select(F.col("conv_id").cast("long").alias("session_id"), F.col("turn").cast("long").alias("turn"), "role", "text"))
    got = _streamed(spark, sf_dir, "sessions", plan)
    return got.select("session_id", "n_kept", "first_turn", "last_turn", F.md5(F.col("history").cast("binary")).alias("history_md5"))


def _timed_stream(spark, sf_dir, rows, plan, closing=None):
    """What a plan with timers gives for a stream of rows that comes in three batches, each holding pieces of every key.

    Read and written as files, so no result passes through the driver. closing: one more row, in a last batch.
    """
    source, target = shared.new_path(spark, "stream"), shared.new_path(spark, "streamed")
    files = max(3, spark.sparkContext.defaultParallelism)
    rows.repartition(files, F.xxhash64(*rows.columns[:2])).write.parquet(source)
    if closing is not None:
        closing.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // 3)).parquet(source)
    q = plan(stream).writeStream.format("parquet").option("checkpointLocation", shared.new_path(spark, "checkpoint")).option("path", target).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    shared.delete(spark, source)
    return spark.read.parquet(target)


def _seconds(x):
    return F.timestamp_seconds(F.lit(1_704_067_200) + x)


@query("""
SELECT CAST(conv_id AS VARCHAR) AS request_id, md5(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS text_md5, count(*) AS n_events, CAST(0 AS BIGINT) AS n_missing, true AS finished FROM conversations GROUP BY conv_id""")
def ordered_delta_stream(spark, sf_dir):
    """The turns of each conversation as deltas of a request that come in any order; one more event after the last ends it."""
    said = table(spark, sf_dir, "conversations")
    deltas = said.select(F.col("conv_id").cast("string").alias("request_id"), F.col("turn").alias("seq"), F.lit("delta").alias("event"), F.col("text").alias("delta"), _seconds(F.col("turn")).alias("ts"))
    ends = deltas.groupBy("request_id").agg((F.max("seq") + 1).alias("seq"), F.max("ts").alias("ts")).select("request_id", "seq", F.lit("done").alias("event"), F.lit(None).cast("string").alias("delta"), "ts")
    got = _timed_stream(spark, sf_dir, deltas.unionByName(ends), lambda rows: timed.ordered_deltas(rows, "1 hour", "1 hour"))
    return got.select("request_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), (F.col("n_events") - 1).alias("n_events"), "n_missing", "finished")


@query("""
WITH r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM conversations)
SELECT conv_id AS session_id, any_value(n_turns) AS n_turns, CAST(count(*) AS INT) AS n_kept, CAST(min(turn) AS BIGINT) AS first_turn, CAST(max(turn) AS BIGINT) AS last_turn, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS history_md5 FROM r WHERE n <= 4 GROUP BY conv_id""")
def expired_session_stream(spark, sf_dir):
    """Each conversation as a session that ends by its timer, after an event of another session a day later."""
    said = table(spark, sf_dir, "conversations")
    turns = said.select(F.col("conv_id").alias("session_id"), "turn", "role", "text", _seconds(F.col("turn")).alias("ts"))
    closing = spark.range(1).select(F.lit(-1).cast("long").alias("session_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("").alias("text"), _seconds(F.lit(86_400)).alias("ts"))
    got = _timed_stream(spark, sf_dir, turns, lambda rows: timed.expiring_sessions(rows, "1 hour", "1 hour"), closing)
    return got.select("session_id", "n_turns", "n_kept", "first_turn", "last_turn", F.md5(F.col("history").cast("binary")).alias("history_md5"))


@query("SELECT vec_id, norm_ok, dims_ok FROM (SELECT vec_id, true AS norm_ok, true AS dims_ok FROM embeddings WHERE vec_id % 20 = 0)")
def vector_channel_switch(spark, sf_dir):
    """A missing export turns the vector channel off; one that is there answers with its own rows first."""
    assert readers.read_vectors(spark, shared.new_path(spark, "none")) is None
    path, v = shared.new_path(spark, "vectors"), table(spark, sf_dir, "embeddings")
    writers.write_vectors(v, path)
    rows = readers.read_vectors(spark, path)
    asked = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    near = vector.knn(rows, asked, limit=1)
    return near.select(F.col("query_id").alias("vec_id"), (F.abs("distance") < 1e-5).alias("norm_ok"), (F.col("id") == F.col("query_id")).alias("dims_ok"))
