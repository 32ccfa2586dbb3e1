"""Queries of the OCR, caption, routing and batch operators, over JSON made of the columns of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvina.functions import text as X
from corvina.functions.providers import with_caption
from corvina.operators import corpus, ocr, profiles, routing
from corvina.plans import build
from corvina.plans.registry import dealt, query, table

#: Pages of two layouts with up to two images; texts of the documents' languages and sources only, so that JSON needs no escapes.
IMAGE = "concat('{\"id\": \"i\", \"', CASE WHEN doc_id % 2 = 0 THEN 'imageBase64' ELSE 'image_base64' END, '\": \"', CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE 'QUJD' END, '\", \"top_left_x\": 10, \"bottom_right_x\": ', 10 + doc_id % 120, '}')"
OCR_PAGE = f"""concat('{{"index": 0, "markdown": "', lang, ' page ', source, '"', CASE WHEN doc_id % 3 = 0 THEN concat(', "markdown_alt": "', CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'other' END, '"') ELSE '' END,
  ', "dimensions": {{"width": ', CASE WHEN doc_id % 5 = 0 THEN '0' ELSE '100' END, ', "height": 10}}, "images": [', CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN {IMAGE} ELSE concat({IMAGE}, ',', {IMAGE}) END, ']}}')"""
OCR_JSON = f"CASE WHEN doc_id % 9 = 0 THEN concat('{{\"markdown\": \"whole ', lang, '\"}}') WHEN doc_id % 2 = 0 THEN concat('{{\"pages\": [', {OCR_PAGE}, ']}}') ELSE concat('{{\"ocrResponse\": {{\"pages\": [', {OCR_PAGE}, ']}}}}') END"


@query("""
WITH p AS (SELECT *, doc_id % 9 = 0 AS bare, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS n FROM documents)
SELECT doc_id, CASE WHEN bare THEN 'whole ' || lang WHEN doc_id % 3 = 0 AND doc_id % 6 <> 0 THEN 'other' ELSE lang || ' page ' || source END AS markdown, CASE WHEN bare THEN 0 ELSE n END AS n_images,
  CASE WHEN bare OR n = 0 OR doc_id % 5 = 0 OR doc_id % 120 = 0 THEN 0.0 ELSE least(1.0, (doc_id % 120) / 100.0) END::DOUBLE AS width_coverage, CASE WHEN bare OR doc_id % 7 = 0 THEN 0 ELSE n END AS n_data FROM p""")
def ocr_documents(spark, sf_dir):
    got = ocr.parse_documents(table(spark, sf_dir, "documents").select("doc_id", F.expr(OCR_JSON).alias("value")), "doc_id", "value")
    return got.select(F.col("doc").alias("doc_id"), "markdown", "n_images", "width_coverage", F.size("images").alias("n_data"))


#: A caption with gaps, unknown names and numbers out of range; every eleventh document has a list of two.
CAPTION = """concat('{"page_category": "', CASE doc_id % 5 WHEN 0 THEN 'technical_table' WHEN 1 THEN 'unknown_thing' WHEN 2 THEN 'front_matter' WHEN 3 THEN 'blank_page' ELSE 'technical_diagram' END, '"',
  CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN ', "page_category_confidence": 1.7' WHEN 2 THEN ', "page_category_confidence": -2' ELSE ', "page_category_confidence": 0.6' END, CASE WHEN doc_id % 3 = 0 THEN ', "is_non_content_page": true' ELSE '' END,
  CASE doc_id % 7 WHEN 0 THEN ', "retrieval_action": "downweight", "retrieval_weight": 0.2' WHEN 1 THEN ', "retrieval_action": "burn"' ELSE '' END, ', "short_summary": " a  ', lang, ' summary ", "visible_text": ["  x ", "", "', source, '"]}')"""
CAPTIONS = f"CASE WHEN doc_id % 11 = 0 THEN concat('[', {CAPTION}, ', {{\"page_category\": \"unreadable\"}}]') ELSE {CAPTION} END"
CAPTIONS_SQL = f"""
c AS (SELECT doc_id, 0 AS pos, lang, source, doc_id % 5 AS k, doc_id % 4 AS p, doc_id % 3 = 0 AS said, doc_id % 7 AS a FROM documents),
n AS (SELECT doc_id, pos, CASE k WHEN 0 THEN 'technical_table' WHEN 1 THEN 'technical_procedure' WHEN 2 THEN 'front_matter' WHEN 3 THEN 'blank_page' ELSE 'technical_diagram' END AS category, CASE p WHEN 0 THEN 0.5 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 0.6 END::DOUBLE AS confidence,
  said OR k IN (2, 3) AS empty, a, CASE a WHEN 0 THEN 0.2 ELSE 1 END::DOUBLE AS weight, 'a ' || lang || ' summary' AS summary, 'x|' || source AS visible FROM c),
m AS (SELECT doc_id, pos, category, confidence, empty, CASE WHEN a = 0 THEN 'downweight' WHEN empty THEN 'exclude' ELSE 'index' END AS action, weight, summary, visible FROM n
  UNION ALL SELECT doc_id, 1, 'unreadable', 0.5, false, 'index', 1, '', '' FROM documents WHERE doc_id % 11 = 0)"""


def _captions(spark, sf_dir):
    return ocr.captions(table(spark, sf_dir, "documents").select("doc_id", F.expr(CAPTIONS).alias("value")), "doc_id", "value")


@query(f"WITH {CAPTIONS_SQL} SELECT doc_id, CAST(pos AS INT) AS pos, category, confidence, empty, action, weight, summary, visible FROM m")
def ocr_captions(spark, sf_dir):
    return _captions(spark, sf_dir).select(
        F.col("doc").alias("doc_id"), "pos", F.col("page_category").alias("category"), F.col("page_category_confidence").alias("confidence"), F.col("is_non_content_page").alias("empty"), F.col("retrieval_action").alias("action"),
        F.col("retrieval_weight").alias("weight"), F.col("short_summary").alias("summary"), F.array_join("visible_text", "|").alias("visible"),
    )


#: Pages for prepared rows: a page number in the name, and a text that is blank, a chapter heading over one image, a cover or prose with images.
PAGE_NAME = "concat('m', source, '_page_', doc_id % 5, '.pdf.', doc_id)"
PAGE_TEXT = "CASE doc_id % 6 WHEN 0 THEN ' ' WHEN 1 THEN '# ATA 28 fuel\n\n![a](b.png)' WHEN 2 THEN concat('issue ', doc_id) ELSE concat('tank ![x](y) of ![x](y) ', lang) END"
PAGE_TEXT_SQL = "CASE doc_id % 6 WHEN 0 THEN ' ' WHEN 1 THEN '# ATA 28 fuel' || chr(10) || chr(10) || '![a](b.png)' WHEN 2 THEN concat('issue ', doc_id) ELSE concat('tank ![x](y) of ![x](y) ', lang) END"


@query(f"""
WITH {CAPTIONS_SQL},
w AS (SELECT *, category IN ('front_matter', 'blank_page') OR empty AS e FROM m),
pol AS (SELECT doc_id, pos, summary, CASE WHEN category = 'unreadable' THEN 'exclude' WHEN e AND confidence >= 0.75 THEN 'exclude' WHEN e THEN 'downweight' WHEN action <> 'index' THEN action WHEN confidence < 0.55 THEN 'downweight' ELSE 'index' END AS action,
  CASE WHEN category = 'unreadable' THEN 'unreadable-page' WHEN e AND confidence >= 0.75 THEN 'high-confidence-non-content' WHEN e AND confidence >= 0.55 THEN 'medium-confidence-non-content' WHEN e THEN 'low-confidence-non-content'
    WHEN action = 'exclude' THEN 'caption-requested-exclusion' WHEN action = 'downweight' THEN 'caption-requested-downweight' WHEN confidence < 0.55 THEN 'low-confidence-technical-classification' ELSE 'technical-content' END AS reason FROM w),
d AS (SELECT doc_id, {PAGE_NAME} AS doc, {PAGE_TEXT_SQL} AS t, doc_id % 6 AS k, doc_id % 5 AS page, doc_id % 2 = 0 AS captioned FROM documents),
own AS (SELECT *, CASE WHEN k = 0 THEN 'exclude' WHEN page BETWEEN 1 AND 2 AND regexp_matches(t, '\\b({corpus.COVER_WORDS})\\b') THEN 'downweight' ELSE 'index' END AS a,
  CASE WHEN k = 0 THEN 'high-confidence-non-content' WHEN page BETWEEN 1 AND 2 AND regexp_matches(t, '\\b({corpus.COVER_WORDS})\\b') THEN 'medium-confidence-non-content' ELSE 'technical-content' END AS r FROM d),
j AS (SELECT own.*, p.action AS pa, p.reason AS pr FROM own LEFT JOIN pol p ON captioned AND p.doc_id = own.doc_id AND p.pos = 0),
f AS (SELECT *, CASE WHEN k = 1 THEN 'exclude' ELSE coalesce(pa, a) END AS action, coalesce(pr, r) AS reason FROM j),
s AS (SELECT doc_id, summary FROM pol WHERE pos = 0 AND action <> 'exclude' AND summary <> ''),
x AS (SELECT f.*, '> Image description: ' || s.summary AS said FROM f LEFT JOIN s ON captioned AND s.doc_id = f.doc_id)
SELECT doc, 0 AS pos, trim(CASE WHEN said IS NULL THEN t WHEN k > 2 THEN replace(t, '![x](y)', said) ELSE rtrim(t, ' ') || chr(10) || chr(10) || said END, ' ' || chr(10)) AS chunk, doc || ' 0' AS chunk_id, action, reason
FROM x WHERE action <> 'exclude' AND trim(CASE WHEN said IS NULL THEN t ELSE 'x' END) <> ''""")
def prepared_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pages = docs.select(F.expr(PAGE_NAME).alias("doc"), F.expr(PAGE_TEXT.replace("\n", "\\n")).alias("markdown"), (F.col("doc_id") % 6 == 1).cast("int").alias("n_images"), F.lit(0.95).alias("width_coverage"))
    names = docs.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("doc"), F.expr(PAGE_NAME).alias("name"))
    captions = _captions(spark, sf_dir).join(names, "doc").drop("doc").withColumnRenamed("name", "doc")
    return ocr.prepared(pages, captions)


# ---- profiles, routes and the cascade

KINDS = "CASE doc_id % 6 WHEN 0 THEN 'wiring_signal_bus_diagram' WHEN 1 THEN 'technical_table' WHEN 2 THEN 'simple_labeled_component_view' WHEN 3 THEN 'nonsense' WHEN 4 THEN 'cockpit_panel_or_display' ELSE 'other' END"
PROFILE_JSON = f"""concat('{{', CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '"page_category": "technical_photo", ' WHEN 2 THEN '"page_category": "technical_diagram", ' WHEN 3 THEN '"page_category": "odd", ' ELSE '"page_category": " ", ' END,
  CASE WHEN doc_id % 4 = 0 THEN concat('"short_summary": "sum ', lang, '", ') ELSE '' END, '"routing_profile_v1": {{"visual_content_type": "', {KINDS}, '", "domain_candidates": ["', CASE doc_id % 3 WHEN 0 THEN 'fuel", "fuel' WHEN 1 THEN 'moon' ELSE ' ' END,
  '"], "rag_signal": {{"ocr_markdown_sufficient": "', CASE doc_id % 2 WHEN 0 THEN ' Yes' ELSE 'no' END, '", "retrieval_terms": [" rev ", "", "', lang, '"]}}, "wiki_signal": {{"has_entity_relationships": "true", "has_component_hierarchy": ', CASE doc_id % 2 WHEN 0 THEN 'true' ELSE '"1"' END,
  ', "entity_candidates": [', array_to_string_of_entities, '], "relationship_candidates": [{{"source": "a", "relation": "feeds", "target": "b"}}, {{"source": "a", "relation": "eats", "target": "c"}}, {{"source": "a", "target": " "}}]}}, "routing_evidence": ["seen"]}}}}')"""
ENTITY_LIST = """CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN '{"label": " "}' ELSE concat('{"label": "pump ', lang, '", "type": "valve", "evidence": "e"}, {"label": "x", "type": "moon"}') END"""
PROFILE_JSON = PROFILE_JSON.replace("array_to_string_of_entities", ENTITY_LIST)


@query(f"""
WITH d AS (SELECT doc_id, lang, doc_id % 5 AS b, CASE doc_id % 5 WHEN 1 THEN 'technical_photo' WHEN 2 THEN 'technical_diagram' WHEN 3 THEN 'technical_procedure' END AS base, {KINDS} AS given, doc_id % 7 AS e FROM documents),
k AS (SELECT *, CASE WHEN given <> 'nonsense' THEN given WHEN base IS NULL THEN 'technical_procedure' WHEN base = 'technical_diagram' THEN 'unclear' ELSE base END AS kind, CASE doc_id % 3 WHEN 0 THEN 'fuel' ELSE 'unknown' END AS domains,
  CASE WHEN e <= 1 THEN '' ELSE 'pump ' || lang || ':valve|x:other' END AS entities FROM d),
s AS (SELECT *, coalesce(base, CASE WHEN kind IN ('technical_table', 'technical_photo', 'technical_procedure') THEN kind ELSE 'technical_diagram' END) AS category, CASE WHEN doc_id % 4 = 0 THEN 'sum ' || lang ELSE replace(kind, '_', ' ') || ': rev, ' || lang || '.' END AS summary FROM k)
SELECT doc_id, kind, category, domains, doc_id % 2 = 0 AS enough, 'rev|' || lang AS terms, entities, 'a feeds b|a other c' AS relations, summary,
  summary || CASE WHEN entities = '' THEN '' ELSE ' Entities: pump ' || lang || ' (valve, e); x (other).' END || ' Relationships: a feeds b; a other c. Evidence: seen.' AS description, kind IN ('wiring_signal_bus_diagram') AS deep,
  CASE WHEN kind = 'wiring_signal_bus_diagram' THEN 'relationship-heavy visual type: ' || kind WHEN kind IN ('technical_table', 'technical_photo') THEN '{routing.WHY["plain"]}' ELSE '{routing.WHY["default"]}' END AS reason FROM s""")
def routing_profiles(spark, sf_dir):
    got = profiles.routed(profiles.profiles(table(spark, sf_dir, "documents").select("doc_id", F.expr(PROFILE_JSON).alias("value")), "doc_id", "value"))
    entities = F.transform("entity_candidates", lambda e: F.concat_ws(":", e["label"], e["type"]))
    relations = F.transform("relationship_candidates", lambda r: F.concat_ws(" ", r["source"], r["relation"], r["target"]))
    return got.select(
        F.col("doc").alias("doc_id"), F.col("visual_content_type").alias("kind"), F.col("page_category").alias("category"), F.array_join("domain_candidates", "|").alias("domains"), F.col("ocr_markdown_sufficient").alias("enough"),
        F.array_join("retrieval_terms", "|").alias("terms"), F.array_join(entities, "|").alias("entities"), F.array_join(relations, "|").alias("relations"), F.col("short_summary").alias("summary"), F.col("technical_description").alias("description"),
        (F.col("route") == routing.DEEP).alias("deep"), "reason",
    )


@query("""
WITH c AS (SELECT doc_id, (['cover_page', 'blank_page', 'technical_table', 'technical_diagram', 'unreadable', 'wiring_signal_bus_diagram', 'other'])[doc_id % 7 + 1] AS name FROM documents)
SELECT doc_id, name, CASE WHEN name IN ('cover_page', 'blank_page', 'technical_table') THEN name WHEN name = 'technical_diagram' THEN 'unclear' ELSE 'other' END AS type_of, CASE WHEN name IN ('cover_page', 'blank_page', 'technical_table') THEN name ELSE 'technical_diagram' END AS category_of FROM c""")
def category_and_type(spark, sf_dir):
    names = ("cover_page", "blank_page", "technical_table", "technical_diagram", "unreadable", "wiring_signal_bus_diagram", "other")
    rows = dealt(spark, sf_dir, "documents", "doc_id", [(n,) for n in names], "name string")
    return rows.select(F.col("id").alias("doc_id"), "name", profiles.type_of_category(F.col("name")).alias("type_of"), profiles.category_of_type(F.col("name")).alias("category_of"))


CASCADE = f"doc_id, CASE WHEN doc_id % 3 = 0 THEN '{routing.DEEP}' ELSE '{routing.LIGHT}' END AS route, CASE WHEN doc_id % 5 <> 0 THEN concat('light ', doc_id) END AS light, CASE WHEN doc_id % 5 = 0 THEN 'timeout' END AS light_error, CASE WHEN doc_id % 4 <> 0 THEN concat('deep ', doc_id) END AS deep, CASE WHEN doc_id % 4 = 0 THEN 'refused' END AS deep_error"


@query(f"""
WITH c AS (SELECT {CASCADE} FROM documents), t AS (SELECT *, CASE WHEN light IS NULL THEN 'technical_retry' WHEN route <> '{routing.DEEP}' THEN 'nano_route' WHEN deep IS NULL THEN 'deep_pass_failed_fallback_to_nano' ELSE 'routing_deep_pass' END AS trigger FROM c)
SELECT doc_id AS doc, CASE WHEN trigger IN ('technical_retry', 'routing_deep_pass') THEN deep ELSE light END AS selected, CASE WHEN trigger IN ('technical_retry', 'routing_deep_pass') THEN '{routing.DEEP}' ELSE '{routing.LIGHT_MODEL}' END AS model, trigger, light_error, deep_error FROM t""")
def caption_cascade(spark, sf_dir):
    return profiles.cascade(table(spark, sf_dir, "documents").selectExpr(*CASCADE.replace("doc_id,", "doc_id AS doc|", 1).replace(", CASE", "| CASE").split("|")))


# ---- batches

BATCH_DOC = "concat('Manual ', source, ' ', doc_id, '.PDF')"
ID_SQL = f"'primary:' || left(trim(regexp_replace(regexp_replace({BATCH_DOC}, '\\.pdf$', '', 'i'), '[^a-z0-9_-]+', '-', 'gi'), '-'), 180)"


def _batch_pages(spark, sf_dir):
    images = F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("data:"), "lang")))
    return table(spark, sf_dir, "documents").select(F.expr(BATCH_DOC).alias("doc"), F.col("source").alias("markdown"), images.alias("images"), "doc_id")


@query(f"""
SELECT {ID_SQL} AS custom_id, {BATCH_DOC} AS doc, concat('{{"custom_id":"', {ID_SQL}, '","method":"POST","url":"/v1/responses","body":{{"model":"m","markdown":"', source, '","images":["data:', lang, '"],"max_output_tokens":500}}}}') AS line
FROM documents WHERE doc_id % 4 <> 0""")
def batch_requests(spark, sf_dir):
    return profiles.requests(_batch_pages(spark, sf_dir), "primary", "m", 500)


@query(f"""
WITH a AS (SELECT {ID_SQL} AS custom_id, {BATCH_DOC} AS doc, doc_id, doc_id % 5 AS k FROM documents WHERE doc_id % 4 <> 0)
SELECT CASE WHEN k = 3 THEN 'lost:' || doc_id ELSE custom_id END AS custom_id, CASE WHEN k <> 3 THEN doc END AS doc, CASE WHEN k = 0 THEN 'said ' || doc_id END AS text,
  CASE k WHEN 1 THEN doc || ': too long' WHEN 2 THEN doc || ': response status 500' WHEN 3 THEN 'Unknown custom_id: lost:' || doc_id WHEN 4 THEN doc || ': response status 0' END AS failure FROM a""")
def batch_results(spark, sf_dir):
    asked = profiles.requests(_batch_pages(spark, sf_dir), "primary", "m", 500)
    rows = asked.withColumn("n", F.regexp_extract("doc", r" (\d+)\.PDF$", 1).cast("long")).withColumn("k", F.col("n") % 5)
    named = F.when(F.col("k") == 3, F.concat(F.lit("lost:"), F.col("n").cast("string"))).otherwise(F.col("custom_id"))
    rest = (
        F.when(F.col("k").isin(0, 3), F.concat(F.lit('"response": {"status_code": 200, "body": "said '), F.col("n").cast("string"), F.lit('"}')))
        .when(F.col("k") == 1, '"error": {"message": "too long"}').when(F.col("k") == 2, '"response": {"status_code": 500}').otherwise('"response": null')
    )
    lines = rows.select(F.concat(F.lit('{"custom_id": "'), named, F.lit('", '), rest, F.lit("}")).alias("value"))
    return profiles.results(lines, asked)


@query(f"""
WITH a AS (SELECT lang, source, doc_id % 5 AS k, doc_id FROM documents WHERE doc_id % 4 <> 0)
SELECT count(*) FILTER (WHERE k = 0) AS imported, count(*) FILTER (WHERE k <> 0) AS failed, count(*) FILTER (WHERE k = 0 AND doc_id % 3 <> 0) AS routed_nano, count(*) FILTER (WHERE k = 0 AND doc_id % 3 = 0) AS routed_deep FROM a""")
def batch_import_counters(spark, sf_dir):
    got = batch_results(spark, sf_dir).withColumn("n", F.regexp_extract("doc", r" (\d+)\.PDF$", 1).cast("long"))
    return profiles.import_counters(got.withColumn("route", F.when(F.col("n") % 3 == 0, routing.DEEP).otherwise(routing.LIGHT)))


@query(f"""
WITH p AS (SELECT 'primary' AS phase, {BATCH_DOC} AS doc FROM documents WHERE lang <> 'fr'), d AS (SELECT 'deep', {BATCH_DOC} FROM documents WHERE doc_id % 3 = 0 AND (doc_id % 2 = 0 OR doc_id % 5 = 0)),
f AS (SELECT 'forced', {BATCH_DOC} FROM documents) SELECT * FROM p UNION ALL SELECT * FROM d UNION ALL SELECT * FROM f""")
def batch_pending(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("doc", F.expr(BATCH_DOC))
    pages, captioned = docs.select("doc"), docs.filter("lang = 'fr'").select("doc")
    model = F.when(F.col("doc_id") % 2 == 0, routing.LIGHT_MODEL).when(F.col("doc_id") % 5 != 0, routing.DEEP)
    audits = docs.select("doc", F.when(F.col("doc_id") % 3 == 0, routing.DEEP).otherwise(routing.LIGHT).alias("route"), model.alias("model"))
    parts = [("primary", "primary", False), ("deep", "deep", False), ("forced", "primary", True)]
    out = None
    for name, phase, force in parts:
        some = profiles.pending(pages, captioned, audits, phase, force).select(F.lit(name).alias("phase"), "doc")
        out = some if out is None else out.unionByName(some)
    return out


@query("SELECT arg_max(url, (page_id // 10, url)) AS path FROM pages")
def latest_manifest(spark, sf_dir):
    return profiles.latest(table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.floor(F.col("page_id") / 10).alias("modificationTime")))


@query("""
WITH r AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'gpt-5.4' ELSE 'nano' END AS route, CASE WHEN doc_id % 6 = 0 THEN 'gpt-5.4' ELSE 'gpt-5.4-nano' END AS model, lang AS profile, quality FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'profile' AS by, profile AS name, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 'model', model, count(*) FROM r GROUP BY ALL UNION ALL SELECT 'route', route, count(*) FROM r GROUP BY ALL""")
def routing_review_counts(spark, sf_dir):
    deep = F.col("doc_id") % 6 == 0
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("profile"), F.when(deep, routing.DEEP).otherwise(routing.LIGHT_MODEL).alias("model"), F.when(deep, routing.DEEP).otherwise(routing.LIGHT).alias("route"))
    return routing.review_counts(rows, ["profile", "model", "route"])


@query(f"""
WITH c AS (SELECT lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
SELECT '| ' || lang || ' \\| x | ' || quality || ' | ' || n || ' |' AS line FROM c""")
def markdown_report_rows(spark, sf_dir):
    n = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"))
    return n.select(X.markdown_row(F.concat("lang", F.lit(" | x\n")), F.col("quality"), F.col("n")).alias("line"))


_SAMPLE_SQL = "SELECT doc_id AS doc, m.model FROM documents, (SELECT unnest(['nano', 'deep']) AS model) m"


@query(f"""
WITH s AS ({_SAMPLE_SQL}), t AS (SELECT *, CASE WHEN doc % 3 = 0 AND model = 'nano' THEN 'cached' WHEN doc % 7 = 0 THEN 'failed' ELSE 'ok' END AS status FROM s) SELECT * FROM t""")
def caption_benchmark(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"))
    runs = routing.benchmark_runs(docs, ["nano", "deep"])
    done = runs.filter("doc % 3 = 0 AND model = 'nano'").withColumn("status", F.lit("cached"))
    todo = routing.unfinished(runs, done, ["doc", "model"])
    return done.unionByName(todo.withColumn("status", F.when(F.col("doc") % 7 == 0, "failed").otherwise("ok")))


#: When a run took how long, by the length of its page; failed runs of every fifth page have no time.
_MILLIS = "CASE WHEN status = 'failed' AND doc % 5 = 0 THEN NULL ELSE n_chars % 997 + CASE WHEN model = 'deep' THEN 500 ELSE 20 END END"


@query(f"""
WITH s AS (SELECT doc_id AS doc, n_chars, m.model FROM documents, (SELECT unnest(['nano', 'deep']) AS model) m), t AS (SELECT *, CASE WHEN doc % 7 = 0 THEN 'failed' ELSE 'ok' END AS status FROM s),
r AS (SELECT model, status, CAST({_MILLIS} AS DOUBLE) AS millis FROM t)
SELECT model, status, count(*) AS n, quantile_disc(millis, 0.5) AS p50, quantile_disc(millis, 0.9) AS p90, max(millis) AS most FROM r WHERE millis IS NOT NULL GROUP BY ALL""")
def caption_latency(spark, sf_dir):
    """Quantiles of two jobs' runs, whose sketches are made apart and merged."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "n_chars")
    runs = routing.benchmark_runs(docs, ["nano", "deep"]).withColumn("status", F.when(F.col("doc") % 7 == 0, "failed").otherwise("ok")).withColumn("millis", F.expr(_MILLIS))
    jobs = [routing.latency_sketches(runs.filter(F.col("doc") % 2 == i), "millis") for i in (0, 1)]
    return routing.latency(jobs[0].unionByName(jobs[1]))


_REPLAY_SQL = """
WITH c AS (SELECT doc_id AS doc, quality, CASE WHEN doc_id % 4 = 0 THEN 'gpt-5.4' ELSE 'nano' END AS route, CASE quality WHEN 1 THEN 'nano_sufficient' ELSE 'deep_required' END AS label FROM labels)
SELECT count(*) AS total_pages, count(*) FILTER (WHERE route = 'nano') AS routed_nano, count(*) FILTER (WHERE route = 'gpt-5.4') AS routed_deep, count(*) FILTER (WHERE route = 'nano' AND quality = 0) AS false_nano,
  count(*) FILTER (WHERE route = 'gpt-5.4' AND quality = 1) AS false_deep, CAST(0 AS BIGINT) AS ambiguous, CAST(0 AS BIGINT) AS unlabeled, count(*) FILTER (WHERE route = 'gpt-5.4') / count(*) AS deep_ratio, 'revise_matrix' AS decision FROM c"""


@query(_REPLAY_SQL)
def replayed_calibration(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    pages = labels.select(F.col("doc_id").alias("doc"))
    route = F.when(F.col("doc") % 4 == 0, routing.DEEP).otherwise(routing.LIGHT)
    cached = pages.filter("doc % 3 = 0").withColumn("route", route)
    named = labels.select(F.col("doc_id").alias("doc"), F.when(F.col("quality") == 1, "nano_sufficient").otherwise("deep_required").alias("label"))
    return routing.replay(pages, cached, lambda todo: todo.withColumn("route", route), named)


@query(f"SELECT 'primary' AS phase, 'm' AS model, count(*) AS n_requests, count(DISTINCT {ID_SQL}) AS n_ids FROM documents WHERE doc_id % 4 <> 0")
def batch_manifest(spark, sf_dir):
    asked = profiles.requests(_batch_pages(spark, sf_dir), "primary", "m", 500)
    return profiles.batch_manifest(asked, "primary", "m").drop("ids_mark")


@query("SELECT count(*) AS requested, count(*) FILTER (WHERE doc_id % 5 <> 3) AS answered, count(*) FILTER (WHERE doc_id % 5 IN (1, 2, 4)) AS failed, count(*) FILTER (WHERE doc_id % 5 = 3) AS open FROM documents WHERE doc_id % 4 <> 0")
def batch_status(spark, sf_dir):
    asked = profiles.requests(_batch_pages(spark, sf_dir), "primary", "m", 500)
    return profiles.batch_status(asked, batch_results(spark, sf_dir))


class _LengthCaptioner:
    """Says how long a page is; a stand-in for a model."""

    def caption(self, doc: str, markdown: str) -> str:
        return f"{doc}: {len(markdown)}"


@query("SELECT doc_id, 'd' || doc_id || ': ' || length(text) AS caption FROM documents")
def offline_captions(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.format_string("d%d", "doc_id").alias("doc"), F.col("text").alias("markdown"))
    return with_caption(rows, _LengthCaptioner()).select("doc_id", "caption")


@query(f"""
WITH p AS (SELECT doc_id, lang, {PAGE_NAME} AS doc, doc_id % 2 = 0 AS kept FROM documents)
SELECT doc, 0 AS pos, CASE WHEN kept THEN 'old ' ELSE 'new ' END || lang AS chunk, doc || ' 0' AS chunk_id, 'index' AS action, 'technical-content' AS reason FROM p""")
def ocr_pipeline(spark, sf_dir):
    """Every second page was read before; the others are read now. No page has a caption."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.expr(PAGE_NAME).alias("doc"))
    said = lambda word: F.concat(F.lit('{"markdown": "' + word + " "), "lang", F.lit('"}'))
    done = docs.filter("doc_id % 2 = 0").select("doc", said("old").alias("value"))
    none = docs.limit(0).select("doc", F.lit("").alias("value"))
    return build.ocr_corpus(docs, done, lambda todo: todo.withColumn("value", said("new")), none)
