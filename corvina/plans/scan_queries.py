"""Queries of the scans and sinks: tables are written as files into the shared work folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvina.functions import text as X
from corvina.operators import corpus, evaluation, routing
from corvina.plans import sql
from corvina.plans.registry import WEIGHTS, documents_index, query, table
from corvina.sources import readers, shared, writers

#: Columns of a technical document's row: names, JSON and text with tabs, quotes, backslashes and line ends in them.
TECH = {
    "doc": "concat('doc', doc_id, '.pdf')", "doc_root": "CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END", "json_data": "concat('{\"a\": \"', lang, '\"}')",
    "chunk": "CASE WHEN doc_id % 9 = 0 THEN '  ' ELSE replace(text, chr(13), '') END", "length": "concat(length(text), CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE '' END)", "chunk_id": "concat('doc', doc_id, '.pdf 0')",
    "ata": "concat('ATA ', doc_id % 90 + 10)", "parts": "concat('door', chr(9), 'frame ', chr(92), ' \"x\"')", "doc_type": "lang",
}
TECH_SQL = ", ".join(f"{e} AS {n}" for n, e in TECH.items())


def _tech(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr(*[f"cast({e} as string) AS {n}" for n, e in TECH.items()])


def _written_tsv(spark, rows, columns, header, gz):
    path = shared.new_path(spark, "tsv")
    writers.write_tsv(rows, path, columns, header=header, gz=gz)
    return path


@query(f"SELECT doc, doc_root, json_data, md5(chunk) AS chunk_md5, length, chunk_id, ata, parts, doc_type FROM (SELECT {TECH_SQL} FROM documents)")
def tsv_scan(spark, sf_dir):
    got = readers.read_tech_docs(spark, _written_tsv(spark, _tech(spark, sf_dir), list(readers.TECH_COLUMNS), True, False))
    return got.filter("_corrupt IS NULL").select(*[F.md5(F.col(c).cast("binary")).alias("chunk_md5") if c == "chunk" else c for c in readers.TECH_COLUMNS])


@query(f"""
WITH r AS (SELECT *, doc_id FROM (SELECT {TECH_SQL}, doc_id, text FROM documents))
SELECT doc, chunk_id, md5(regexp_replace(chunk, '^\\s+|\\s+$', '', 'g')) AS content_md5, json_data AS source_path, coalesce(TRY_CAST(regexp_extract(length, '^(\\d+)', 1) AS INT), 0) AS length, ata FROM r
WHERE regexp_replace(chunk, '^\\s+|\\s+$', '', 'g') <> '' AND doc_id % 2 = 0""")
def tech_records_of_pages(spark, sf_dir):
    scanned = readers.read_tech_docs(spark, _written_tsv(spark, _tech(spark, sf_dir), list(readers.TECH_COLUMNS), True, True))
    pages = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("doc"))
    got = corpus.tech_records(readers.with_pages(scanned, pages))
    return got.select("doc", "chunk_id", F.md5(F.col("content").cast("binary")).alias("content_md5"), "source_path", "length", F.col("metadata")["ata"].alias("ata"))


EVENT_SQL = "SELECT doc_id, concat('ATA-', doc_id % 90 + 10, '-e', doc_id) AS doc, concat('c-', 100 + doc_id % 7, '-', doc_id // 2) AS chunk_id, CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE ' ' || replace(text, chr(13), '') END AS chunk FROM documents"


def _events(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit("\r"), F.lit("")))
    number = F.col("doc_id").cast("string")
    return rows.select(
        "doc_id", F.concat(F.lit("ATA-"), (F.col("doc_id") % 90 + 10).cast("string"), F.lit("-e"), number).alias("doc"),
        F.concat(F.lit("c-"), (100 + F.col("doc_id") % 7).cast("string"), F.lit("-"), F.floor(F.col("doc_id") / 2).cast("string")).alias("chunk_id"), F.when(F.col("doc_id") % 10 == 0, " ").otherwise(F.concat(F.lit(" "), "text")).alias("chunk"),
    )


@query(f"""
WITH e AS ({EVENT_SQL}), c AS (SELECT *, left(regexp_replace(chunk, '^\\s+|\\s+$', '', 'g'), 30000) AS content FROM e)
SELECT doc, chunk_id, md5(content) AS content_md5, regexp_extract(chunk_id, '-(\\d{{3}})-', 1) AS task_kind, 'ATA-' || doc[5:6] AS ata FROM c WHERE content <> ''""")
def event_records(spark, sf_dir):
    path = _written_tsv(spark, _events(spark, sf_dir), list(readers.EVENT_COLUMNS), False, True)
    got = corpus.event_records(readers.read_events(spark, path))
    # the first code in order, which a document that names others may not have first
    return got.select("doc", "chunk_id", F.md5(F.col("content").cast("binary")).alias("content_md5"), F.col("metadata")["task_kind"].alias("task_kind"), F.col("metadata")["ATA_code"].alias("ata"))


@query(f"""
WITH e AS (SELECT * FROM ({EVENT_SQL}) QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY doc) = 1), c AS (SELECT *, left(regexp_replace(chunk, '^\\s+|\\s+$', '', 'g'), 30000) AS content FROM e)
SELECT doc, chunk_id, length(content) AS n_chars FROM c WHERE content <> ''""")
def event_records_deduplicated(spark, sf_dir):
    return corpus.event_records(_events(spark, sf_dir).drop("doc_id"), dedupe=True).select("doc", "chunk_id", F.length("content").cast("long").alias("n_chars"))


@query(f"SELECT doc, len(string_split(chunk, chr(10))) AS n_lines, md5(chunk) AS chunk_md5 FROM ({EVENT_SQL})")
def raw_tsv_scan(spark, sf_dir):
    path = _written_tsv(spark, _events(spark, sf_dir), list(readers.EVENT_COLUMNS), False, False)
    got = readers.read_raw_tsv(spark, path)
    return got.select(F.col("fields")[0].alias("doc"), F.size(F.split(F.col("fields")[2], "\n")).cast("long").alias("n_lines"), F.md5(F.col("fields")[2].cast("binary")).alias("chunk_md5"))


def _sql_field(x: str) -> str:
    quoted = f"replace(replace({x}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34))"
    return f"CASE WHEN regexp_matches({x}, '[\"\\t\\r\\n\\\\]') THEN chr(34) || {quoted} || chr(34) ELSE {x} END"


@query(f"""
WITH r AS (SELECT {" || chr(9) || ".join(_sql_field(c) for c in readers.EVENT_COLUMNS)} || chr(13) AS raw FROM ({EVENT_SQL}))
SELECT count(*) AS n_rows, CAST(sum(len(string_split(raw, chr(10)))) AS BIGINT) AS n_lines, CAST(sum(octet_length(encode(raw)) + 1) AS BIGINT) AS n_bytes, true AS exact, count(*) < 2 AS exact_if_swapped, false AS exact_without_cr FROM r""")
def canonical_gz_round_trip(spark, sf_dir):
    """Records that end with carriage returns, written and read back; two that change places or a lost one are told."""
    columns = [X.tsv_field(F.col(c)) for c in readers.EVENT_COLUMNS]
    rows = _events(spark, sf_dir).select(F.col("doc_id").alias("order"), F.concat(F.concat_ws("\t", *columns), F.lit("\r")).alias("raw"))
    path = shared.new_path(spark, "canonical")
    audit = writers.write_canonical(rows, path)
    low, high = rows.agg(F.min("order"), F.max("order")).first()
    swapped = rows.withColumn("order", F.when(F.col("order") == low, high).when(F.col("order") == high, low).otherwise(F.col("order")))
    others = [writers.audit_text(r, path)["exact"] for r in (swapped, rows.withColumn("raw", F.when(F.col("order") == high, F.rtrim("raw", F.lit("\r"))).otherwise(F.col("raw"))))]
    return spark.createDataFrame([(audit["rows"], audit["n_lines"], audit["n_bytes"], audit["exact"], *others)], "n_rows long, n_lines long, n_bytes long, exact boolean, exact_if_swapped boolean, exact_without_cr boolean")


@query("SELECT 'p' || page_id || ' x.md' AS doc, 'p' || page_id || ' x' AS chunk_id, md5(html) AS content_md5 FROM pages")
def markdown_tree_scan(spark, sf_dir):
    path = shared.new_path(spark, "tree")
    writers.write_files(table(spark, sf_dir, "pages").select(F.format_string("p%d x.md", "page_id").alias("name"), F.col("html").alias("content")), path)
    return readers.read_markdown(spark, path).select("doc", "chunk_id", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("""
SELECT 'ATA-' || (page_id % 60 + 10) || '-' || page_id AS nc_event_id, CAST(page_id % 60 + 10 AS VARCHAR) AS ATA_code, coalesce(CASE WHEN page_id % 60 + 10 < 40 THEN 'Category ' || (page_id % 60 + 10) END, 'Unknown') AS ATA_category, url AS url_value
FROM pages WHERE page_id % 5 <> 0""")
def json_tree_scan(spark, sf_dir):
    path = shared.new_path(spark, "json")
    name = F.concat(F.lit("ATA-"), (F.col("page_id") % 60 + 10).cast("string"), F.lit("-"), F.col("page_id").cast("string"), F.lit(".json"))
    body = F.when(F.col("page_id") % 5 == 0, "{").otherwise(F.to_json(F.struct("url", F.struct("page_id").alias("inner"))))
    writers.write_files(table(spark, sf_dir, "pages").select(name.alias("name"), body.alias("content")), path)
    ata = spark.range(10, 40).select(F.col("id").cast("string").alias("ATA_code"), F.concat(F.lit("Category "), F.col("id").cast("string")).alias("ATA_category"))
    return readers.read_json_objects(spark, path, ata).select("nc_event_id", "ATA_code", "ATA_category", F.col("payload")["url"].alias("url_value"))


@query("""
WITH f AS (SELECT 'p' || page_id || CASE page_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' ELSE '.txt' END AS doc FROM pages)
SELECT doc, row_number() OVER (ORDER BY doc COLLATE en, doc) AS n FROM f WHERE ends_with(lower(doc), '.pdf') QUALIFY row_number() OVER (ORDER BY doc COLLATE en, doc) <= 12""")
def page_listing(spark, sf_dir):
    from pyspark.sql import Window

    path = shared.new_path(spark, "listing")
    kind = F.when(F.col("page_id") % 3 == 0, ".pdf").when(F.col("page_id") % 3 == 1, ".PDF").otherwise(".txt")
    writers.write_files(table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), kind).alias("name"), F.lit("x").alias("content")), path)
    return readers.list_pages(spark, path, limit=12).select("doc", F.row_number().over(Window.orderBy(*X.in_locale("doc"))).cast("long").alias("n"))


@query("SELECT 'p' || page_id || '.png' AS name, md5(html) AS content_md5, octet_length(encode(html)) AS bytes FROM pages")
def copied_assets(spark, sf_dir):
    path, target = shared.new_path(spark, "assets"), shared.new_path(spark, "copied")
    writers.write_files(table(spark, sf_dir, "pages").select(F.format_string("p%d.png", "page_id").alias("name"), F.col("html").alias("content")), path)
    spark.range(3).write.parquet(target)  # what was there goes
    writers.copy_assets(spark, path, target)
    return spark.read.parquet(target).select("name", F.md5("content").alias("content_md5"), F.octet_length("content").cast("int").alias("bytes")).withColumn("bytes", F.col("bytes").cast("long"))


@query("SELECT count(*) AS n_files, CAST(sum(octet_length(encode(html))) AS BIGINT) AS n_bytes FROM pages")
def bundle_totals(spark, sf_dir):
    path = shared.new_path(spark, "bundle")
    writers.write_files(table(spark, sf_dir, "pages").select(F.format_string("p%d.md", "page_id").alias("name"), F.col("html").alias("content")), path)
    return writers.bundle_manifest(spark, path)[1]


@query("SELECT true AS same, true AS changed, count(*) AS n_files FROM pages")
def file_fingerprints(spark, sf_dir):
    path = shared.new_path(spark, "stat")
    rows = table(spark, sf_dir, "pages").select(F.format_string("p%d.md", "page_id").alias("name"), F.col("html").alias("content"))
    writers.write_files(rows, path)
    first, again = readers.file_fingerprint(spark, path), readers.file_fingerprint(spark, path)
    n = writers.bundle_manifest(spark, path)[1].first().n_files
    writers.write_files(rows.limit(1).withColumn("name", F.lit("more.md")), path)
    return spark.createDataFrame([(first == again, first != readers.file_fingerprint(spark, path), n)], "same boolean, changed boolean, n_files long")


@query("SELECT vec_id, label, len(embedding) AS dims, round(CAST(CAST(list_inner_product(x, x) AS FLOAT) AS DOUBLE), 5) AS sq_norm FROM (SELECT *, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings)")
def vector_export_round_trip(spark, sf_dir):
    path = shared.new_path(spark, "vectors")
    rows = table(spark, sf_dir, "embeddings")
    without = rows.withColumn("embedding", F.lit(None).cast(rows.schema["embedding"].dataType))  # these are left out
    writers.write_vectors(rows.unionByName(without), path)
    return readers.read_vectors(spark, path).select("vec_id", "label", F.size("embedding").cast("long").alias("dims"), F.round(F.col("sq_norm").cast("double"), 5).alias("sq_norm"))


_TERM_SQL = f"""
WITH t AS ({' UNION ALL '.join(f"SELECT doc_id AS id, unnest({sql.index_tokens(f'CAST({f} AS VARCHAR)')}) AS term, CAST({w} AS DOUBLE) AS w FROM documents" for f, w in WEIGHTS.items())})
SELECT term, count(DISTINCT id) AS n_rows, sum(w) AS weight FROM t GROUP BY term"""


@query(_TERM_SQL)
def index_postings(spark, sf_dir):
    return documents_index(spark, sf_dir).postings.groupBy("term").agg(F.count("*").alias("n_rows"), F.sum("wtf").alias("weight"))


@query(f"""
WITH t AS ({' UNION ALL '.join(f"SELECT doc_id AS id, len({sql.index_tokens(f'CAST({f} AS VARCHAR)')}) AS n FROM documents" for f in WEIGHTS)}), d AS (SELECT id, sum(n) AS dl FROM t GROUP BY id)
SELECT count(*) AS n_rows, round(avg(dl), 6) AS avgdl FROM d""")
def index_totals(spark, sf_dir):
    return documents_index(spark, sf_dir).totals.select("n_rows", F.round("avgdl", 6).alias("avgdl"))


@query("SELECT 'a' AS key, '1' AS value UNION ALL SELECT 'b', '3' UNION ALL SELECT 'n', CAST(count(*) AS VARCHAR) FROM region")
def meta_upsert(spark, sf_dir):
    path = shared.new_path(spark, "meta")
    writers.write_meta(spark, path, {"a": "1", "b": "2"})
    writers.write_meta(spark, path, {"b": "3", "n": str(table(spark, sf_dir, "region").count())})
    return spark.createDataFrame(sorted(writers.read_meta(spark, path).items()), "key string, value string")


@query("SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def working_memory_append(spark, sf_dir):
    path, rows = shared.new_path(spark, "memory"), table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    for part in (0, 1):
        writers.append_turns(rows.filter(F.col("turn") % 2 == part), path, "conv_id", 4)
    got = spark.read.parquet(path).groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return got.select("conv_id", "n", F.array_join(F.transform("t", lambda x: x["role"]), ",").alias("roles"))


@query("SELECT r_name AS slug, 'Region ' || r_name AS title, 1 AS found FROM region UNION ALL SELECT 'none', 'missing', 0")
def wiki_index_scan(spark, sf_dir):
    path = shared.new_path(spark, "wiki")
    body = table(spark, sf_dir, "region").agg(F.to_json(F.collect_list(F.struct(F.col("r_name").alias("slug"), F.concat(F.lit("Region "), "r_name").alias("title")))).alias("content"))
    writers.write_files(body.withColumn("name", F.lit("index.json")), path)
    there = readers.read_or_empty(spark, f"{path}/index.json", "slug string, title string").withColumn("found", F.lit(1))
    none = readers.read_or_empty(spark, f"{path}/images.json", "slug string, title string")
    return there.unionByName(spark.createDataFrame([("none", "missing", none.count())], "slug string, title string, found int"))


# ---- parsers


@query("""
WITH s AS (SELECT s_suppkey, s_name, s_suppkey % 3 AS k FROM supplier)
SELECT s_suppkey, CAST(0 AS INT) AS pos, NULL AS case_ref, '' AS title, '' AS body, 'unparsed' AS status FROM s WHERE k = 0
UNION ALL SELECT s_suppkey, CASE WHEN k = 0 THEN 1 ELSE 0 END, 'NC-2024-001', 'Door ' || s_name, 'body' || chr(10) || 'NC-2024 none', 'parsed' FROM s
UNION ALL SELECT s_suppkey, CASE WHEN k = 0 THEN 2 ELSE 1 END, 'NC-2024-002', '', 'last', 'parsed' FROM s WHERE k < 2""")
def scenario_records(spark, sf_dir):
    k = F.col("s_suppkey") % 3
    text = F.concat(F.when(k == 0, "intro\n").otherwise(""), F.lit("NC-2024-001: Door "), "s_name", F.lit("\nbody\nNC-2024 none\n"), F.when(k < 2, "NC-2024-002\nlast\n").otherwise(""))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("value"))
    return readers.parse_scenarios(rows, keep=["s_suppkey"])


@query("""
SELECT page_id AS id, CASE page_id % 3 WHEN 2 THEN NULL ELSE '{"u":"' || replace(url, '/', '\\/') || '"}' END AS json, page_id % 3 <> 2 AS ok FROM pages""".replace("replace(url, '/', '\\/')", "url"))
def double_json(spark, sf_dir):
    once = F.to_json(F.struct(F.col("url").alias("u")))
    value = F.when(F.col("page_id") % 3 == 0, once).when(F.col("page_id") % 3 == 1, F.concat(F.lit('"'), F.replace(once, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise("{broken")
    return readers.parse_double_json(table(spark, sf_dir, "pages").select("page_id", value.alias("v")), "page_id", "v")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc, CASE quality WHEN 1 THEN 'nano_sufficient' ELSE 'deep_required' END AS label FROM labels WHERE doc_id % 5 <> 0")
def human_labels(spark, sf_dir):
    name = F.when(F.col("doc_id") % 5 == 0, "odd").when(F.col("quality") == 1, "nano_sufficient").otherwise("deep_required")
    rows = table(spark, sf_dir, "labels").select(F.floor(F.col("doc_id") / 50).alias("g"), F.col("doc_id").cast("string").alias("doc"), name.alias("label"))
    files = rows.groupBy("g").agg(F.collect_list(F.struct("doc", "label")).alias("l"))
    value = F.when(F.col("g") % 2 == 0, F.to_json("l")).otherwise(F.to_json(F.map_from_entries("l")))
    return readers.parse_labels(files.select(value.alias("v")), "v", ["nano_sufficient", "deep_required"])


@query("SELECT 'r' || doc_id AS custom_id, CASE WHEN doc_id % 2 = 0 THEN '{\"status_code\":200}' END AS response, CASE WHEN doc_id % 2 = 1 THEN 'bad' END AS error FROM documents")
def batch_result_scan(spark, sf_dir):
    path, even = shared.new_path(spark, "results"), F.col("doc_id") % 2 == 0
    rows = table(spark, sf_dir, "documents")
    line = F.concat(F.lit('{"custom_id": "r'), F.col("doc_id").cast("string"), F.lit('", '), F.when(even, '"response": {"status_code":200}').otherwise('"error": "bad"'), F.lit("}"))
    rows.select(line.alias("value")).write.text(path)
    return readers.read_batch_results(spark, path)


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE doc_id IN (3, 40, 77)")
def document_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.format_string("d%d.json", "doc_id").alias("name"), "doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    asked = spark.createDataFrame([("d3.json",), ("d40.json",), ("d77.json",), ("d77.json",), ("../d4.json",), ("",), ("none",)], "name string")
    return readers.point_lookup(rows, "name", asked).select("doc_id", "text_md5")


_CHUNK_SQL = """
WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents),
w AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS start, CAST(-1 AS BIGINT) AS pos, CAST('' AS VARCHAR) AS piece, length(t) AS n FROM t
  UNION ALL
  SELECT doc_id, CASE WHEN stop >= n THEN n ELSE greatest(stop - 120, start + 1) END, pos + 1, regexp_replace(t[start + 1:stop], '^\\s+|\\s+$', '', 'g'), n
  FROM (SELECT *, CASE WHEN size < n AND length(seg) > 0 AND start + length(seg) > greatest(start + 1500, size - 500) THEN start + length(seg) ELSE size END AS stop
        FROM (SELECT w.doc_id, w.start, w.pos, w.n, t.t, least(w.n, w.start + 3000) AS size, regexp_extract(t.t[w.start + 1:least(w.n, w.start + 3000) + 1], '(?s)^(.*)[\\n ]', 1) AS seg
              FROM w JOIN t USING (doc_id) WHERE w.start < w.n)))
SELECT doc_id AS id, CAST(pos AS INT) AS pos, CAST(length(piece) AS INT) AS n_chars, sha256(piece) AS sha256 FROM w WHERE pos >= 0 AND piece <> ''"""


@query(_CHUNK_SQL)
def chunk_documents(spark, sf_dir):
    return corpus.chunks(table(spark, sf_dir, "documents"), "doc_id", "text").select("id", "pos", F.length("chunk").alias("n_chars"), F.sha2(F.col("chunk").cast("binary"), 256).alias("sha256"))


@query("""
WITH c AS (SELECT lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
SELECT * FROM (VALUES (0, '# Counts'), (1, ''), (2, '| lang | quality | n |'), (3, '| - | - | - |')) AS v(pos, line)
UNION ALL SELECT CAST(3 + row_number() OVER (ORDER BY lang, quality, n) AS INT), '| ' || lang || ' | ' || quality || ' | ' || n || ' |' FROM c""")
def markdown_report(spark, sf_dir):
    n = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"))
    return evaluation.markdown_report("Counts", n, ["lang", "quality", "n"]).withColumn("pos", F.col("pos").cast("int"))


@query("SELECT doc_id AS doc FROM documents WHERE doc_id % 3 <> 0 OR lang = 'fr'")
def unfinished_work(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit("m").alias("model"), "lang")
    done = rows.filter("doc % 3 = 0 AND lang <> 'fr'")
    return routing.unfinished(rows, done.unionByName(done), ["doc", "model"]).select("doc")
