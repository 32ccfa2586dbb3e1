"""The reference operators as named queries over the test tables, each with the SQL it can be compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.functions import text as X
from corvina.operators import confidence, corpus, evaluation, fusion, joins, lexical, memory, ontology, rewrite, routing, vector
from corvina.plans import hybrid, sql
from corvina.plans.registry import ORACLE_SQL, QUERIES, WEIGHTS, dealt, dealt_sql, documents_index, query, table
from corvina.sources import segments, shared
from corvina.streaming import events as stream

#: The stated queries of the full-text searches.
ASKED = [(1, "und der"), (2, "les que ment"), (3, "thing hand"), (4, "zzzz und"), (5, "Ción ado"), (6, "aucun résultat zzzz"), (7, "heit"), (8, "the the of"), (9, "licensed apache version"), (10, "rights reserved"), (11, "mail 12")]
DOC_ROWS = "SELECT doc_id AS id, doc_id, source, text FROM documents"


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "query_id int, query string")


ASKED_SQL = sql.values(ASKED, "query_id, query")


# ---- tokens and full text


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {sql.tokens('text')} AS t FROM documents)")
def tokenize_documents(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", X.query_tokens(F.col("text"), distinct=False).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


@query(f"SELECT token, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest({sql.tokens('text')}) AS token FROM documents) GROUP BY token")
def token_frequency(spark, sf_dir):
    counts = lexical.token_frequency(table(spark, sf_dir, "documents"), "doc_id", "text")
    return counts.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def _bm25(spark, sf_dir, mode):
    return _found(documents_index(spark, sf_dir), asked(spark), mode)


def _found(index, queries, mode):
    found = lexical.search_index(index, queries, 10, mode)
    return found.select("query_id", "id", F.round("bm25", 6).alias("bm25"), "n_matched", "lexical_rank")


def _bm25_sql(mode):
    return f"WITH {sql.bm25(ASKED_SQL, DOC_ROWS, WEIGHTS, 10, mode)} SELECT query_id, id, round(bm25, 6) AS bm25, n_matched, CAST(lexical_rank AS INT) AS lexical_rank FROM bm25_found"


@query(_bm25_sql("and"))
def bm25_and(spark, sf_dir):
    return _bm25(spark, sf_dir, "and")


@query(_bm25_sql("or"))
def bm25_or(spark, sf_dir):
    return _bm25(spark, sf_dir, "or")


@query(_bm25_sql("fallback"))
def bm25_fallback(spark, sf_dir):
    return _bm25(spark, sf_dir, "fallback")


@query(_bm25_sql("fallback"))
def bm25_bounded(spark, sf_dir):
    """Searches that score only the blocks whose bound reaches the last place."""
    return _found(documents_index(spark, sf_dir, bounded=True), asked(spark), "fallback")


@query(_bm25_sql("fallback"))
def updated_index_search(spark, sf_dir):
    """An index of documents of which some have since changed, some gone and some come, brought up to date and searched."""
    docs, path = table(spark, sf_dir, "documents"), shared.new_path(spark, "updated")
    before = docs.filter("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 13 == 0, F.reverse("text")).otherwise(F.col("text")))
    lost = docs.filter("doc_id % 17 = 0").withColumn("doc_id", -F.col("doc_id") - 1)
    segments.write_index(before.unionByName(lost), path, "doc_id", WEIGHTS)
    segments.update_index(docs, path, "doc_id", WEIGHTS)
    return _found(segments.read_index(spark, path), asked(spark), "fallback")


@query(f"""
SELECT id, array_to_string(list_transform(t, lambda x: x || '*'), ' AND ') AS all_of, array_to_string(list_transform(t, lambda x: x || '*'), ' OR ') AS any_of
FROM (SELECT id, list_filter(t, lambda x, i: list_position(t, x) = i) AS t FROM (SELECT id, {sql.tokens("query || ' ' || source")} AS t FROM {dealt_sql('documents', 'doc_id', [a[1:] for a in ASKED], 'query')}))""")
def match_queries(spark, sf_dir):
    q = dealt(spark, sf_dir, "documents", "doc_id", [a[1:] for a in ASKED], "query string").withColumn("t", X.query_tokens(F.concat_ws(" ", "query", "source")))
    return q.select("id", X.match_query(F.col("t")).alias("all_of"), X.match_query(F.col("t"), "OR").alias("any_of"))


@query(f"""
WITH q AS (SELECT query_id, unnest({sql.tokens('query')}) AS token FROM {ASKED_SQL}), a AS (SELECT query_id, token, count(*) AS times FROM q GROUP BY ALL),
c AS (SELECT doc_id AS id, token, count(*) AS tf FROM (SELECT doc_id, unnest({sql.tokens('text')}) AS token FROM documents) GROUP BY ALL),
p AS (SELECT query_id, id, times * 2 * tf AS points FROM a JOIN c USING (token)
      UNION ALL SELECT query_id, doc_id, times * 5 FROM a JOIN documents ON contains(lower(source), token)),
s AS (SELECT query_id, id, CAST(sum(points) AS BIGINT) AS score FROM p GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10""")
def baseline_keyword_score(spark, sf_dir):
    return lexical.keyword_scores(table(spark, sf_dir, "documents"), asked(spark), "doc_id", "source", "text")


# ---- vectors and fusion

VECTOR_ROWS = "SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings"


QUERY_ROWS = "SELECT vec_id AS query_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings WHERE vec_id % 20 = 0"


def _knn_sql(limit: int) -> str:
    return f"WITH {sql.knn(QUERY_ROWS, VECTOR_ROWS, limit)} SELECT query_id, id, round(distance, 6) + 0.0 AS distance, CAST(vector_rank AS INT) AS vector_rank FROM knn_found"


def _knn(spark, sf_dir, limit):
    """Every row whose id is divisible by 20 asks."""
    v = table(spark, sf_dir, "embeddings")
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vector.knn(v, q, limit=limit).withColumn("distance", F.round("distance", 6) + 0.0)


@query(_knn_sql(10))
def knn_l2(spark, sf_dir):
    return _knn(spark, sf_dir, 10)


@query(_knn_sql(5))
def knn_l2_multi_query(spark, sf_dir):
    return _knn(spark, sf_dir, 5)


@query("SELECT vec_id, round(CAST(CAST(list_inner_product(x, x) AS FLOAT) AS DOUBLE), 5) AS sq_norm, len(x) AS dims FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings)")
def vector_norms(spark, sf_dir):
    v = vector.with_norm(table(spark, sf_dir, "embeddings"))
    return v.select("vec_id", F.round(F.col("sq_norm").cast("double"), 5).alias("sq_norm"), F.size("embedding").cast("long").alias("dims"))


#: Variants of one query, as batches of the first level of fusion.
BATCHES = [(1, 0, "und der"), (1, 1, "und die"), (1, 2, "keit und"), (2, 0, "les des"), (2, 1, "que les"), (3, 0, "thing hand")]
BATCHES_SQL = sql.values(BATCHES, "query_id, batch, query")
#: One number stands for a query and its variant in the SQL.
KEYED_SQL = f"SELECT query_id * 10 + batch AS query_id, query FROM {BATCHES_SQL}"


def _batches(spark, sf_dir):
    b = spark.createDataFrame(BATCHES, "query_id int, batch int, query string")
    found = lexical.search_index(documents_index(spark, sf_dir), b.select(F.struct("query_id", "batch").alias("query_id"), "query"), 15)
    return found.select("query_id.query_id", "query_id.batch", F.col("lexical_rank").alias("rank"), F.col("id").alias("identity"))


FOUND_SQL = "SELECT query_id // 10 AS query_id, query_id % 10 AS batch, lexical_rank AS rank, id AS identity FROM bm25_found"


@query(f"WITH {sql.bm25(KEYED_SQL, DOC_ROWS, WEIGHTS, 15)}, {sql.fuse_batches('fused', FOUND_SQL, 15)} SELECT CAST(query_id AS INT) AS query_id, identity, round(rrf, 8) AS rrf, CAST(best_rank AS INT) AS best_rank, variant_hits, CAST(rank AS INT) AS rank FROM fused")
def rrf_batches(spark, sf_dir):
    return fusion.fuse_batches(_batches(spark, sf_dir), 15).withColumn("rrf", F.round("rrf", 8))


HYBRID = [(1, "und der keit", "tech_docs"), (2, "les que ment", "tech_docs"), (3, "thing hand", "non_conformities"), (4, "fuel thing", "tech_docs")]
_HYBRID_SQL = f"""
WITH hq AS {sql.values([(1, 0, 'und der keit'), (2, 0, 'les que ment'), (3, 0, 'thing hand'), (4, 0, 'fuel thing'), (4, 1, rewrite.FUEL_DOCS)], 'query_id, batch, query')},
{sql.bm25('SELECT query_id * 10 + batch AS query_id, query FROM hq', DOC_ROWS, WEIGHTS, 15)}, {sql.fuse_batches('lex', FOUND_SQL, 15)},
{sql.knn("SELECT CAST(vec_id AS INT) AS query_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings WHERE vec_id BETWEEN 1 AND 4", VECTOR_ROWS, 15)},
{sql.fuse_batches('vec', 'SELECT query_id, 0 AS batch, vector_rank AS rank, id AS identity FROM knn_found', 15)},
both_ AS (SELECT query_id, 'lexical' AS channel, rank, identity FROM lex UNION ALL SELECT query_id, 'vector', rank, identity FROM vec),
summed AS (SELECT query_id, identity, sum(1.0 / (60 + rank)) AS raw, min(rank) AS best_rank, array_to_string(list_sort(list(DISTINCT channel)), ',') AS channels FROM both_ GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 12) DESC, best_rank, identity) AS retrieval_rank FROM summed),
hybrid AS (SELECT r.query_id, r.identity, round(raw, 8) AS rrf_score, best_rank, channels, retrieval_rank, k.distance AS vector_distance
           FROM ranked r LEFT JOIN knn_found k ON k.query_id = r.query_id AND k.id = r.identity WHERE retrieval_rank <= 10)"""


def _hybrid(spark, sf_dir):
    q = spark.createDataFrame(HYBRID, "query_id int, query string, corpus string")
    v = table(spark, sf_dir, "embeddings")
    named = v.filter(F.col("vec_id").between(1, 4)).select(F.col("vec_id").cast("int").alias("query_id"), F.lit(0).alias("batch"), F.col("embedding").alias("query_vector"))
    return q, hybrid.search(q, documents_index(spark, sf_dir), vectors=v.select(F.col("vec_id").alias("id"), "embedding"), query_vectors=named)


@query(_HYBRID_SQL + " SELECT CAST(query_id AS INT) AS query_id, identity, rrf_score, CAST(best_rank AS INT) AS best_rank, channels, CAST(retrieval_rank AS INT) AS retrieval_rank, round(vector_distance, 6) + 0.0 AS vector_distance FROM hybrid")
def rrf_hybrid(spark, sf_dir):
    _, found = _hybrid(spark, sf_dir)
    return found.select("query_id", "identity", "rrf_score", "best_rank", F.array_join("retrieval_channels", ",").alias("channels"), "retrieval_rank", (F.round("vector_distance", 6) + 0.0).alias("vector_distance"))


@query(_HYBRID_SQL + f""",
s AS (SELECT query_id, retrieval_rank, (CASE WHEN channels LIKE '%lexical%' THEN 2 ELSE 0 END + CASE WHEN channels LIKE '%vector%' AND vector_distance <= 1.0 THEN 1 ELSE 0 END
        + CASE WHEN rrf_score >= 0.03 THEN 1 ELSE 0 END) AS signal FROM hybrid WHERE retrieval_rank <= 3),
g AS (SELECT query_id, list(signal ORDER BY retrieval_rank) AS sig FROM s GROUP BY query_id)
SELECT CAST(query_id AS INT) AS query_id, array_to_string(sig, ',') AS signals,
  CASE WHEN list_max(sig) <= 1 THEN 'low' WHEN list_max(sig) >= 3 AND len(list_filter(sig, lambda x: x >= 2)) >= 2 THEN 'high' ELSE 'medium' END AS level,
  CASE WHEN list_max(sig) <= 1 THEN '{confidence.WEAK}' WHEN list_max(sig) >= 3 AND len(list_filter(sig, lambda x: x >= 2)) >= 2 THEN '{confidence.CROSS}' ELSE '{confidence.PARTIAL}' END AS reason
FROM g""")
def confidence_levels(spark, sf_dir):
    q, found = _hybrid(spark, sf_dir)
    return hybrid.with_confidence(q, ("tech_docs", found)).withColumn("signals", F.array_join(F.transform("signals", lambda x: x.cast("string")), ","))


@query(f"WITH {sql.bm25(ASKED_SQL, DOC_ROWS, WEIGHTS, 10)}, h AS (SELECT query_id AS case_id, max(CASE WHEN lexical_rank <= 5 AND quality = 1 THEN 1 ELSE 0 END) AS hit_5, max(CASE WHEN lexical_rank <= 10 AND quality = 1 THEN 1 ELSE 0 END) AS hit_10 FROM bm25_found LEFT JOIN labels ON doc_id = id GROUP BY query_id), u AS (SELECT 5 AS k, hit_5 AS hit FROM h UNION ALL SELECT 10, hit_10 FROM h) SELECT k, CAST(sum(hit) AS BIGINT) AS hits, count(*) AS total, round(avg(hit), 3) AS ratio FROM u GROUP BY k")
def hit_at_k(spark, sf_dir):
    found = lexical.search_index(documents_index(spark, sf_dir), asked(spark), 10)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    ranked = found.join(labels, "id", "left").select(F.col("query_id").alias("case_id"), F.col("lexical_rank").alias("rank"), "quality")
    return evaluation.summary(evaluation.hits(ranked, (5, 10), F.coalesce(F.col("quality") == 1, F.lit(False))), (5, 10))


@query("SELECT page_id, lower(regexp_replace(regexp_replace(string_split(url, ' ')[1], '^.*/', ''), '(.)\\.[^.]*$', '\\1')) AS identity FROM pages")
def result_identity(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.result_identity(F.col("url"), F.lit(None).cast("string")).alias("identity"))


@query("""
SELECT l_orderkey % 4 AS query_id, l_partkey AS identity, arg_min(nullif(l_returnflag, ''), (l_linenumber, l_orderkey, l_suppkey, l_extendedprice)) FILTER (WHERE l_returnflag <> '') AS returnflag,
  arg_min(l_shipdate, (l_linenumber, l_orderkey, l_suppkey, l_extendedprice)) AS shipdate, arg_min(l_linestatus || l_quantity, (-length(l_linestatus || l_quantity), l_linenumber, l_orderkey, l_suppkey, l_extendedprice)) AS content
FROM lineitem GROUP BY ALL""".replace("l_linestatus || l_quantity", "(l_linestatus || CAST(CAST(l_quantity AS INT) AS VARCHAR))"))
def merged_payload(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 4).alias("query_id"), F.col("l_partkey").alias("identity"), "l_linenumber", "l_orderkey", "l_suppkey", "l_extendedprice", F.col("l_returnflag").alias("returnflag"), F.col("l_shipdate").alias("shipdate"), F.concat("l_linestatus", F.col("l_quantity").cast("int").cast("string")).alias("content"))
    return fusion.merged_payload(rows, ["returnflag", "shipdate"], ["l_linenumber", "l_orderkey", "l_suppkey", "l_extendedprice"], "content")


@query("""
WITH a AS (SELECT source AS identity, doc_id AS pos, 0 AS source_order FROM documents WHERE lang = 'fr'), b AS (SELECT source, doc_id, 1 FROM documents WHERE lang <> 'fr'),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT identity, pos, source_order FROM u QUALIFY row_number() OVER (PARTITION BY identity ORDER BY source_order, pos) = 1""")
def union_distinct_ordered(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("identity"), F.col("doc_id").alias("pos"), "lang")
    return fusion.union_distinct(d.filter("lang = 'fr'").drop("lang"), d.filter("lang <> 'fr'").drop("lang"), "identity", "pos")


# ---- query expansion and entity search

REWRITES = [
    (1, "  fuel   tank leak left ", "tech_docs"), (2, "fuel pump sensor", "non_conformities"), (3, "ESD grounding fuel probe droite gauche", "non_conformities"), (4, "windshield frame scratch door", "tech_docs"),
    (5, "surface damage structural repair airframe scratch zone", "tech_docs"), (6, "right left", "tech_docs"), (7, "Rien à signaler", "tech_docs"), (8, "electrical tank right", "tech_docs"), (9, "composite", "non_conformities"),
]


def _rewrite_sql() -> str:
    has = lambda words: f"list_has_any(t, {words!r})"
    fuel, electrical = has(rewrite.FUEL), has(rewrite.ELECTRICAL)
    left, right = has(rewrite.LEFT), has(rewrite.RIGHT)
    sides = f"concat_ws(' ', CASE WHEN {left} THEN '{rewrite.LEFT_TEXT}' END, CASE WHEN {right} THEN '{rewrite.RIGHT_TEXT}' END)"
    events = f"corpus = '{rewrite.EVENTS}'"
    tried = [
        (sql.compact("query"), "true"),
        (f"CASE WHEN {events} THEN '{rewrite.FUEL_EVENTS}' ELSE '{rewrite.FUEL_DOCS}' END", fuel),
        (f"'{rewrite.ELECTRICAL_TEXT}'", electrical),
        (f"concat_ws(' ', '{rewrite.BOTH}', nullif({sides}, ''), CASE WHEN {events} THEN '{rewrite.BOTH_EVENTS}' ELSE '{rewrite.BOTH_DOCS}' END)", f"{fuel} AND {electrical}"),
        (f"'{rewrite.STRUCTURAL_TEXT}'", has(rewrite.STRUCTURAL)),
        (f"'{rewrite.DAMAGE_TEXT}'", has(rewrite.DAMAGE)),
        (f"'{rewrite.DOOR_TEXT}'", has(rewrite.DOOR)),
        (sides, f"({left} OR {right}) AND NOT ({fuel} AND {electrical})"),
    ]
    rows = " UNION ALL ".join(f"SELECT query_id, corpus, {i} AS o, {v} AS variant FROM q WHERE {c}" for i, (v, c) in enumerate(tried))
    key = "(SELECT string_agg(x, ' ' ORDER BY p) FROM (SELECT x, min(p) AS p FROM (SELECT unnest(tk) AS x, generate_subscripts(tk, 1) AS p) GROUP BY x))"
    return f"""
WITH q AS (SELECT *, {sql.tokens('query')} AS t FROM (SELECT id AS query_id, query || ' ' || source AS query, corpus FROM {dealt_sql('documents', 'doc_id', [r[1:] for r in REWRITES], 'query, corpus')})), v AS ({rows}),
w AS (SELECT *, {sql.tokens('variant')} AS tk FROM v), k AS (SELECT *, {key} AS key FROM w),
d AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY o) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o) - 1 AS batch FROM d)
SELECT query_id, corpus, CAST(batch AS INT) AS batch, variant FROM n WHERE batch < 4"""


@query(_rewrite_sql())
def query_rewrite_variants(spark, sf_dir):
    rows = dealt(spark, sf_dir, "documents", "doc_id", [r[1:] for r in REWRITES], "query string, corpus string")
    return rewrite.expand(rows.select(F.col("id").alias("query_id"), F.concat_ws(" ", "query", "source").alias("query"), "corpus"))


ENTITIES = [(1, "brass part"), (2, "Small copper brand"), (3, "standard steel 7"), (4, "unknownword"), (5, "promo tin 12")]


@query(f"""
WITH q AS (SELECT query_id, unnest(list_distinct({sql.tokens('query')})) AS token FROM {sql.values(ENTITIES, 'query_id, query')}),
e AS (SELECT p_partkey AS id, p_name, {sql.tokens('p_name')} AS title, {sql.tokens("p_brand || ' ' || p_type")} AS meta FROM part),
s AS (SELECT query_id, id, p_name, CAST(sum(CASE WHEN list_contains(title, token) THEN 3 WHEN list_contains(meta, token) THEN 1 ELSE 0 END) AS BIGINT) AS score FROM q, e GROUP BY ALL)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p_name COLLATE en, p_name, id) AS INT) AS wiki_rank FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p_name COLLATE en, p_name, id) <= 10""")
def wiki_entity_search(spark, sf_dir):
    q = spark.createDataFrame(ENTITIES, "query_id int, query string")
    found = ontology.entity_search(table(spark, sf_dir, "part"), q, F.col("p_name"), F.concat_ws(" ", "p_brand", "p_type"), "p_partkey", "p_name")
    return found.select("query_id", "id", "score", "wiki_rank")


@query("""
WITH g AS (SELECT s_suppkey AS neighbour, s_nationkey AS v, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name, s_suppkey) AS o FROM supplier),
p AS (SELECT s_suppkey AS entity, neighbour, o FROM supplier JOIN g ON v = s_nationkey WHERE s_suppkey <> neighbour)
SELECT 's_nationkey' AS class, entity, neighbour, CAST(row_number() OVER (PARTITION BY entity ORDER BY o) AS INT) AS n FROM p QUALIFY row_number() OVER (PARTITION BY entity ORDER BY o) <= 10""")
def entity_neighbours(spark, sf_dir):
    return ontology.neighbours(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_suppkey", "s_name")


# ---- corpus preparation

_CANON_SQL = """
WITH r AS (SELECT doc_id AS row_idx, source AS doc, md5(text) AS chunk_id, trim(text) = '' AS bad, doc_id IN (SELECT doc_id FROM labels) AS here FROM documents),
a AS (SELECT *, CASE WHEN bad THEN 'malformed' WHEN NOT here THEN 'missing_page' END AS r1 FROM r),
b AS (SELECT *, CASE WHEN r1 IS NULL AND row_number() OVER (PARTITION BY chunk_id, r1 IS NULL ORDER BY row_idx) > 1 THEN 'duplicate_chunk' ELSE r1 END AS r2 FROM a),
k AS (SELECT DISTINCT doc FROM b WHERE r2 IS NULL),
c AS (SELECT row_idx, b.doc, chunk_id, coalesce(r2, CASE WHEN k.doc IS NOT NULL THEN 'alias' END) AS drop_reason FROM b LEFT JOIN k ON b.doc LIKE 'src1_' AND k.doc = 'src' || right(b.doc, 1))"""


def _canonical(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.select(F.col("doc_id").alias("row_idx"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("page"), F.col("source").alias("doc"), F.md5(F.col("text").cast("binary")).alias("chunk_id"), (F.trim("text") == "").alias("bad"))
    seen = rows.join(labels.select(F.col("doc_id").alias("row_idx")), "row_idx", "left_semi").select(F.col("page").alias("doc"))
    alias = F.when(F.col("doc").rlike("^src1[0-9]$"), F.concat(F.lit("src"), F.substring("doc", -1, 1)))
    return corpus.drop_reasons(rows, seen, alias, F.col("bad"), page="page").select("row_idx", "doc", "chunk_id", "drop_reason")


@query(_CANON_SQL + " SELECT row_idx, doc, chunk_id FROM c WHERE drop_reason IS NULL")
def canonical_dedupe(spark, sf_dir):
    return _canonical(spark, sf_dir).filter("drop_reason IS NULL").select("row_idx", "doc", "chunk_id")


@query(_CANON_SQL + " SELECT coalesce(drop_reason, 'kept') AS outcome, count(*) AS n_rows FROM c GROUP BY ALL")
def canonical_audit(spark, sf_dir):
    return corpus.audit(_canonical(spark, sf_dir))


@query("SELECT source AS doc_root, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source")
def missing_page_counts(spark, sf_dir):
    return joins.counts_without_page(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", F.col("source"))


@query("""
WITH l AS (SELECT doc_id AS o, sha256(CAST(doc_id AS VARCHAR) || chr(10) || text) AS h FROM documents),
r AS (SELECT o // 1000 AS run, sha256(string_agg(h, '' ORDER BY o)) AS h, count(*) AS n FROM l GROUP BY ALL)
SELECT sha256(string_agg(h, '' ORDER BY run)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n_rows FROM r""")
def content_fingerprint(spark, sf_dir):
    return corpus.fingerprint(table(spark, sf_dir, "documents"), ["doc_id", "text"], "doc_id")


@query("""
SELECT conv_id, sha256(to_json(list(trim(regexp_replace(text, '\\s+', ' ', 'g')) ORDER BY turn))) AS content_sha256, count(*) AS n_chunks FROM conversations GROUP BY conv_id""")
def conversation_hashes(spark, sf_dir):
    return corpus.content_hashes(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


def _policy_features():
    category = F.when(F.length("text") < 60, "blank_page").when(F.col("text").rlike("(?i)license"), "front_matter").when(F.col("lang") == "fr", "technical_table").when(F.col("lang") == "es", "unreadable").otherwise("technical_procedure")
    sure = F.round((F.length("text") % 100) / 100.0, 2)
    action = F.when(F.col("doc_id") % 5 == 0, "downweight").when(F.col("doc_id") % 7 == 0, "exclude").otherwise("index")
    return category, sure, F.lit(False), action, F.round((F.length("text") % 10) / 10.0, 1)


@query("""
WITH f AS (SELECT doc_id, CASE WHEN length(text) < 60 THEN 'blank_page' WHEN regexp_matches(text, '(?i)license') THEN 'front_matter' WHEN lang = 'fr' THEN 'technical_table' WHEN lang = 'es' THEN 'unreadable' ELSE 'technical_procedure' END AS c,
  round((length(text) % 100) / 100.0, 2) AS p, CASE WHEN doc_id % 5 = 0 THEN 'downweight' WHEN doc_id % 7 = 0 THEN 'exclude' ELSE 'index' END AS a, round((length(text) % 10) / 10.0, 1) AS w FROM documents),
g AS (SELECT *, c IN ('blank_page', 'front_matter') AS e FROM f)
SELECT doc_id, CASE WHEN c = 'unreadable' THEN 'exclude' WHEN e AND p >= 0.75 THEN 'exclude' WHEN e THEN 'downweight' WHEN a = 'exclude' THEN 'exclude' WHEN a = 'downweight' OR p < 0.55 THEN 'downweight' ELSE 'index' END AS action,
  CAST(CASE WHEN c = 'unreadable' THEN 0 WHEN e AND p >= 0.75 THEN 0 WHEN e AND p >= 0.55 THEN 0.15 WHEN e THEN 0.4 WHEN a = 'exclude' THEN 0 WHEN a = 'downweight' THEN least(0.6, greatest(0.05, coalesce(nullif(w, 0), 0.4))) WHEN p < 0.55 THEN 0.5 ELSE 1 END AS DOUBLE) AS weight,
  CASE WHEN c = 'unreadable' THEN 'unreadable-page' WHEN e AND p >= 0.75 THEN 'high-confidence-non-content' WHEN e AND p >= 0.55 THEN 'medium-confidence-non-content' WHEN e THEN 'low-confidence-non-content' WHEN a = 'exclude' THEN 'caption-requested-exclusion' WHEN a = 'downweight' THEN 'caption-requested-downweight' WHEN p < 0.55 THEN 'low-confidence-technical-classification' ELSE 'technical-content' END AS reason FROM g""")
def page_policy(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", corpus.page_policy(*_policy_features()).alias("p")).select("doc_id", "p.action", "p.weight", "p.reason")


@query(f"""
WITH d AS (SELECT doc_id, doc_id % 4 AS page, {sql.compact('text')} AS t FROM documents)
SELECT doc_id, CASE WHEN t = '' THEN 'blank_page' WHEN page BETWEEN 1 AND 2 AND length(t) < 1200 AND regexp_matches(t, '(?i)\\b({corpus.COVER_WORDS})\\b') THEN 'front_matter' ELSE 'technical_procedure' END AS category,
  CAST(CASE WHEN t = '' THEN 0.9 WHEN page BETWEEN 1 AND 2 AND length(t) < 1200 AND regexp_matches(t, '(?i)\\b({corpus.COVER_WORDS})\\b') THEN 0.7 ELSE 0.6 END AS DOUBLE) AS confidence FROM d""")
def default_page_analysis(spark, sf_dir):
    page = X.page_number(F.concat(F.lit("m_page_"), (F.col("doc_id") % 4).cast("string"), F.lit(".pdf")))
    return table(spark, sf_dir, "documents").select("doc_id", corpus.default_analysis(F.col("text"), page).alias("a")).select("doc_id", "a.category", "a.confidence")


#: A made-up page text of every part, to run the extractors on.
PAGE = "# RH {0} door frame {1}/{2}\nATA {3} near Station {1}, aft and Left-hand. A220-{3}-{2} and {4}; see ata-{5}"


def _part_pages(spark, sf_dir):
    p = shared.spread(table(spark, sf_dir, "part"))
    size = F.col("p_size").cast("string")
    two = F.lpad((F.col("p_size") % 100).cast("string"), 2, "0")
    content = X.template("# RH {{name}} door frame {{size}}/{{key}}\nATA {{two}} near Station {{size}}, aft and Left-hand. A220-{{two}}-{{key}} and {{brand}}; see ata-{{other}}", {"name": F.col("p_name"), "size": size, "key": F.col("p_partkey"), "two": two, "brand": F.upper("p_brand"), "other": F.lpad((F.col("p_partkey") % 60).cast("string"), 2, "0")})
    return p.select(F.col("p_partkey").alias("row_idx"), F.concat("p_brand", F.lit(".pdf")).alias("doc"), F.concat(F.lit("EV-"), F.lpad(size, 3, "0"), F.lit("-x")).alias("chunk_id"), content.alias("content"), F.lit("").alias("ata"), F.concat("p_type", F.lit(" panel; 1. Scope; "), "p_brand", F.lit("  valve<br/>seal|x")).alias("parts"))


_PAGES_SQL = """
WITH pages_ AS (SELECT p_partkey AS row_idx, p_brand || '.pdf' AS doc, 'EV-' || lpad(CAST(p_size AS VARCHAR), 3, '0') || '-x' AS chunk_id,
  '# RH ' || p_name || ' door frame ' || p_size || '/' || p_partkey || chr(10) || 'ATA ' || lpad(CAST(p_size % 100 AS VARCHAR), 2, '0') || ' near Station ' || p_size || ', aft and Left-hand. A220-' || lpad(CAST(p_size % 100 AS VARCHAR), 2, '0') || '-' || p_partkey || ' and ' || upper(p_brand) || '; see ata-' || lpad(CAST(p_partkey % 60 AS VARCHAR), 2, '0') AS content,
  p_type, p_brand FROM part)"""


@query(_PAGES_SQL + """,
z AS (SELECT row_idx, doc, chunk_id, content,
  list_sort(list_distinct(list_transform(regexp_extract_all(content, '(?i)\\bATA[\\s-]?(\\d{2})\\b', 1), lambda c: 'ATA-' || c))) AS ata,
  list_sort(list_distinct(list_concat(['RH', 'left-hand', 'left', 'aft'], list_transform(regexp_extract_all(content, '(?i)\\b(frame\\s+\\d+(?:/\\d+)?|station\\s+\\d+)\\b', 1), lambda x: lower(x))))) AS zone,
  list_sort(list_distinct(regexp_extract_all(content, '\\b[A-Z0-9]+(?:-[A-Z0-9]+){2,}\\b'))) AS num FROM pages_)
SELECT row_idx, array_to_string(ata, ',') AS ata_codes, array_to_string(zone, ',') AS zones, array_to_string(num, ',') AS part_numbers, substr(chunk_id, 4, 3) AS task_kind FROM z""")
def extract_codes(spark, sf_dir):
    p = _part_pages(spark, sf_dir)
    return p.select("row_idx", F.array_join(X.ata_codes(F.col("content")), ",").alias("ata_codes"), F.array_join(X.zones(F.col("content")), ",").alias("zones"), F.array_join(X.part_numbers(F.col("content")), ",").alias("part_numbers"), X.task_kind(F.col("doc"), F.col("chunk_id"), F.col("content")).alias("task_kind"))


@query("""
WITH s AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || repeat(p_type || '.', 4)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS b FROM part)
SELECT p_partkey, CASE WHEN length(b) <= 96 THEN b ELSE regexp_replace(left(b, 85), '-+$', '') || '-' || left(sha1(b), 10) END AS slug FROM s""")
def slugify_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.slugify(F.concat("p_name", F.lit(" / "), F.repeat(F.concat("p_type", F.lit(".")), 4))).alias("slug"))


_CANDIDATES_SQL = _PAGES_SQL + """,
c0 AS (SELECT row_idx, doc, chunk_id, content, unnest([trim(regexp_replace(p_type || ' panel', '\\s+', ' ', 'g')), p_brand || ' valve seal']) AS raw FROM pages_),
c AS (SELECT *, regexp_replace(regexp_replace(lower(raw), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM c0)"""


@query(_CANDIDATES_SQL + """,
n AS (SELECT slug, unnest(regexp_extract_all(content, '\\b[A-Z0-9]+(?:-[A-Z0-9]+){2,}\\b')) AS x FROM c), a AS (SELECT slug, unnest(regexp_extract_all(content, '(?i)\\bATA[\\s-]?(\\d{2})\\b', 1)) AS x FROM c),
nn AS (SELECT slug, count(DISTINCT x) AS n_numbers, md5(string_agg(DISTINCT x, ',' ORDER BY x)) AS numbers_md5 FROM n GROUP BY slug), aa AS (SELECT slug, count(DISTINCT x) AS n_codes FROM a GROUP BY slug),
g AS (SELECT slug, arg_min(raw, row_idx) AS seed, count(DISTINCT doc) AS n_docs, count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT raw) AS n_aliases FROM c GROUP BY slug),
s AS (SELECT slug, md5(string_agg(substr(content, 1, 280), '|' ORDER BY row_idx)) AS snippets_md5 FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY slug ORDER BY row_idx) <= 3) GROUP BY slug)
SELECT slug, seed, n_docs, n_chunks, n_aliases, n_numbers, numbers_md5, n_codes, snippets_md5 FROM g JOIN nn USING (slug) JOIN aa USING (slug) JOIN s USING (slug)""")
def part_aggregate(spark, sf_dir):
    p = ontology.parts(ontology.candidates(_part_pages(spark, sf_dir)))
    n = lambda c: F.size(c).cast("long")
    md5 = lambda c, s: F.md5(F.array_join(c, s).cast("binary"))
    return p.select("slug", "seed", n("supporting_docs").alias("n_docs"), n("supporting_chunks").alias("n_chunks"), n("aliases").alias("n_aliases"), n("part_numbers").alias("n_numbers"), md5("part_numbers", ",").alias("numbers_md5"), n("ata_codes").alias("n_codes"), md5("snippets", "|").alias("snippets_md5"))


@query(_CANDIDATES_SQL + """,
b AS (SELECT DISTINCT slug, 'ata:ATA-' || unnest(regexp_extract_all(content, '(?i)\\bATA[\\s-]?(\\d{2})\\b', 1)) AS t FROM c),
z AS (SELECT DISTINCT slug, 'zone:' || unnest(list_concat(['RH', 'left-hand', 'left', 'aft'], list_transform(regexp_extract_all(content, '(?i)\\b(frame\\s+\\d+(?:/\\d+)?|station\\s+\\d+)\\b', 1), lambda x: lower(x)))) AS t FROM c)
SELECT 'part:' || slug AS "from", 'belongs_to' AS relation, t AS "to" FROM b UNION ALL SELECT 'part:' || slug, 'located_in', t FROM z""")
def part_relations(spark, sf_dir):
    return ontology.edges(ontology.candidates(_part_pages(spark, sf_dir)))


@query("""
WITH x AS (SELECT l_partkey AS part, l_orderkey AS doc, count(*) AS n_shared FROM lineitem GROUP BY ALL)
SELECT part, doc, n_shared, CAST(row_number() OVER (PARTITION BY part ORDER BY doc) AS INT) AS n FROM x QUALIFY row_number() OVER (PARTITION BY part ORDER BY doc) <= 10""")
def shared_number_join(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_partkey").alias("number"))
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0")).alias("doc"), F.col("l_partkey").alias("number"), "l_orderkey")
    found = ontology.shared(parts, lines, "part", "doc", "number", "l_orderkey", 10)
    return found.select("part", F.substring("doc", 2, 12).cast("long").alias("doc"), "n_shared", "n")


_IMAGE_SQL = """
WITH i AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, 'doc' || s_nationkey AS doc, 'View of ' || lower(n_name) || ' parts' AS caption, CASE WHEN s_suppkey % 3 = 0 THEN 'plain text' ELSE s_name || ' ' || n_name END AS description,
  CASE WHEN s_suppkey % 2 = 0 THEN [n_name, 'zone'] ELSE [] END AS cand, CASE WHEN s_suppkey % 5 = 0 THEN [substr(n_name, 1, 4)] ELSE [] END AS ident, s_suppkey % 4 = 0 AS fig, s_suppkey % 7 = 0 AS flow FROM supplier JOIN nation ON n_nationkey = s_nationkey),
p AS (SELECT 'n' || n_nationkey AS slug, lower(n_name) AS a, 'n' || n_nationkey AS b, 'doc' || n_nationkey AS sup FROM nation),
x AS (SELECT *, len(list_filter(cand, lambda v: contains(lower(v), a) OR contains(a, lower(v)) OR (length(b) >= 3 AND (contains(lower(v), b) OR contains(b, lower(v)))))) > 0 AS c1,
  len(list_filter(ident, lambda v: contains(lower(v), a) OR contains(a, lower(v)) OR (length(b) >= 3 AND (contains(lower(v), b) OR contains(b, lower(v)))))) > 0 AS c2,
  contains(lower(description), a) OR contains(caption, a) OR (length(b) >= 3 AND (contains(lower(description), b) OR contains(caption, b))) AS c3, sup = doc AS c4 FROM i, p),
y AS (SELECT *, CASE WHEN c1 THEN 5 ELSE 0 END + CASE WHEN c2 THEN 4 ELSE 0 END + CASE WHEN c3 THEN 3 ELSE 0 END + CASE WHEN c4 THEN 1 ELSE 0 END + CASE WHEN fig THEN 1 ELSE 0 END + CASE WHEN flow THEN 1 ELSE 0 END AS score FROM x WHERE c1 OR c2 OR c3),
r AS (SELECT 'part:' || slug AS "from", 'image:' || id AS "to", doc, CAST(score AS INT) AS score, concat_ws(',', CASE WHEN c1 THEN 'caption_candidate' END, CASE WHEN c3 THEN 'description_alias' END, CASE WHEN fig THEN 'figure_or_table_ref' END,
  CASE WHEN flow THEN 'relationship_or_flow' END, CASE WHEN c4 THEN 'supporting_doc' END, CASE WHEN c2 THEN 'visible_identifier' END) AS reasons FROM y WHERE score >= 3)"""


def _images(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    some = lambda every, a: F.when(F.col("s_suppkey") % every == 0, a).otherwise(F.array().cast("array<string>"))
    images = s.select(
        F.col("s_suppkey").cast("string").alias("id"), F.concat(F.lit("doc"), F.col("s_nationkey").cast("string")).alias("doc"), F.concat(F.lit("View of "), F.lower("n_name"), F.lit(" parts")).alias("caption"),
        F.when(F.col("s_suppkey") % 3 == 0, "plain text").otherwise(F.concat_ws(" ", "s_name", "n_name")).alias("technical_description"), some(2, F.array("n_name", F.lit("zone"))).alias("part_or_zone_candidates"),
        some(5, F.array(F.substring("n_name", 1, 4))).alias("visible_identifiers"), some(4, F.array(F.lit("Fig"))).alias("figure_or_table_refs"), some(7, F.array(F.lit("flow"))).alias("relationships_or_flows"),
    )
    key = F.col("n_nationkey").cast("string")
    parts = nation.select(F.concat(F.lit("n"), key).alias("slug"), F.col("n_name").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"), F.array(F.concat(F.lit("doc"), key)).alias("supporting_docs"))
    return images, ontology.image_relations(images, parts)


@query(_IMAGE_SQL + ' SELECT "from", "to", doc, score, reasons FROM r')
def image_relations(spark, sf_dir):
    _, edges = _images(spark, sf_dir)
    return edges.select("from", "to", "doc", "score", F.array_join("reasons", ",").alias("reasons"))


@query(_IMAGE_SQL + ' SELECT "from", "to", score, CAST(row_number() OVER (PARTITION BY "from" ORDER BY score DESC, doc, substr("to", 7)) AS INT) AS n FROM r QUALIFY row_number() OVER (PARTITION BY "from" ORDER BY score DESC, doc, substr("to", 7)) <= 6')
def linked_images(spark, sf_dir):
    images, edges = _images(spark, sf_dir)
    return ontology.linked_images(edges, images).select("from", "to", "score", "n")


# ---- joins and rankings


@query("SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS n FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 6")
def linked_topk_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return joins.first_of_key(rows, "o_custkey", F.desc("o_totalprice"), "o_orderkey")


WANTED = [7, 3, 3, 999999999, 1, 32, 7, 2]


@query(f"SELECT CAST(w.pos AS INT) AS pos, o_orderkey, o_custkey, o_orderstatus FROM (SELECT unnest({WANTED}) AS id, generate_subscripts({WANTED}, 1) - 1 AS pos) w JOIN orders ON o_orderkey = id")
def id_list_lookup(spark, sf_dir):
    ids = spark.range(1).select(F.posexplode(F.lit(WANTED)).alias("pos", "id"))
    return joins.lookup_in_order(table(spark, sf_dir, "orders"), "o_orderkey", ids).select("pos", "o_orderkey", "o_custkey", "o_orderstatus")


@query("""
WITH h AS (SELECT o_custkey AS id, o_orderkey AS pos, o_orderpriority AS content FROM orders WHERE o_totalprice > 300000),
g AS (SELECT id, max(pos) AS pos, string_agg(content, '|' ORDER BY pos) AS highlights FROM h GROUP BY id)
SELECT c_custkey, c_name, pos, highlights FROM customer JOIN g ON id = c_custkey""")
def reorder_join_highlights(spark, sf_dir):
    hits = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("content"))
    return joins.with_highlights(table(spark, sf_dir, "customer"), "c_custkey", hits).select("c_custkey", "c_name", "pos", "highlights")


@query("SELECT c_custkey, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS ATA_code, coalesce(n_name, 'Unknown') AS category FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 2")
def dimension_enrichment(spark, sf_dir):
    code = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    names = table(spark, sf_dir, "nation").filter("n_regionkey <> 2").select(code("n_nationkey").alias("ATA_code"), F.col("n_name").alias("ATA_category"))
    found = joins.with_category(table(spark, sf_dir, "customer"), F.concat(F.lit("ATA-"), code("c_nationkey"), F.lit("-x")), names)
    return found.select("c_custkey", "ATA_code", F.col("ATA_category").alias("category"))


# ---- memory


@query("SELECT conv_id, array_to_string(list(role || ':' || md5(text) ORDER BY turn), ',') AS recent, count(*) AS n FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) GROUP BY conv_id")
def working_memory_last4(spark, sf_dir):
    m = memory.last_turns(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], ["turn", "role", "text"])
    return m.select("conv_id", F.array_join(F.transform("recent", lambda x: F.concat(x["role"], F.lit(":"), F.md5(x["text"].cast("binary")))), ",").alias("recent"), F.size("recent").cast("long").alias("n"))


_EPISODES_SQL = """
WITH e AS (SELECT user_id AS episode_id, ts AS updated_at, event_id, event_type, value, CAST(floor(value) AS BIGINT) AS names FROM events),
f AS (SELECT episode_id, min(updated_at) AS created_at FROM e GROUP BY ALL),
l AS (SELECT e.episode_id, created_at, updated_at, event_type, CASE WHEN names % 3 = 0 AND names <> e.episode_id THEN names END AS supersedes FROM e JOIN f USING (episode_id) QUALIFY row_number() OVER (PARTITION BY e.episode_id ORDER BY updated_at DESC, event_id DESC) = 1),
s AS (SELECT supersedes AS episode_id, arg_max(episode_id, (updated_at, episode_id)) AS superseded_by FROM l WHERE supersedes IS NOT NULL GROUP BY ALL)"""


@query(_EPISODES_SQL + " SELECT l.episode_id, created_at, updated_at, event_type, superseded_by FROM l LEFT JOIN s USING (episode_id)")
def episode_upsert_supersede(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_id"), F.col("ts").alias("updated_at"), F.col("ts").alias("created_at"), "event_id", "event_type", F.floor("value").alias("names"))
    e = e.withColumn("supersedes", F.when((F.col("names") % 3 == 0) & (F.col("names") != F.col("episode_id")), F.col("names")))
    latest = memory.upsert(e, "episode_id", ["updated_at", "event_id"], "created_at")
    by = latest.filter("supersedes IS NOT NULL").groupBy(F.col("supersedes").alias("_old")).agg(F.max_by("episode_id", F.struct("updated_at", "episode_id")).alias("superseded_by"))
    return latest.join(by, F.col("episode_id") == F.col("_old"), "left").select("episode_id", "created_at", "updated_at", "event_type", "superseded_by")


EPISODE_ASKED = [(1, "fr src1"), (2, "und de"), (3, "les"), (4, "nosuchword")]


@query(f"""WITH {sql.bm25(sql.values(EPISODE_ASKED, 'query_id, query'), "SELECT doc_id AS id, source AS case_ref, lang AS label, text AS summary, '' AS corrections FROM documents", memory.EPISODE_WEIGHTS, 3, where="id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)")}
SELECT query_id, id AS episode_id, round(bm25, 6) AS bm25, CAST(lexical_rank AS INT) AS n FROM bm25_found""")
def episodic_search(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    e = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("episode_id"), F.col("source").alias("case_ref"), F.col("lang").alias("label"), F.col("text").alias("summary"), F.lit("").alias("corrections"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("validated"), F.when(F.col("toxic") == 1, F.col("doc_id")).alias("superseded_by"), F.lit(0).alias("updated_at"),
    )
    found = memory.search(e, spark.createDataFrame(EPISODE_ASKED, "query_id int, query string"))
    return found.select("query_id", "episode_id", F.round("bm25", 6).alias("bm25"), "n")


# ---- decisions

KINDS = [*routing.EMPTY_TYPES, *routing.DEEP_TYPES, "technical_table", "technical_photo", "simple_labeled_component_view", "cockpit_panel_or_display", "other", "technical_procedure", "unclear"]
_ROUTE_SQL = f"""
WITH f AS (SELECT l_orderkey, l_linenumber, ({KINDS!r})[1 + (l_partkey % {len(KINDS)})] AS kind, l_suppkey % 2 = 0 AS hierarchy, l_partkey % 3 <> 0 AS related, CAST(l_quantity AS INT) % 14 AS ne, l_linenumber AS nr, CAST(l_quantity AS INT) % 12 AS nt,
  CASE l_suppkey % 3 WHEN 0 THEN 'power_plant_oil' WHEN 1 THEN 'flight_controls' ELSE 'doors' END AS dom, CASE WHEN l_orderkey % 4 = 0 THEN 'thrust  reverser' ELSE 'revision' END AS terms, l_returnflag = 'R' AS enough FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, CASE WHEN kind IN {routing.EMPTY_TYPES} THEN ['nano', '{routing.WHY["empty"]}'] WHEN kind IN {routing.DEEP_TYPES} THEN ['{routing.DEEP}', '{routing.WHY["deep"]}' || kind]
  WHEN kind IN ('technical_table', 'technical_photo') THEN ['nano', '{routing.WHY["plain"]}'] WHEN kind = 'simple_labeled_component_view' AND hierarchy AND ne >= 9 AND nr >= 5 THEN ['{routing.DEEP}', '{routing.WHY["hierarchy"]}']
  WHEN kind = 'cockpit_panel_or_display' AND related AND ne >= 8 AND nr >= 5 AND (dom IN ('flight_controls', 'power_plant_oil') OR regexp_matches(terms, '(?i)\\b({routing.MODE_WORDS})\\b')) THEN ['{routing.DEEP}', '{routing.WHY["cockpit"]}']
  WHEN kind = 'other' AND related AND ne >= 6 AND nr >= 4 THEN ['{routing.DEEP}', '{routing.WHY["dense"]}'] WHEN kind = 'technical_procedure' AND NOT enough AND nt >= 8 AND nr >= 4 AND dom = 'power_plant_oil' THEN ['{routing.DEEP}', '{routing.WHY["procedure"]}']
  ELSE ['nano', '{routing.WHY["default"]}'] END AS r FROM f)"""


def _routes(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    pick = lambda values, i: F.element_at(F.lit(values), (i + 1).cast("int"))
    quantity = F.col("l_quantity").cast("int")
    domain = pick(["power_plant_oil", "flight_controls", "doors"], F.col("l_suppkey") % 3)
    route = routing.caption_route(
        pick(KINDS, F.col("l_partkey") % len(KINDS)), F.col("l_suppkey") % 2 == 0, F.col("l_partkey") % 3 != 0, quantity % 14, F.col("l_linenumber"), quantity % 12, F.array(domain),
        F.when(F.col("l_orderkey") % 4 == 0, "thrust  reverser").otherwise("revision"), F.col("l_returnflag") == "R",
    )
    return line.select("l_orderkey", "l_linenumber", route.alias("r")).select("l_orderkey", "l_linenumber", "r.route", "r.reason")


@query(_ROUTE_SQL + " SELECT l_orderkey, l_linenumber, r[1] AS route, r[2] AS reason FROM r")
def route_matrix(spark, sf_dir):
    return _routes(spark, sf_dir)


LABELS = ["nano_sufficient", "deep_useful_for_rag", "deep_required", "ambiguous", "nano_sufficient"]


@query(_ROUTE_SQL + f""",
o AS (SELECT r[1] AS route, ({LABELS!r})[1 + (l_orderkey % {len(LABELS)})] AS label FROM r),
p AS (SELECT route, CASE WHEN label = 'ambiguous' THEN 'ambiguous' WHEN route = 'nano' AND label LIKE 'deep%' THEN 'false_nano' WHEN route <> 'nano' AND label = 'nano_sufficient' THEN 'false_gpt54' ELSE 'match' END AS outcome FROM o)
SELECT count(*) AS total_pages, count(*) FILTER (WHERE route = 'nano') AS routed_nano, count(*) FILTER (WHERE route <> 'nano') AS routed_deep, count(*) FILTER (WHERE outcome = 'false_nano') AS false_nano,
  count(*) FILTER (WHERE outcome = 'false_gpt54') AS false_deep, count(*) FILTER (WHERE outcome = 'ambiguous') AS ambiguous, CAST(0 AS BIGINT) AS unlabeled, round(count(*) FILTER (WHERE route <> 'nano') / count(*), 6) AS deep_ratio, 'revise_matrix' AS decision FROM p""")
def calibration_metrics(spark, sf_dir):
    rows = _routes(spark, sf_dir).withColumn("label", F.element_at(F.lit(LABELS), (F.col("l_orderkey") % len(LABELS) + 1).cast("int")))
    rows = rows.withColumn("outcome", routing.outcome(F.col("route"), F.col("label")))
    return routing.calibration(rows).withColumn("deep_ratio", F.round("deep_ratio", 6))


@query("""
WITH f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'search_rewrite' ELSE 'assistant_response' END AS stage, (['000', '100', 'query', '200'])[1 + (o_custkey % 4)] AS role, (['simple', 'standard', 'deep', 'auto'])[1 + (o_orderkey % 4)] AS c,
  (['low', 'medium', 'high'])[1 + (o_custkey % 3)] AS conf, CASE WHEN o_orderstatus = 'F' THEN 'gpt-5.4' ELSE 'gpt-5.4-nano' END AS asked FROM orders),
g AS (SELECT *, CASE WHEN stage = 'search_rewrite' THEN 'simple' WHEN c = 'auto' THEN 'standard' ELSE c END AS level, CASE WHEN stage = 'search_rewrite' THEN 'gpt-5.4-nano' ELSE asked END AS model FROM f),
h AS (SELECT *, CASE WHEN stage = 'search_rewrite' OR role = 'query' THEN 'search_rewrite' WHEN role = '000' THEN 'draft_standard_000' WHEN level = 'deep' OR conf = 'low' THEN 'analysis_deep' WHEN level = 'simple' THEN 'draft_simple' ELSE 'analysis_standard_100' END AS profile FROM g)
SELECT o_orderkey, profile, level AS complexity, model, CASE WHEN model = 'gpt-5.4' AND level = 'deep' THEN 'high' WHEN model = 'gpt-5.4' OR level = 'deep' THEN 'medium' ELSE 'low' END AS cost_class,
  CASE profile WHEN 'search_rewrite' THEN 'none' WHEN 'analysis_standard_100' THEN 'high' WHEN 'analysis_deep' THEN CASE WHEN model = 'gpt-5.4' THEN 'xhigh' ELSE 'high' END ELSE 'low' END AS effort FROM h""")
def execution_routing(spark, sf_dir):
    pick = lambda values, i: F.element_at(F.lit(values), (i + 1).cast("int"))
    o = table(spark, sf_dir, "orders")
    stage = F.when(F.col("o_orderkey") % 9 == 0, "search_rewrite").otherwise("assistant_response")
    cols = routing.execution(stage, pick(["000", "100", "query", "200"], F.col("o_custkey") % 4), pick(["simple", "standard", "deep", "auto"], F.col("o_orderkey") % 4), pick(["low", "medium", "high"], F.col("o_custkey") % 3), F.when(F.col("o_orderstatus") == "F", routing.DEEP).otherwise(routing.LIGHT_MODEL))
    rows = o.select("o_orderkey", *[c.alias(n) for n, c in cols.items()])
    return routing.with_profiles(rows).select("o_orderkey", "profile", "complexity", "model", "cost_class", "effort")


_STRATA_SQL = "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'multi' WHEN n_chars < 1000 THEN 'small' WHEN n_chars < 3000 THEN 'medium' ELSE 'large' END AS stratum FROM documents)"


@query(_STRATA_SQL + """,
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY doc_id) - 1 AS at, count(*) OVER (PARTITION BY stratum) AS size FROM d),
t AS (SELECT stratum, CAST(floor(i * (size - 1) / 9.0 + 0.5) AS BIGINT) AS at FROM (SELECT DISTINCT stratum, size FROM r), (SELECT unnest(range(10)) AS i)),
p AS (SELECT doc_id, stratum, 0 AS f FROM r WHERE size <= 10 UNION SELECT doc_id, r.stratum, 0 FROM r JOIN t ON r.stratum = t.stratum AND r.at = t.at WHERE size > 10),
u AS (SELECT * FROM p UNION ALL SELECT doc_id, stratum, 1 FROM d WHERE doc_id NOT IN (SELECT doc_id FROM p))
SELECT doc_id, stratum FROM u ORDER BY f, doc_id LIMIT 42""")
def stratified_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", evaluation.stratum(F.when(F.col("doc_id") % 13 == 0, 2).otherwise(1), F.col("n_chars"), 1000, 3000).alias("stratum"))
    return evaluation.stratified_sample(d, "doc_id", "doc_id", 42)


# ---- rendering, parsing, streams


@query("SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS text_md5, count(*) AS n_deltas FROM conversations GROUP BY conv_id")
def sse_accumulate(spark, sf_dir):
    out = stream.accumulate(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return out.select("conv_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "n_deltas")


@query("SELECT conv_id, turn, role AS event, md5(text) AS data_md5 FROM conversations WHERE text <> ''")
def sse_round_trip(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    data = F.regexp_replace("text", "\n", "\ndata: ")
    blocks = stream.encode_blocks(c.select("conv_id", "turn", F.col("role").alias("event"), data.alias("data")))
    parsed = stream.parse_blocks(blocks.select("conv_id", "turn", "block"), "block")
    return parsed.select("conv_id", "turn", "event", F.md5(F.col("data").cast("binary")).alias("data_md5"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p[^>]*>')) AS n_paragraphs, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text_md5 FROM pages")
def html_article_body(spark, sf_dir):
    bare = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " "))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<p[^>]*>"), F.lit(0))).cast("long").alias("n_paragraphs"), F.md5(bare.cast("binary")).alias("text_md5"))


@query("SELECT p_partkey, 'Figure ' || p_name || ',' || p_brand AS alts, 2 AS n_alts FROM part")
def image_alt_texts(spark, sf_dir):
    md = X.template("x ![Figure  {{name}}](a.png) y ![{{brand}}](b) ![](c)", {"name": F.col("p_name"), "brand": F.col("p_brand")})
    alts = X.image_alt_texts(md)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(alts, ",").alias("alts"), F.size(alts).alias("n_alts"))


@query("""
SELECT p_partkey, md5('# ' || p_name || chr(10) || chr(10) || p_type || chr(10) || chr(10) || '## Canonical identity' || chr(10) || chr(10) || '- Slug: `' || p_partkey || '`' || chr(10) || '- ATA: ATA-' || p_size || chr(10) || '- Aliases: ' || p_brand || ', ' || p_type
  || chr(10) || chr(10) || '## Technical documents' || chr(10) || chr(10) || '- [' || p_brand || '.pdf](../../pages/' || p_brand || '.pdf)' || chr(10) || chr(10) || '## Linked occurrences' || chr(10) || chr(10)) AS page_md5 FROM part""")
def markdown_render(spark, sf_dir):
    none = F.array().cast("array<string>")
    page = ontology.wiki_markdown(F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_type"), F.array(F.concat(F.lit("ATA-"), F.col("p_size").cast("string"))), none, F.array("p_brand", "p_type"), none, F.array(F.concat("p_brand", F.lit(".pdf"))), none)
    return table(spark, sf_dir, "part").select("p_partkey", F.md5(page.cast("binary")).alias("page_md5"))


@query("SELECT event_id, (SELECT string_agg(k || '=' || json_extract_string(props, '$.' || k), ';' ORDER BY k) FROM (SELECT unnest(json_keys(props)) AS k)) AS props FROM events")
def json_sorted_keys(spark, sf_dir):
    entries = F.array_sort(F.map_entries(F.from_json("props", "map<string,string>")))
    return table(spark, sf_dir, "events").select("event_id", F.nullif(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"), F.lit("")).alias("props"))


@query("""SELECT doc_id, md5(CASE WHEN regexp_matches(text, '["\\t\\r\\n\\\\]') THEN '"' || replace(replace(text, '\\', '\\\\'), '"', '\\"') || '"' ELSE text END) AS field_md5 FROM documents""")
def tsv_encode(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.tsv_field(F.col("text")).cast("binary")).alias("field_md5"))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS sum_value FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return stream.event_windows(table(spark, sf_dir, "events")).withColumn("sum_value", F.round("sum_value", 4))


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS session_start, count(*) AS n_events FROM s GROUP BY user_id, s""")
def event_sessions(spark, sf_dir):
    return stream.sessions(table(spark, sf_dir, "events"))


@query("SELECT lang, count(*) AS n_docs, count(*) FILTER (WHERE quality = 1) AS n_good, count(*) FILTER (WHERE toxic = 1) AS n_toxic, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def corpus_counters(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("lang").agg(F.count("*").alias("n_docs"), F.count_if(F.col("quality") == 1).alias("n_good"), F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.sum("n_chars").alias("n_chars"))


from corvina.plans import ocr_queries, scan_queries, search_queries, text_queries  # noqa: E402,F401  they register more queries
