"""The queries of this subpackage and the SQL they can be checked against."""

from __future__ import annotations

import public_tokenizers

from corvina.llm import ann, audit, bpe, fingerprints, language, lines, packing, pii, quality, simhash, topk, toxicity, whitening
from corvina.llm.common import documents_of

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.tiktoken"


def op1_quality(spark, sf_dir):
    return quality.classify(documents_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_nearest(spark, sf_dir):
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_packing(spark, sf_dir):
    return packing.best_fit_packing(documents_of(spark, sf_dir), public_tokenizers.path(WORD_BPE))


def op4_line_dedup(spark, sf_dir):
    return lines.line_dedup(documents_of(spark, sf_dir))


def op5_simhash(spark, sf_dir):
    return simhash.near_duplicates(documents_of(spark, sf_dir))


def op6_topk(spark, sf_dir):
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_language(spark, sf_dir):
    return language.identify(documents_of(spark, sf_dir))


def op8_bpe(spark, sf_dir):
    return bpe.digest(documents_of(spark, sf_dir), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op9_pii(spark, sf_dir):
    return pii.personal_data(documents_of(spark, sf_dir))


def op10_toxicity(spark, sf_dir):
    return toxicity.classify(documents_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_audit(spark, sf_dir):
    return audit.filter_audit(documents_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_fingerprints(spark, sf_dir):
    found = fingerprints.edited_fingerprints(documents_of(spark, sf_dir))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op13_whitening(spark, sf_dir):
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_nearest, op3_packing, op4_line_dedup, op5_simhash, op6_topk, op7_language, op8_bpe, op9_pii, op10_toxicity, op11_audit, op12_fingerprints, op13_whitening)}

ORACLE_SQL = {
    "op4_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT doc_id, pos, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op6_topk": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10""",
    "op11_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         map {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t),
              'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)} AS fails
  FROM w LEFT JOIN l USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
seen AS (
  SELECT part, filter_order, s.step, filter_order[s.step] AS x, good, toxic, fails[filter_order[s.step]] AS failing, len(list_filter(map_values(fails), lambda v: v)) AS n_failing,
         coalesce(list_position(list_transform(string_split(filter_order, ''), lambda c: fails[c]), true), 6) AS first
  FROM f, steps s),
counted AS (
  SELECT part, filter_order, step, x, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed, count(*) FILTER (failing AND first < step) AS redundant,
         count(*) FILTER (failing AND n_failing = 1) AS unique_fails, count(*) FILTER (first = step AND good = 1) AS good_lost, count(*) FILTER (first = step AND toxic = 1) AS toxic_lost
  FROM seen GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM counted""",
    "op12_fingerprints": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, CAST(length(text) AS BIGINT) AS n_chars, coalesce(lead(text) OVER (ORDER BY doc_id), first(text) OVER (ORDER BY doc_id)) AS next_text FROM d),
e AS (SELECT *, left(text, n_chars - n_chars // 4) || left(next_text, n_chars // 4) AS edited FROM n),
texts AS (SELECT DISTINCT t FROM (SELECT text AS t FROM e UNION ALL SELECT edited FROM e UNION ALL SELECT next_text FROM e)),
lines AS (SELECT t, unnest(regexp_extract_all(t, '[^
]*
|[^
]+')) AS line, generate_subscripts(regexp_extract_all(t, '[^
]*
|[^
]+'), 1) AS pos FROM texts),
leaves AS (SELECT *, regexp_extract_all(line, '[^.!?]{1,48}(?:[.!?]{1,8} {0,8})?|[.!?]{1,8} {0,8}') AS p FROM lines),
codes AS (SELECT t, pos, line, list_transform(p, lambda x: sha256(x)) AS hs, list_transform(p, lambda x: CAST('0x' || left(sha256(x), 12) AS BIGINT) * 128 + length(x)) AS cs FROM leaves),
paragraphs AS (SELECT *, sha256(list_aggregate(hs, 'string_agg', '')) AS h FROM codes),
marked AS (
  SELECT *, CAST(pos = 1 OR regexp_matches(line, '^#{1,6} ') OR lag(regexp_matches(line, '^[ 	
]*
$') OR regexp_matches(h, '^[0-3]')) OVER (PARTITION BY t ORDER BY pos) AS INT) AS starts
  FROM paragraphs),
sectioned AS (SELECT *, sum(starts) OVER (PARTITION BY t ORDER BY pos) AS section FROM marked),
sections AS (
  SELECT t, section, sha256(string_agg(h, '' ORDER BY pos)) AS h, flatten(list(cs ORDER BY pos)) AS cs,
         string_agg(left(h, 16) || '=' || list_aggregate(list_transform(cs, lambda c: lower(hex(c))), 'string_agg', ','), ';' ORDER BY pos) AS shown
  FROM sectioned GROUP BY t, section),
trees AS (SELECT t, sha256(string_agg(h, '' ORDER BY section)) || string_agg('|' || left(h, 16) || ':' || shown, '' ORDER BY section) AS fp, list_distinct(flatten(list(cs))) AS cs FROM sections GROUP BY t),
every AS (SELECT t, coalesce(fp, sha256('')) AS fp, coalesce(cs, []) AS cs FROM texts LEFT JOIN trees USING (t)),
weighed AS (SELECT *, coalesce(list_sum(list_transform(cs, lambda c: c % 128)), 0) AS w FROM every),
compared AS (
  SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint, a.w AS aw, b.w AS bw, c.w AS cw,
         coalesce(list_sum(list_transform(list_intersect(a.cs, b.cs), lambda x: x % 128)), 0) AS ab, coalesce(list_sum(list_transform(list_intersect(a.cs, c.cs), lambda x: x % 128)), 0) AS ac
  FROM e JOIN weighed a ON a.t = e.text JOIN weighed b ON b.t = e.edited JOIN weighed c ON c.t = e.next_text)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, CASE WHEN aw + bw = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * ab / (aw + bw) END AS near_edited,
       CASE WHEN aw + cw = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * ac / (aw + cw) END AS near_next FROM compared""",
}
