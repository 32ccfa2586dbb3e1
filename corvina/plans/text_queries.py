"""Queries of the text, JSON and payload functions, over stated texts and the columns of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvina.functions import jsontext
from corvina.functions import text as X
from corvina.operators import corpus, evaluation, memory, ocr, payloads, routing
from corvina.plans import sql
from corvina.plans.registry import dealt, dealt_sql, query, table

LABEL_SQL = lambda x: sql.compact(f"regexp_replace({x}, '(?i)<br\\s*/?>', ' ', 'g')")
IS_PART_SQL = lambda x: f"""(length({x}) BETWEEN 4 AND 400 AND NOT regexp_matches({x}, '{X.SECTION}') AND NOT regexp_matches({x}, '(?i)\\b({X.GENERIC_WORDS})\\b')
  AND (regexp_matches({x}, '(?i)\\b({X.PART_WORDS})\\b') OR regexp_matches({x}, '(?i)\\bATA[\\s-]?\\d{{2}}\\b')))"""  # noqa: E731
#: Distinct, in locale order, as unique_sorted() puts them.
SORTED_SQL = lambda x: f"coalesce((SELECT string_agg(v, '|' ORDER BY v COLLATE en, v) FROM (SELECT DISTINCT unnest({x}) AS v)), '')"

#: Markdown made of the columns of a part: three levels of heading, a line break inside one, and headings that name no part.
PART_PAGE = "concat('# ', p_name, '\n## Door<br/>  ', p_brand, '\ntext ', p_type, '\n### Scope of frame\n#### Valve ', p_type, '\n# 12.3 Panel\n## Frame ', p_partkey, '\n## Tank ', p_type, '\n')"


@query(f"""
WITH p AS (SELECT p_partkey, regexp_extract_all({PART_PAGE.replace(chr(10), "' || chr(10) || '")}, '(?m)^#{{1,3}}\\s+(.+)$', 1) AS h FROM part),
c AS (SELECT p_partkey, list_transform(h, lambda x: {LABEL_SQL('x')}) AS h FROM p),
f AS (SELECT p_partkey, list_filter(h, lambda x: length(x) BETWEEN 4 AND 120 AND {IS_PART_SQL('x')} AND lower(x) <> 'airbus' AND NOT regexp_matches(x, '(?i){X.ADMIN_WORDS}')) AS h FROM c)
SELECT p_partkey, {SORTED_SQL('h[1:3]')} AS headings FROM f""")
def heading_candidates(spark, sf_dir):
    page = F.expr(PART_PAGE.replace("\n", "\\n"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.heading_candidates(page), "|").alias("headings"))


PARTS_FIELD = "concat(p_name, ' valve; Scope, ', p_brand, ' seal | ab;', p_type, ';  door<br>frame ,door frame;1.2 pump, ATA 28 ', p_size)"


@query(f"""
WITH p AS (SELECT p_partkey, list_transform(regexp_split_to_array({PARTS_FIELD}, '[;,|]'), lambda x: {LABEL_SQL('x')}) AS f FROM part)
SELECT p_partkey, {SORTED_SQL(f"list_filter(f, lambda x: length(x) >= 3 AND {IS_PART_SQL('x')})")} AS parts, {SORTED_SQL(f"list_filter(f, lambda x: {IS_PART_SQL('x')})")} AS candidates FROM p""")
def split_parts_field(spark, sf_dir):
    field = F.expr(PARTS_FIELD)
    labels = F.transform(F.split(field, "[;,|]"), X.candidate_label)
    kept = X.unique_sorted(F.filter(labels, X.is_part_candidate))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.split_parts(field), "|").alias("parts"), F.array_join(kept, "|").alias("candidates"))


@query(f"""
WITH p AS (SELECT page_id, {sql.compact("url || ' ' || page_id || ' of the'")} AS t, lower({sql.fold('url')}) AS u FROM pages)
SELECT page_id, array_to_string(list_transform(string_split(t, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS titled, trim(regexp_replace(u, '[^a-z0-9]+', '-', 'g'), '-') AS image_slug,
  left(trim(regexp_replace(lower(repeat(url, 4)), '[^a-z0-9]+', '-', 'g'), '-'), 160) AS stable, left(trim(regexp_replace(lower(repeat(url, 9)), '[^a-z0-9]+', '-', 'g'), '-'), 180) AS custom FROM p JOIN pages USING (page_id)""")
def titles_and_slugs(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", X.title_case(F.concat_ws(" ", "url", F.col("page_id").cast("string"), F.lit("of the"))).alias("titled"), X.slugify(url, None).alias("image_slug"), X.stable_slug(F.repeat(url, 4)).alias("stable"), X.stable_slug(F.repeat(url, 9), 180).alias("custom"),
    )


#: Names with capitals, accents, blanks and signs in them, which no order by bytes puts as people read them.
_NAMED = "CASE s_suppkey % 6 WHEN 0 THEN upper(s_name) WHEN 1 THEN concat('é', s_suppkey) WHEN 2 THEN concat('Ế', lower(s_name)) WHEN 3 THEN concat('e ', s_suppkey) WHEN 4 THEN concat('e-', s_suppkey) ELSE lower(s_name) END"


@query(f"""
WITH n AS (SELECT s_nationkey, {_NAMED} AS name FROM supplier)
SELECT s_nationkey, string_agg(name, '|' ORDER BY name COLLATE en, name) AS names FROM (SELECT DISTINCT * FROM n) GROUP BY s_nationkey""")
def locale_sorted_names(spark, sf_dir):
    named = table(spark, sf_dir, "supplier").select("s_nationkey", F.expr(_NAMED).alias("name")).groupBy("s_nationkey").agg(F.collect_set("name").alias("n"))
    return named.select("s_nationkey", F.array_join(X.unique_sorted(F.col("n")), "|").alias("names"))


#: Letters of other forms and the plain ones that they fold to.
_FORMS = {"Việt": "viet", "ﬁre": "fire", "２８": "28", "x²": "x2", "㎏": "kg", "Ａ³²": "a32", "日本": ""}


@query(f"""
WITH w AS (SELECT * FROM {sql.values([(i, plain) for i, plain in enumerate(_FORMS.values())], 'i, plain')}),
t AS (SELECT doc_id, {sql.tokens("text || ' ' || w.plain || 'e ' || w.plain")} AS t FROM documents JOIN w ON w.i = doc_id % {len(_FORMS)})
SELECT doc_id, md5(array_to_string(list_sort(list_distinct(t)), ' ')) AS tokens_, len(t) AS n FROM t""")
def tokens_of_other_forms(spark, sf_dir):
    form = F.element_at(F.array(*map(F.lit, _FORMS)), (F.col("doc_id") % len(_FORMS) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", X.query_tokens(F.concat("text", F.lit(" "), form, F.lit("e "), form), distinct=False).alias("t"))
    return rows.select("doc_id", F.md5(F.array_join(F.array_sort(F.array_distinct("t")), " ").cast("binary")).alias("tokens_"), F.size("t").cast("long").alias("n"))


@query(f"""
SELECT source, array_to_string(list_sort(list_distinct(list_filter(list_transform(flatten(list([lang, ' ' || lang || ' ', '', ' ', source])), lambda x: trim(x)), lambda x: x <> ''))), '|') AS names FROM documents GROUP BY source""")
def unique_sorted_names(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.flatten(F.collect_set(F.array(F.col("lang"), F.concat(F.lit(" "), F.col("lang"), F.lit(" ")), F.lit(""), F.lit(" "), F.col("source")))).alias("n"))
    return rows.select("source", F.array_join(X.unique_sorted(F.col("n")), "|").alias("names"))


#: A page of a heading, an image and a line, some of which are left out by number.
SEPARATOR = "concat(if(doc_id % 3 = 0, concat('# ATA ', doc_id % 90 + 10, ' fuel<br/>tank'), source), if(doc_id % 2 = 0, '\n\n![a](b.png)\n', ' '), if(doc_id % 5 = 0, 'see figure 3', ''))"
SEPARATOR_SQL = "concat(CASE WHEN doc_id % 3 = 0 THEN concat('# ATA ', doc_id % 90 + 10, ' fuel<br/>tank') ELSE source END, CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '![a](b.png)' || chr(10) ELSE ' ' END, CASE WHEN doc_id % 5 = 0 THEN 'see figure 3' ELSE '' END)"


@query(f"""
WITH d AS (SELECT doc_id, CAST(doc_id % 2 = 0 AS INT) AS n, (doc_id % 11) / 10.0 AS w, {SEPARATOR_SQL} AS m FROM documents),
l AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(m, '!\\[[^\\]]*\\]\\([^)]*\\)', chr(10), 'g'), chr(10)), lambda x: {sql.compact("regexp_replace(regexp_replace(x, '^#{1,6}\\s*', ''), '(?i)<br\\s*/?>', ' ', 'g')")}), lambda x: x <> '') AS v FROM d)
SELECT doc_id, array_to_string(v, '|') AS lines, n = 1 AND len(v) = 1 AND coalesce(length(v[1]) <= 120 AND regexp_matches(v[1], '(?i)^ATA[\\s-]?\\d{{2}}\\b') AND NOT regexp_matches(v[1], '(?i)\\b({corpus.PROCEDURE_WORDS})\\b'), false) AND w >= 0.92 AS separator FROM l""")
def separator_pages(spark, sf_dir):
    page = F.expr(SEPARATOR.replace("\n", "\\n"))
    wide, n = (F.col("doc_id") % 11) / 10.0, (F.col("doc_id") % 2 == 0).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.visible_lines(page), "|").alias("lines"), corpus.is_separator(page, n, wide).alias("separator"))


@query("""
WITH i AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 'data:image/png;base64,' || to_base64(encode(text)) WHEN doc_id % 3 = 1 THEN to_base64(encode(text)) ELSE '  ' END AS b FROM documents),
u AS (SELECT *, CASE WHEN trim(b) = '' THEN NULL WHEN starts_with(b, 'data:') THEN b ELSE 'data:image/jpeg;base64,' || b END AS url FROM i)
SELECT doc_id, url, CAST(floor(length(string_split(url, ',')[-1]) * 3 / 4) AS BIGINT) AS approx, md5(from_base64(string_split(url, ',')[-1])) AS bytes_md5 FROM u""")
def image_data_urls(spark, sf_dir):
    raw = F.replace(F.base64(F.col("text").cast("binary")), F.lit("\r\n"), F.lit(""))
    b = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("data:image/png;base64,"), raw)).when(F.col("doc_id") % 3 == 1, raw).otherwise("  ")
    urls = table(spark, sf_dir, "documents").select("doc_id", ocr.data_url(b).alias("url"))
    return urls.select("doc_id", "url", X.approx_bytes(F.col("url")).alias("approx"), F.md5(ocr.decoded(F.col("url"))).alias("bytes_md5"))


@query("""
WITH u AS (SELECT lang, to_base64(encode(text)) AS b FROM documents)
SELECT lang, CAST(sum(floor(length(b) * 3 / 4)) AS BIGINT) AS image_bytes, count(*) AS n_images FROM u GROUP BY lang""")
def image_bytes_by_language(spark, sf_dir):
    raw = F.concat(F.lit("data:image/jpeg;base64,"), F.replace(F.base64(F.col("text").cast("binary")), F.lit("\r\n"), F.lit("")))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(X.approx_bytes(raw)).alias("image_bytes"), F.count("*").alias("n_images"))


NUMBERS = [(1, " 42 "), (2, "-7x"), (3, "x7"), (4, ""), (5, None), (6, "+15.9"), (7, "99999999999999"), (8, "0012")]


@query(f"SELECT id, coalesce(TRY_CAST(nullif(regexp_extract(v || ' ' || id, '^\\s*([+-]?\\d+)', 1), '') AS INT), 0) AS n FROM {dealt_sql('orders', 'o_orderkey', [n[1:] for n in NUMBERS], 'v')}")
def int_or_zero(spark, sf_dir):
    rows = dealt(spark, sf_dir, "orders", "o_orderkey", [n[1:] for n in NUMBERS], "v string")
    return rows.select("id", X.int_or_zero(F.concat("v", F.lit(" "), F.col("id").cast("string"))).alias("n"))


#: A reply in JSON, cut at a place that depends on the row.
CUT = "concat('{\"label\": \"', source, '\", \"comment\" : \"say ', lang, ' of ', source, '\", \"n\": 1}')"


@query(f"""
WITH c AS (SELECT doc_id, left({CUT}, CAST(doc_id % 70 AS INT)) AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, '"comment"\\s*:\\s*"') THEN regexp_extract(t, '"comment"\\s*:\\s*"([^"]*)', 1) END AS comment FROM c""")
def partial_json_field(spark, sf_dir):
    cut = F.expr(f"left({CUT}, cast(doc_id % 70 as int))")
    return table(spark, sf_dir, "documents").select("doc_id", jsontext.partial(cut, "comment").alias("comment"))


@query("""
SELECT doc_id, 'lang: ' || lang || '; list: ' || source || '; x ' || source || '; deep: a: 1; b: true' AS flat FROM documents""")
def flattened_values(spark, sf_dir):
    value = F.to_json(F.struct("lang", F.lit("  ").alias("blank"), F.array(F.col("source"), F.lit(""), F.concat(F.lit("x\n "), "source")).alias("list"), F.struct(F.lit(1).alias("a"), F.lit(True).alias("b")).alias("deep")))
    return table(spark, sf_dir, "documents").select("doc_id", jsontext.flattened(value).alias("flat"))


@query(r"""SELECT doc_id, md5(regexp_replace(text, '["\\\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS text_md5 FROM documents""")
def newlines_repaired(spark, sf_dir):
    plain = table(spark, sf_dir, "documents").withColumn("t", F.regexp_replace("text", r'["\\\x00-\x08\x0B\x0C\x0E-\x1F]', ""))
    broken = F.concat(F.lit('{"description": "'), "t", F.lit('"}'))
    return plain.select("doc_id", F.md5(F.get_json_object(jsontext.repaired(broken), "$.description").cast("binary")).alias("text_md5"))


SCHEMA = {
    "type": "object", "required": ["lang", "id"], "additionalProperties": False,
    "properties": {"lang": {"enum": ["en", "de"]}, "id": {"$ref": "#/$defs/id"}, "tags": {"type": "array", "items": {"anyOf": [{"const": "a"}, {"type": "integer"}]}}}, "$defs": {"id": {"type": "integer"}},
}


@query("""
SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 4 = 0 THEN '$.id: missing' END, CASE WHEN lang NOT IN ('en', 'de') THEN '$.lang: not in enum' END, CASE WHEN doc_id % 4 = 1 THEN '$.id: not integer' END,
  CASE WHEN doc_id % 3 = 0 THEN '$.tags[1]: 0 of anyOf fit' END, CASE WHEN doc_id % 5 = 0 THEN '$.more: unknown' END], lambda x: x IS NOT NULL), '|') AS broken FROM documents""")
def schema_violations(spark, sf_dir):
    number = F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 == 1, ', "id": "x"').otherwise(F.concat(F.lit(', "id": '), F.col("doc_id").cast("string")))
    tags = F.when(F.col("doc_id") % 3 == 0, ', "tags": ["a", "b"]').otherwise(', "tags": ["a", 2]')
    more = F.when(F.col("doc_id") % 5 == 0, ', "more": 1').otherwise("")
    value = F.concat(F.lit('{"lang": "'), "lang", F.lit('"'), number, tags, more, F.lit("}"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(jsontext.schema_violations(value, SCHEMA), "|").alias("broken"))


@query("SELECT doc_id, starts_with(lower(strip_accents('Étude-' || source)), 'etude-src1') OR starts_with(lower(strip_accents('Étude-' || source)), 'etude-src3') AS relevant FROM documents")
def expected_prefixes(spark, sf_dir):
    name = F.concat(F.lit("Étude-"), "source")
    return table(spark, sf_dir, "documents").select("doc_id", evaluation.starts_with_any(name, F.array(F.lit("etude-SRC1"), F.lit("ÉTUDE-src3"))).alias("relevant"))


SAFE = [(1, "a.json"), (2, "../a.json"), (3, "a/b.json"), (4, "a..json"), (5, "ä b.json"), (6, "")]


@query(f"SELECT id, NOT (contains(name, '..') OR contains(name, '/')) AS safe, NOT (contains(name, '..') OR contains(name, '/') OR name = '') AND ends_with(name, '.json') AS readable FROM {dealt_sql('documents', 'doc_id', [r[1:] for r in SAFE], 'name')}")
def safe_file_names(spark, sf_dir):
    from corvina.sources.readers import is_safe_name

    rows = dealt(spark, sf_dir, "documents", "doc_id", [r[1:] for r in SAFE], "name string")
    safe = is_safe_name(F.col("name"))
    return rows.select("id", safe.alias("safe"), (safe & (F.col("name") != "") & F.col("name").endswith(".json")).alias("readable"))


# ---- replies and conversations

#: Replies of every form, made of a conversation's turn.
REPLY = """CASE turn % 6 WHEN 0 THEN concat('{"label": "L', conv_id, '", "comment": "done", "description": {"a": 1}}') WHEN 1 THEN concat('{"label": "L', conv_id, '", "description": "text"}')
  WHEN 2 THEN concat('plain ', role) WHEN 3 THEN '{"comment": "only"}' WHEN 4 THEN '[1, 2]' ELSE '{"other": 2}' END"""


@query(f"""
WITH r AS (SELECT conv_id, turn, turn % 6 AS k, {REPLY} AS reply FROM conversations)
SELECT conv_id, turn, CASE k WHEN 0 THEN 'done' WHEN 1 THEN NULL WHEN 3 THEN 'only' ELSE reply END AS text, CASE WHEN k <= 1 THEN 'L' || conv_id END AS label,
  CASE k WHEN 0 THEN '{{"a":1}}' WHEN 1 THEN 'text' END AS description, k IN (2, 3, 4, 5) AND turn % 2 = 0 AS repair FROM r""")
def final_payloads(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", payloads.final_payload(F.expr(REPLY)).alias("p"))
    return rows.select("conv_id", "turn", "p.text", "p.label", "p.description", payloads.needs_repair(F.col("turn") % 2 == 0, F.col("p")).alias("repair"))


@query("""
WITH s AS (SELECT conv_id, list(role ORDER BY turn) FILTER (WHERE turn < 2) AS t, list(role ORDER BY turn) FILTER (WHERE turn >= 2) AS n, list(role ORDER BY turn) FILTER (WHERE turn >= 4) AS w FROM conversations GROUP BY conv_id)
SELECT conv_id, concat_ws(',', CASE WHEN len(t) > 0 THEN 'tech_docs:' || len(t) END, CASE WHEN len(n) > 0 THEN 'non_conformities:' || len(n) END, CASE WHEN len(w) > 0 THEN 'entities_wiki:' || len(w) END) AS found,
  t IS NOT NULL AND n IS NOT NULL AS usable FROM s""")
def source_groups(spark, sf_dir):
    some = lambda c: F.when(F.count_if(c) > 0, F.collect_list(F.when(c, F.col("role"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(some(F.col("turn") < 2).alias("tech_docs"), some(F.col("turn") >= 2).alias("non_conformities"), some(F.col("turn") >= 4).alias("entities_wiki"))
    s = F.struct("tech_docs", "non_conformities", "entities_wiki")
    named = F.transform(payloads.source_groups(s), lambda g: F.concat_ws(":", g["name"], F.size(g["items"]).cast("string")))
    return rows.select("conv_id", F.array_join(named, ",").alias("found"), payloads.usable_sources(s).isNotNull().alias("usable"))


@query("""
WITH e AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN 'validated_output' ELSE 'note' END AS type, CASE WHEN turn % 3 = 0 THEN '  ' ELSE ' ' || text END AS response, turn % 4 <> 0 AS ok FROM conversations)
SELECT conv_id, turn, regexp_replace(response, '^\\s+|\\s+$', '', 'g') AS summary FROM e WHERE type = 'validated_output' AND regexp_replace(response, '^\\s+|\\s+$', '', 'g') <> '' AND ok""")
def persisted_episodes(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "user", "validated_output").otherwise("note").alias("type"), F.lit(None).cast("string").alias("summary"),
        F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "text")).alias("response_text"), (F.col("turn") % 4 != 0).alias("validated"),
    )
    return payloads.episodes(rows).select("conv_id", "turn", "summary")


@query(f"SELECT '{payloads.CAUTION}' AS text, 'L' || conv_id AS label, role AS description, text AS user_query, role AS input_description, 'ai' AS role, CASE turn % 2 WHEN 0 THEN '000' ELSE '100' END AS user_role FROM conversations")
def cautious_replies(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    asked = rows.select(F.col("text").alias("user_message"), F.when(F.col("turn") % 2 == 0, "000").otherwise("100").alias("role"), F.concat(F.lit("L"), F.col("conv_id").cast("string")).alias("label"), F.col("role").alias("description"))
    return payloads.cautious(asked)


@query("""
WITH h AS (SELECT conv_id, turn, list(role ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS before, turn % 3 = 0 AS own, role FROM conversations)
SELECT conv_id, turn, array_to_string(CASE WHEN own THEN ['mine', role] ELSE coalesce(before, []) END, '|') AS history, (SELECT coalesce(string_agg(k, '|' ORDER BY k), '') FROM (SELECT unnest(['000', '100', '200']) AS k) WHERE k < CASE turn % 3 WHEN 0 THEN '000' WHEN 1 THEN '100' ELSE '300' END) AS earlier FROM h""")
def request_history(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-4, -1)
    rows = table(spark, sf_dir, "conversations").withColumn("before", F.collect_list("role").over(w))
    requested = F.when(F.col("turn") % 3 == 0, F.array(F.lit("mine"), F.col("role"))).otherwise(F.array().cast("array<string>"))
    tasks = F.create_map(*[x for k in ("000", "100", "200") for x in (F.lit(k), F.lit(1))])
    current = F.when(F.col("turn") % 3 == 0, "000").when(F.col("turn") % 3 == 1, "100").otherwise("300")
    earlier = F.array_join(F.array_sort(F.map_keys(payloads.earlier_tasks(tasks, current))), "|")
    return rows.select("conv_id", "turn", F.array_join(memory.merge_history(requested, F.col("before")), "|").alias("history"), earlier.alias("earlier"))


MERGED = [(1, "fuel tank", "fuel|tank", "ATA 28|zone 3"), (2, "a|b|c", "d|e|f", "g"), (3, "a", "a|b", ""), (4, "", "", "")]


@query(f"""
WITH q AS (SELECT id, list_filter(string_split(a || '|' || source, '|') || string_split(b, '|') || [replace(c, '|', ' ')], lambda x: x <> '') AS v FROM {dealt_sql('documents', 'doc_id', [m[1:] for m in MERGED], 'a, b, c')})
SELECT id, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i)[1:4], '|') AS variants FROM q""")
def merged_variants(spark, sf_dir):
    rows = dealt(spark, sf_dir, "documents", "doc_id", [m[1:] for m in MERGED], "a string, b string, c string").withColumn("a", F.concat_ws("|", "a", "source"))
    some = lambda c: F.filter(F.split(c, "[|]"), lambda v: v != "")
    return rows.select("id", F.array_join(payloads.merged_variants(some("a"), some("b"), some("c")), "|").alias("variants"))


REPLIES = [(1, "simple"), (2, " Standard because"), (3, "DEEP\nfor"), (4, "deep")]


@query(f"SELECT id, lower(regexp_extract(reply, '([A-Za-z]+)', 1)) AS level FROM {dealt_sql('documents', 'doc_id', [r[1:] for r in REPLIES], 'reply')}")
def complexity_levels(spark, sf_dir):
    rows = dealt(spark, sf_dir, "documents", "doc_id", [r[1:] for r in REPLIES], "reply string")
    return rows.select("id", routing.complexity_level(F.concat_ws(" ", "reply", "source")).alias("level"))


# ---- entities

ENTITY = "CASE WHEN s_suppkey % 4 = 0 THEN '' WHEN s_suppkey % 4 = 1 THEN NULL ELSE s_name END"


@query(f"""
WITH e AS (SELECT s_suppkey AS id, {ENTITY} AS title, CASE WHEN s_suppkey % 8 = 0 THEN NULL ELSE 'doc' || s_suppkey END AS doc, [s_nationkey::VARCHAR, 'd', 'd'] AS docs, s_suppkey % 3 AS n FROM supplier),
l AS (SELECT *, coalesce(nullif(trim(title), ''), nullif(trim(doc), ''), 'c' || id) AS named, len(list_distinct(docs || CASE WHEN doc IS NULL THEN [] ELSE [doc] END)) AS n_docs FROM e)
SELECT id, named AS title, array_to_string((list_transform(range(n), lambda i: 'ATA-' || i) || ['Zone LH', 'Zone ' || id])[1:3], ' / ') AS meta, CASE WHEN n < 2 THEN array_to_string(list_transform(range(n + 1), lambda i: 'a' || i), ', ') ELSE 'a0, a1 +1' END AS alias,
  n_docs || CASE WHEN n_docs = 1 THEN ' doc' ELSE ' docs' END AS docs_label, CASE n WHEN 0 THEN '' WHEN 1 THEN '1 image' ELSE '2 images' END AS images_label, 'Open entity ' || named AS aria_label FROM l""")
def entity_list_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.expr(ENTITY).alias("title"), F.when(F.col("s_suppkey") % 8 != 0, F.concat(F.lit("doc"), F.col("s_suppkey").cast("string"))).alias("doc"),
        F.array(F.col("s_nationkey").cast("string"), F.lit("d"), F.lit("d")).alias("docs"), (F.col("s_suppkey") % 3).cast("int").alias("n"),
    )
    numbers = F.expr("filter(array(0, 1, 2), i -> i < n)")
    image = F.transform(numbers, lambda i: F.struct(F.when(i == 0, F.lit("p.png")).alias("asset_path"), F.concat(F.lit("d"), i.cast("string")).alias("doc"), F.lit("i").alias("id")))
    twice = F.concat(image, image)
    labels = payloads.entity_labels(
        F.col("title"), F.col("doc"), F.concat(F.lit("c"), F.col("id").cast("string")), F.col("docs"), F.col("doc"), twice, F.transform(numbers, lambda i: F.concat(F.lit("ATA-"), i.cast("string"))), F.array(F.lit("LH"), F.col("id").cast("string")),
        F.transform(F.expr("filter(array(0, 1, 2), i -> i <= n)"), lambda i: F.concat(F.lit("a"), i.cast("string"))),
    )
    return rows.select("id", *[c.alias(n) for n, c in labels.items()])


@query("""
WITH e AS (SELECT s_nationkey AS g, s_name AS k, s_suppkey AS p, CASE WHEN s_nationkey % 2 = 0 THEN 'Supplier#000000003' END AS current, s_suppkey % 5 = 0 AS has FROM supplier)
SELECT g AS s_nationkey, arg_min(k, (CASE WHEN k IS NOT DISTINCT FROM current THEN 0 WHEN has THEN 1 ELSE 2 END, p)) AS selected FROM e GROUP BY g""")
def selected_entities(spark, sf_dir):
    current = F.when(F.col("s_nationkey") % 2 == 0, "Supplier#000000003")
    return payloads.selected_entity(table(spark, sf_dir, "supplier"), "s_nationkey", "s_name", "s_suppkey", current, F.col("s_suppkey") % 5 == 0)
