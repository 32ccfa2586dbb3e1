"""Text functions on fixtures."""

import unicodedata

from pyspark.sql import functions as F

from corvina.functions import jsontext
from corvina.functions import text as X
from corvina.operators import corpus, rewrite


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, X.query_tokens(F.col("t")), t="Rivet rivet pare-brise") == ["rivet", "pare", "brise"]
    assert one(spark, X.match_query(X.query_tokens(F.col("t"))), t="Right windshield rivet") == "right* AND windshield* AND rivet*"
    assert one(spark, X.match_query(X.query_tokens(F.col("t"))), t="  ") == ""
    assert one(spark, X.index_tokens(F.col("t")), t="Straße_été x² ﬁn A-1") == ["straße", "ete", "x²", "ﬁn", "a", "1"]
    assert one(spark, X.fold(F.col("t")), t="Éaß Ñ") == "ea n"
    assert one(spark, X.query_tokens(F.col("t")), t="Việt ﬁre ２８ x² ㎏") == ["viet", "fire", "28", "x2", "kg"]


def test_folding_of_every_character(spark):
    every = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    fold = lambda t: "".join(x for x in unicodedata.normalize("NFKD", t) if x < "\x80").lower()
    rows = spark.createDataFrame([(c, chr(c), f"a{chr(c)}{chr((c * 7919) % 0xD000)}b {chr(c)}") for c in every], "c int, t string, u string")
    got = rows.select("c", X.fold(F.col("t")), X.fold(F.col("u"))).toPandas()
    assert [(c, *r) for c, *r in got.itertuples(index=False) if r != [fold(chr(c)), fold(f"a{chr(c)}{chr((c * 7919) % 0xD000)}b {chr(c)}")]] == []


def test_locale_order(spark):
    names = ["b", "a-b", "a b", "A", "a", "é", "z", "Ab", "ab", "É", "e", "f", "10", "9", "_x", "a\u0301", "á"]
    want = ["_x", "10", "9", "a", "A", "a\u0301", "á", "a b", "a-b", "ab", "Ab", "b", "e", "é", "É", "f", "z"]
    assert one(spark, X.unique_sorted(F.array(*map(F.lit, reversed(names)))) ) == want
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(*X.in_locale("n"))
    assert [r.n for r in rows.collect()] == want
    assert one(spark, X.unique_sorted(F.array(F.lit(" b "), F.lit("b"), F.lit(""), F.lit(None).cast("string")))) == ["b"]


def test_codes(spark):
    text = "RH door near frame 20/21 in the right forward zone. ATA 52, ata-28 and ATA52; xATA 99. A220-52-1001 B-1"
    assert one(spark, X.ata_codes(F.col("t")), t=text) == ["ATA-28", "ATA-52"]
    assert one(spark, X.zones(F.col("t")), t=text) == ["RH", "forward", "frame 20/21", "right"]
    assert one(spark, X.zones(F.col("t")), t="éRH door") == ["RH"]
    assert one(spark, X.part_numbers(F.col("t")), t=text) == ["A220-52-1001"]
    assert one(spark, X.task_kind(F.col("d"), F.col("c"), F.col("t")), d="ATA-52-demo", c="ATA-52-demo-000-2026", t="") == "000"
    assert one(spark, X.task_kind(F.col("d"), F.col("c"), F.col("t")), d="a 123 b", c="x", t="none") == "123"


def test_parts(spark):
    assert one(spark, X.split_parts(F.col("t")), t="1. Scope; Door Frame") == ["Door Frame"]
    assert one(spark, X.split_parts(F.col("t")), t="RH Passenger Door; Door<br/>Frame 20/21|x,  ") == ["Door Frame 20/21", "RH Passenger Door"]
    assert one(spark, X.split_parts(F.col("t")), t="") == []
    heads = "# RH Passenger Door\n## Purpose of door\n### Valve b\n#### deep door\n# Pump\n# Seal a"
    assert one(spark, X.heading_candidates(F.col("t")), t=heads) == ["Pump", "RH Passenger Door", "Valve b"]


def test_slugs(spark):
    assert one(spark, X.slugify(F.col("t")), t=" Starter  Air-Valve é! ") == "starter-air-valve-e"
    long = one(spark, X.slugify(F.col("t")), t="very long part name " * 12)
    assert len(long) <= 96 and long[-11] == "-" and long.startswith("very-long-part-name")
    assert len(one(spark, X.slugify(F.col("t"), None), t="very long part name " * 12)) > 96


def test_small_functions(spark):
    assert one(spark, X.result_identity(F.col("d"), F.col("c")), d="a/MODULE 4 AIRFRAME_page_1.pdf", c="z") == "module"
    assert one(spark, X.result_identity(F.col("d"), F.col("c")), d="x/Tech-Fuel.md", c="z") == "tech-fuel"
    assert one(spark, X.page_root(F.col("d")), d="m_page_12.pdf") == "m.pdf"
    assert one(spark, X.page_number(F.col("d")), d="m_page_12.pdf") == 12
    assert one(spark, X.int_or_zero(F.col("d")), d=" 12ab") == 12
    assert one(spark, X.int_or_zero(F.col("d")), d="ab") == 0
    assert one(spark, X.approx_bytes(F.col("d")), d="data:image/png;base64,QUJDRA==") == 6
    assert one(spark, X.js_trim(F.col("d")), d=" \t x ﻿") == "x"
    assert one(spark, X.title_case(F.col("d")), d="rh PASSENGER  door-frame") == "Rh Passenger Door-frame"
    assert one(spark, X.image_alt_texts(F.col("d")), d="![ a  b](x) ![](y) ![c](z)") == ["a b", "c"]
    assert one(spark, X.template("{{a}}-{{b}}-{{a}}", {"a": F.col("d"), "b": F.lit(None)}), d="q") == "q--q"
    assert one(spark, X.sorted_json(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.col("d"))), d="2") == '{"a":"2","b":"1"}'
    assert one(spark, X.article_body(F.col("d")), d="# T\n\nbody\n\n## Technical documents\n\n- x") == "body"


def test_descriptions(spark):
    put = corpus.with_descriptions(F.col("m"), F.col("c"))
    assert one(spark, put, m="a ![x](1) b ![y](2) c ![z](3)", c=["p", "q"]) == "a > Image description: p b > Image description: q c > Image description: q"
    assert one(spark, put, m="plain \n", c=["p", "q"]) == "plain\n\n> Image description: p\n\n> Image description: q"
    assert one(spark, F.when(F.lit(True), corpus.with_descriptions(F.col("m"), F.array().cast("array<string>"))), m="a ![x](1)") == "a ![x](1)"


def test_json_texts(spark):
    value = '{"component":"Oil pressure sensor","evidence":["label OIL PRESS","analog line"],"none":null}'
    assert one(spark, jsontext.flattened(F.col("t")), t=value) == "component: Oil pressure sensor; evidence: label OIL PRESS; analog line"
    assert one(spark, jsontext.partial(F.col("t"), "text"), t='{"label":"a","text":"be\\"gun \\u00e9 and \\u00') == 'be"gun é and '
    assert one(spark, jsontext.partial(F.col("t"), "text"), t='{"lab') is None
    assert one(spark, jsontext.repaired(F.col("t")), t='{"a":"x\ny"}') == '{"a":"x\\ny"}'
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"$ref": "#/defs/s"}, "b": {"anyOf": [{"type": "null"}, {"enum": [1, 2]}]}}, "additionalProperties": False, "defs": {"s": {"type": "string"}}}
    assert one(spark, jsontext.schema_violations(F.col("t"), schema), t='{"a":"x","b":null}') == []
    assert one(spark, jsontext.schema_violations(F.col("t"), schema), t='{"b":3,"c":1}') == ["$.a: missing", "$.b: 0 of anyOf fit", "$.c: unknown"]
    assert one(spark, jsontext.schema_violations(F.col("t"), schema), t="{") == ["$: not JSON"]


def test_rewrite(spark):
    q = spark.createDataFrame([(1, "electrostatic discharge reservoir tank right wing grounding electrical esd", "tech_docs")], "query_id int, query string, corpus string")
    got = [r.variant for r in rewrite.expand(q).orderBy("batch").collect()]
    assert len(got) == 4 and "ATA 28" in got[1] and got[2] == rewrite.ELECTRICAL_TEXT and got[3].endswith("right wing right main tank collector tank surge tank")
    assert [r.variant for r in rewrite.expand(q, rewrite=False).collect()] == [q.first().query]
