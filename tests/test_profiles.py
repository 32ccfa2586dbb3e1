"""Routing profiles, the caption cascade, batches, replies and entity labels."""

import json

from pyspark.sql import functions as F

from corvina.operators import payloads, profiles


def test_profiles(spark):
    many = [{"label": f"e{i}", "type": "valve" if i else "odd", "evidence": "seen" if i == 1 else ""} for i in range(9)] + [{"type": "part"}]
    related = [{"source": "a", "relation": "feeds", "target": "b"}] * 5 + [{"source": "a"}]
    full = {"page_category": "technical_diagram", "routing_profile_v1": {"visual_content_type": "cockpit_panel_or_display", "domain_candidates": ["flight_controls", "odd", "none"], "rag_signal": {"ocr_markdown_sufficient": "true", "retrieval_terms": [" a  b ", ""]}, "wiki_signal": {"has_entity_relationships": True, "entity_candidates": many, "relationship_candidates": related}}}
    bare = {"routing_profile_v1": {"visual_content_type": "cover_page"}}
    rows = spark.createDataFrame([("full", json.dumps(full)), ("bare", json.dumps(bare)), ("old", json.dumps({"page_category": "technical_photo"})), ("none", "{}")], "doc string, v string")
    got = {r.doc: r for r in profiles.routed(profiles.profiles(rows, "doc", "v")).collect()}
    f = got["full"]
    assert (len(f.entity_candidates), len(f.relationship_candidates), f.domain_candidates, f.retrieval_terms, f.ocr_markdown_sufficient) == (9, 5, ["flight_controls", "unknown"], ["a b"], True)
    assert f.entity_candidates[0].type == "other" and f.route == "gpt-5.4" and f.short_summary == "cockpit panel or display: a b."
    assert "e1 (valve, seen)" in f.technical_description and "a feeds b" in f.technical_description
    assert (got["bare"].page_category, got["bare"].is_non_content_page, got["bare"].route, got["bare"].page_category_confidence) == ("cover_page", True, "nano", 0.75)
    assert (got["old"].visual_content_type, got["old"].domain_candidates) == ("technical_photo", ["unknown"])
    assert got["none"].page_category == "technical_procedure"


def test_cascade(spark):
    rows = [("a", "nano", "l", None, None, None), ("b", "gpt-5.4", "l", None, "d", None), ("c", "gpt-5.4", "l", None, None, "broke"), ("d", None, None, "broke", "d", None)]
    got = {r.doc: (r.selected, r.trigger) for r in profiles.cascade(spark.createDataFrame(rows, "doc string, route string, light string, light_error string, deep string, deep_error string")).collect()}
    assert got == {"a": ("l", "nano_route"), "b": ("d", "routing_deep_pass"), "c": ("l", "deep_pass_failed_fallback_to_nano"), "d": ("d", "technical_retry")}


def test_batches(spark):
    pages = spark.createDataFrame([("m 1_page_1.pdf", "x", ["data:a"]), ("m_page_2.pdf", "y", []), ("m_page_3.pdf", "z", ["data:b"])], "doc string, markdown string, images array<string>")
    done = spark.createDataFrame([("m_page_3.pdf",)], "doc string")
    audits = spark.createDataFrame([("m_page_3.pdf", "gpt-5.4", "gpt-5.4-nano"), ("m_page_2.pdf", "nano", "gpt-5.4-nano")], "doc string, route string, model string")
    asked = profiles.requests(profiles.pending(pages, done, audits, "primary"), "primary", "m", 10)
    assert [(r.custom_id, r.doc, json.loads(r.line)["body"]["markdown"]) for r in asked.collect()] == [("primary:m-1_page_1", "m 1_page_1.pdf", "x")]
    assert [r.doc for r in profiles.pending(pages, done, audits, "deep").collect()] == ["m_page_3.pdf"]
    assert profiles.pending(pages, done, audits, "primary", force=True).count() == 3
    line = lambda i, status, body="b", error=None: json.dumps({"custom_id": i, "response": {"status_code": status, "body": body}, "error": error})
    lines = spark.createDataFrame([(line("primary:m-1_page_1", 200),), (line("primary:m-1_page_1", 500),), (line("x", 200),), (line("primary:m-1_page_1", 200, error={"code": "late"}),), ("",)], "value string")
    got = {(r.text, r.failure) for r in profiles.results(lines, asked).collect()}
    assert got == {("b", None), (None, "m 1_page_1.pdf: response status 500"), (None, "Unknown custom_id: x"), (None, "m 1_page_1.pdf: late")}
    assert profiles.latest(spark.createDataFrame([("a", 2), ("b", 2), ("c", 1)], "path string, modificationTime int")).first().path == "b"


def test_payloads(spark):
    replies = ['{"label":"L","description":{"a":1}}', '{"comment":"c","label":"L"}', "plain", '{"x":1}', '{"description":"d"}', "[1]"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string").withColumn("p", payloads.final_payload(F.col("r")))
    got = {r.i: tuple(r.p) for r in df.collect()}
    assert got == {0: (None, "L", '{"a":1}'), 1: ("c", "L", None), 2: ("plain", None, None), 3: ('{"x":1}', None, None), 4: (None, None, "d"), 5: ("[1]", None, None)}
    assert {r.i for r in df.filter(payloads.needs_repair(F.lit(True), F.col("p"))).collect()} == {2, 3, 5}
    s = spark.createDataFrame([((["a"], [], ["w"]),), ((["a"], None, None),)], "s struct<tech_docs:array<string>,non_conformities:array<string>,entities_wiki:array<string>>")
    assert [[g.name for g in r.g] for r in s.select(payloads.source_groups(F.col("s")).alias("g")).collect()] == [["tech_docs", "entities_wiki"], ["tech_docs"]]
    assert [r.u is None for r in s.select(payloads.usable_sources(F.col("s")).alias("u")).collect()] == [False, True]
    h = spark.createDataFrame([({"000": 1, "100": 2, "200": 3},)], "h map<string,int>")
    assert h.select(payloads.earlier_tasks(F.col("h"), F.lit("200")).alias("x")).first().x == {"000": 1, "100": 2}
    e = spark.createDataFrame([("validated_output", " s ", None, None), ("validated_output", None, "r", False), ("validated_output", None, " ", None), ("note", "s", None, None), (None, "s", None, None)], "type string, summary string, response_text string, validated boolean")
    assert [r.summary for r in payloads.episodes(e).collect()] == ["s"]
    v = spark.createDataFrame([(["a", "b"], ["b", "c"], ["x", "y"])], "r array<string>, m array<string>, h array<string>")
    assert v.select(payloads.merged_variants(F.col("r"), F.col("m"), F.col("h")).alias("x")).first().x == ["a", "b", "c", "x y"]
    assert payloads.cautious(spark.createDataFrame([("q", "100", None, "d")], "user_message string, role string, label string, description string")).first().text.startswith("Low-confidence")


def test_entity_labels(spark):
    row = spark.createDataFrame([(" ", "d.md", "c", ["x", "y"], "z", [("p", "d", "1"), ("p", "d", "2"), (None, "d", "3"), (None, None, "4")], ["ATA-1"], ["aft", "RH", "LH"], ["a", "b", "c"])], "title string, doc string, chunk_id string, docs array<string>, primary string, images array<struct<asset_path:string,doc:string,id:string>>, ata array<string>, zones array<string>, aliases array<string>")
    cols = payloads.entity_labels(*[F.col(c) for c in ("title", "doc", "chunk_id", "docs", "primary", "images", "ata", "zones", "aliases")])
    assert row.select(*[c.alias(n) for n, c in cols.items()]).first().asDict() == {"title": "d.md", "meta": "ATA-1 / Zone aft / Zone RH", "alias": "a, b +1", "docs_label": "3 docs", "images_label": "2 images", "aria_label": "Open entity d.md"}
    e = spark.createDataFrame([(1, "a", 0, False), (1, "b", 1, True), (2, "a", 0, False), (3, "a", 0, True), (3, "q", 5, False)], "g int, k string, pos int, img boolean")
    assert {r.g: r.selected for r in payloads.selected_entity(e, "g", "k", "pos", F.lit("q"), F.col("img")).collect()} == {1: "b", 2: "a", 3: "q"}
