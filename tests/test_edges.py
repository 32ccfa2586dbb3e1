"""Empty tables, null keys and texts, and columns of other names do not crash the operators of the library."""

import pytest
from pyspark.sql import functions as F

from corvina.operators import corpus, evaluation, fusion, joins, lexical, memory, ocr, ontology, payloads, profiles, routing, vector
from corvina.plans import hybrid
from corvina.streaming import events

RANKED = "query_id int, batch int, channel string, rank int, identity string, content string"
RANKED_ROWS = [(1, 0, "lexical", 1, "a", "x"), (1, 0, "vector", 2, None, None), (None, 0, "lexical", 1, "a", ""), (1, 1, "vector", 1, "a", "xx")]
RECORDS = "row_idx long, doc string, chunk_id string, content string, ata string, parts string, other string"
RECORD_ROWS = [(1, "d", "c", "ATA 28 door in the RH zone", "28", "fuel door", "z"), (2, None, None, None, None, None, None), (3, "", "", "", "", ";,|", "")]
EPISODES = "episode_id string, case_ref string, label string, summary string, corrections string, validated boolean, supersedes string, updated_at int, created int"
EPISODE_ROWS = [("a", "r", "l", "fuel", None, True, None, 1, 1), ("b", None, None, None, None, None, "a", 2, 2), (None, "r", "l", "fuel", "", True, None, None, None)]
IMAGES = "id string, doc string, caption string, technical_description string, part_or_zone_candidates array<string>, visible_identifiers array<string>, figure_or_table_refs array<string>, relationships_or_flows array<string>"
IMAGE_ROWS = [("i", "d", "fuel door", None, ["fuel door"], None, [], []), ("j", None, None, None, None, None, None, None)]
VECTORS = "id long, embedding array<float>"
VECTOR_ROWS = [(1, [1.0, 0.0]), (2, None), (None, [0.0, 1.0]), (3, [float("nan"), 1.0])]
QUERIES = "query_id int, query string, corpus string"
QUERY_ROWS = [(1, "fuel door", "tech_docs"), (2, "", "tech_docs"), (3, None, None)]
TEXTS = "id long, name string, text string, n int"
TEXT_ROWS = [(1, "a.md", "fuel fuel door", 1), (2, None, None, None), (None, "", "", 0)]

CASES = {
    "fuse_batches": (RANKED, RANKED_ROWS, lambda t, q: fusion.fuse_batches(t)),
    "fuse_channels": (RANKED, RANKED_ROWS, lambda t, q: fusion.fuse_channels(t)),
    "merged_payload": (RANKED, RANKED_ROWS, lambda t, q: fusion.merged_payload(t, ["channel"], ["batch", "rank"], "content")),
    "union_distinct": (RANKED, RANKED_ROWS, lambda t, q: fusion.union_distinct(t, t, "identity", "rank")),
    "candidates": (RECORDS, RECORD_ROWS, lambda t, q: ontology.candidates(t)),
    "parts": (RECORDS, RECORD_ROWS, lambda t, q: ontology.parts(ontology.candidates(t))),
    "relations": (RECORDS, RECORD_ROWS, lambda t, q: ontology.relations(ontology.parts(ontology.candidates(t)))),
    "occurrences": (RECORDS, RECORD_ROWS, lambda t, q: ontology.occurrences(t)),
    "drop_reasons": (RECORDS, RECORD_ROWS, lambda t, q: corpus.drop_reasons(t, t.select("doc"), F.lit(None).cast("string"), F.col("content").isNull())),
    "content_hashes": (RECORDS, RECORD_ROWS, lambda t, q: corpus.content_hashes(t, "doc", "row_idx", "content")),
    "fingerprint": (RECORDS, RECORD_ROWS, lambda t, q: corpus.fingerprint(t, ["doc", "content"], "row_idx").filter("n_rows > 0")),
    "chunks": (RECORDS, RECORD_ROWS, lambda t, q: corpus.chunks(t, "doc", "content")),
    "event_records": (RECORDS, RECORD_ROWS, lambda t, q: corpus.event_records(t.withColumn("chunk", F.col("content")), dedupe=True)),
    "neighbours": (RECORDS, RECORD_ROWS, lambda t, q: ontology.neighbours(t, ["ata", "other"], "doc", "content")),
    "image_relations": (IMAGES, IMAGE_ROWS, lambda t, q: ontology.image_relations(t, t.select(F.col("doc").alias("slug"), F.col("caption").alias("canonical_name"), F.array("caption").alias("aliases"), F.array("doc").alias("supporting_docs")))),
    "last_turns": (TEXTS, TEXT_ROWS, lambda t, q: memory.last_turns(t, "name", ["id"], ["id", "text"])),
    "upsert": (EPISODES, EPISODE_ROWS, lambda t, q: memory.upsert(t, "episode_id", ["updated_at"], "created")),
    "supersede": (EPISODES, EPISODE_ROWS, lambda t, q: memory.supersede(t, "episode_id", "supersedes")),
    "episodic_search": (EPISODES, EPISODE_ROWS, lambda t, q: memory.search(memory.supersede(t, "episode_id", "supersedes"), q.select("query_id", "query"))),
    "lexical_search": (TEXTS, TEXT_ROWS, lambda t, q: lexical.search(t, q, "id", {"name": 2.0, "text": 1.0})),
    "keyword_scores": (TEXTS, TEXT_ROWS, lambda t, q: lexical.keyword_scores(t, q, "id", "name", "text")),
    "hybrid": (TEXTS, TEXT_ROWS, lambda t, q: hybrid.search(q.filter("query IS NOT NULL"), t, "id", {"name": 2.0, "text": 1.0})),
    "knn": (VECTORS, VECTOR_ROWS, lambda t, q: vector.knn(t, t.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector")), "id")),
    "stratified_sample": (TEXTS, TEXT_ROWS, lambda t, q: evaluation.stratified_sample(t.withColumn("stratum", F.coalesce("name", F.lit("x"))), "id", "id", 4)),
    "summary": (RANKED, RANKED_ROWS, lambda t, q: evaluation.summary(evaluation.hits(t.withColumn("case_id", F.col("query_id")), (1, 5), F.col("identity") == "a"), (1, 5))),
    "markdown_report": (TEXTS, TEXT_ROWS, lambda t, q: evaluation.markdown_report("t", t, ["id", "name"]).filter("pos > 3")),
    "review_counts": (TEXTS, TEXT_ROWS, lambda t, q: routing.review_counts(t, ["name", "n"])),
    "unfinished": (TEXTS, TEXT_ROWS, lambda t, q: routing.unfinished(t, t.filter("id = 1"), ["id"])),
    "profiles": (TEXTS, TEXT_ROWS, lambda t, q: profiles.profiles(t, "id", "text")),
    "captions": (TEXTS, TEXT_ROWS, lambda t, q: ocr.captions(t.withColumn("v", F.lit("{}")), "id", "v")),
    "documents": (TEXTS, TEXT_ROWS, lambda t, q: ocr.parse_documents(t, "id", "text")),
    "episodes": (EPISODES, EPISODE_ROWS, lambda t, q: payloads.episodes(t.withColumn("type", F.lit("validated_output")).withColumn("response_text", F.col("label")))),
    "lookup": (TEXTS, TEXT_ROWS, lambda t, q: joins.lookup_in_order(t, "id", t.select(F.col("n").alias("pos"), "id"))),
    "first_of_key": (TEXTS, TEXT_ROWS, lambda t, q: joins.first_of_key(t.drop("n"), "name", "id")),
    "framed": (TEXTS, TEXT_ROWS, lambda t, q: events.framed(t.withColumn("data", F.lit("data: x\n\n")), "id", "n", "data")),
    "line_events": (TEXTS, TEXT_ROWS, lambda t, q: events.line_events(t.filter("text IS NOT NULL"), "id", "text")),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_empty_and_null(spark, name):
    schema, rows, run = CASES[name]
    q = spark.createDataFrame(QUERY_ROWS, QUERIES)
    table = spark.createDataFrame(rows, schema)
    assert run(table.limit(0), q).count() == 0
    once = sorted(map(str, run(table, q).collect()))
    assert once or name in {"neighbours", "relations", "episodic_search"}  # the one live episode there has no id
    wide = table.withColumn("Extra.name", F.lit(1)).withColumn("zz", F.lit(None).cast("string"))
    assert len(run(wide, q).collect()) == len(once)
