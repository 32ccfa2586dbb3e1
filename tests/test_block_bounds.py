"""Searches that score only blocks whose bound reaches the last place: ranks of scoring all, and how much is left out."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corvina.operators import lexical
from corvina.sources import segments

WEIGHTS = {"doc": 2.0, "text": 1.0}


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 2)
    monkeypatch.setattr(lexical, "SEEDS", 2)


def documents(spark, rng, n, longest=60):
    words = ["fuel", "fuelled", "fuels", "tank", "rivet", "pare", "brise", "été", "x1", "x12", "x123", "door", "frame", "naïve"]
    rows = [(i, rng.choice(words), " ".join(rng.choices(words, range(len(words), 0, -1), k=rng.randint(0, longest)))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, doc string, text string")


def asked(spark, rng, n):
    tokens = ["fu", "fuel", "tank", "ri", "ete", "x1", "x12", "do", "zz", "nai"]
    return spark.createDataFrame([(i, " ".join(rng.sample(tokens, rng.randint(1, 3)))) for i in range(n)], "query_id int, query string")


def ranks(found):
    return sorted((r.query_id, r.lexical_rank, r.id, round(r.bm25, 9), r.n_matched) for r in found.collect())


def same_ranks(index, queries, limit, mode, **more):
    got = ranks(lexical.search_index(index, queries, limit, mode, **more))
    assert index.blocks is not None and got == ranks(lexical.search_index(index._replace(blocks=None), queries, limit, mode, **more))
    return got


@pytest.mark.parametrize("mode", ["and", "or", "fallback"])
def test_ranks_of_scoring_all(spark, tmp_path, small_blocks, mode):
    rng, path = random.Random(21), str(tmp_path / "index")
    docs = documents(spark, rng, 300)
    # ids that rows of one length, and of several lengths, share
    docs = docs.unionByName(docs.filter("id % 9 = 0")).unionByName(docs.filter("id % 11 = 0").withColumn("text", F.concat_ws(" ", "text", "doc")))
    segments.write_index(docs, path, "id", WEIGHTS, bounded=True)
    index, queries = segments.read_index(spark, path), asked(spark, rng, 12)
    assert same_ranks(index, queries, 3, mode)
    few = docs.filter("id % 5 = 0").select("id").distinct().withColumn("newest", -F.col("id"))
    assert same_ranks(index, queries, 2, mode, keep=few, order=("newest",))


def test_ranks_after_an_update(spark, tmp_path, small_blocks):
    rng, path = random.Random(22), str(tmp_path / "index")
    docs = documents(spark, rng, 120)
    segments.write_index(docs, path, "id", WEIGHTS, bounded=True)
    now = docs.filter("id % 7 <> 0").withColumn("text", F.when(F.col("id") % 10 == 1, F.concat_ws(" ", F.lit("fuel tank"), "text")).otherwise(F.col("text")))
    segments.update_index(now, path, "id", WEIGHTS, bounded=True)
    index, queries = segments.read_index(spark, path), asked(spark, rng, 8)
    assert len(segments.manifest(spark, path)) == 2
    got = same_ranks(index, queries, 5, "fallback")
    segments.write_index(now, str(tmp_path / "fresh"), "id", WEIGHTS)
    assert got == ranks(lexical.search_index(segments.read_index(spark, str(tmp_path / "fresh")), queries, 5, "fallback"))


def test_counts_of_prefixes_need_no_posting(spark, small_blocks):
    """Every prefix's number of rows, from lcp alone, of terms that share long and non-ASCII beginnings too."""
    texts = ["ab abc abcd abd", "abc abcé abcèd", "abz", "x" * 5000 + " " + "x" * 5001, "", None, "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    index = lexical.indexed(docs, "id", {"text": 1.0}, bounded=True)
    tokens = ["ab", "abc", "abcd", "abce", "abd", "xx", "x" * 5000, "x" * 5001]
    queries = spark.createDataFrame(list(enumerate(tokens)), "query_id int, query string")
    bounds = lexical.bounds(index, queries).select("token", "idf").distinct().collect()
    holds = {t: sum(any(w.startswith(t) for w in (x or "").replace("é", "e").replace("è", "e").split()) for x in texts) for t in tokens}
    want = {t: max(math.log((len(texts) - n + 0.5) / (n + 0.5)), lexical.IDF_FLOOR) for t, n in holds.items()}
    assert dict(map(tuple, bounds)) == pytest.approx(want)


def test_common_prefixes_leave_most_blocks_out(spark, tmp_path, monkeypatch):
    rng, path = random.Random(23), str(tmp_path / "index")
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 4)
    segments.write_index(documents(spark, rng, 3000, 200), path, "id", WEIGHTS, bounded=True)
    index = segments.read_index(spark, path)
    queries = spark.createDataFrame([(1, "fu"), (2, "x1")], "query_id int, query string")
    every, read = lexical.bounds(index, queries).count(), lexical.picked_blocks(index, queries, 10, "or").count()
    assert read < every / 2
    same_ranks(index, queries, 10, "or")


def test_empty_index_and_queries(spark):
    index = lexical.indexed(spark.createDataFrame([], "id long, text string"), "id", {"text": 1.0}, bounded=True)
    some = spark.createDataFrame([(1, "fuel"), (2, None), (3, "")], "query_id int, query string")
    assert lexical.search_index(index, some).count() == 0
    full = lexical.indexed(spark.createDataFrame([(1, "fuel"), (2, None)], "id long, text string"), "id", {"text": 1.0}, bounded=True)
    assert [r.id for r in lexical.search_index(full, some).collect()] == [1]
    assert lexical.search_index(full, some.filter("false")).count() == 0


def test_tasks_count_tokens_of_bounded_texts(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TASK_BYTES", 1000)
    rows = spark.createDataFrame([(i, f"wörd{i} word" * 10) for i in range(200)], "id long, text string")
    n_bytes = sum(len((f"wörd{i} word" * 10).encode()) for i in range(200))
    found = lexical.postings(rows, "id", {"text": 1.0})
    assert found.rdd.getNumPartitions() == -(-n_bytes // 1000)
    assert {r.term: r.n for r in found.filter("id = 7").collect()} == {"word7": 1, "wordword7": 9, "word": 1}
    assert lexical.tasks(rows.limit(0), ["text"]) == 1


def test_few_tokens_meet_postings_where_these_are_read(spark):
    rows = spark.createDataFrame([(i, "the thing and then") for i in range(20)], "id long, text string")
    asked = spark.createDataFrame([(1, "th the"), (2, "none")], "query_id int, query string")
    found = lexical.search_index(lexical.indexed(rows, "id", {"text": 1.0}), asked)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.query_id, r.id, r.n_matched) for r in found.orderBy("lexical_rank").collect()] == [(1, i, 2) for i in range(10)]


def test_tokens_are_cut_once(spark):
    """Not where rows are read as well, for a filter that Spark infers: texts are dealt first."""
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id long, text string")
    found = lexical.postings(rows, "id", {"text": 1.0})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and "regexp_extract_all" not in plan[plan.index("Repartition") :]
    assert sorted((r.id, r.term) for r in found.collect()) == [(1, "a"), (1, "b")]
