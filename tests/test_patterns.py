"""Multi-pattern matching against plain substring tests, in one automaton, in several, and by joins of pieces."""

import random

import pytest

from corvina.operators import patterns

SIZES = [{}, {"shard_bytes": 64}, {"shard_bytes": 8, "most_shards": 0}]


def plain(texts, wanted):
    return {(i, p) for i, t in texts for p in wanted if t is not None and p is not None and p in t}


def run(spark, texts, wanted, sizes):
    got = patterns.holding(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(p,) for p in wanted], "pattern string"), **sizes)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("sizes", SIZES)
def test_random_texts(spark, sizes):
    """Nested and overlapping patterns over a small alphabet, repeated patterns and texts."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    texts = [(i % 40, word(rng.randint(0, 60))) for i in range(80)]
    wanted = [word(rng.randint(1, 9)) for _ in range(60)]
    want = plain(texts, wanted)
    assert run(spark, texts, wanted + wanted[:5], sizes) == want and len(want) > 300


@pytest.mark.parametrize("sizes", SIZES)
def test_edges(spark, sizes):
    """Null and empty texts and patterns, letters beyond the first plane, a pattern longer than its text, a very long text."""
    texts = [(1, None), (2, ""), (3, "a😀b 李明"), (4, "x" * 500_000 + "needle"), (5, "need")]
    wanted = [None, "", "😀", "李明", "李明 ", "needle", "eed", "xx", "zz"]
    assert run(spark, texts, wanted, sizes) == plain(texts, wanted)


@pytest.mark.parametrize("sizes", SIZES)
def test_nothing(spark, sizes):
    assert run(spark, [], ["a"], sizes) == set() and run(spark, [(1, "a")], [], sizes) == set() and run(spark, [(1, "a")], [None], sizes) == set()


def test_no_join_of_pieces(spark):
    """With few patterns the texts are not shuffled: rows that leave the scan are hits."""
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "id long, text string")
    plan = patterns.holding(texts, texts.limit(3).selectExpr("text AS pattern"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Generate" not in plan


def test_keys_of_one_pattern(spark):
    texts = spark.createDataFrame([(1, "door frame"), (2, "frame")], "id long, text string")
    named = spark.createDataFrame([("p", "frame"), ("q", "frame"), ("q", "door"), ("r", None)], "key string, pattern string")
    assert sorted(tuple(r) for r in patterns.keyed(texts, named).collect()) == [(1, "p"), (1, "q"), (2, "p"), (2, "q")]
