"""Many patterns in many texts: which texts hold which patterns, by Aho-Corasick automata in the tasks that read the texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of the patterns of one automaton; its nodes take some sixty times that in each Python worker.
SHARD_BYTES = 1 << 20
#: Automata that are broadcast, each for a pass of its own over the texts; more patterns meet texts by their rarest piece.
MOST_SHARDS = 16
#: Letters of a piece.
PIECE = 3


def grams(x: Column, n: int) -> Column:
    """All substrings of n letters, each once; in time linear in the text, as each shift's pieces are one regular expression's matches."""
    shifted = [F.regexp_extract_all(F.substring(x, F.lit(k + 1), F.length(x)), F.lit(f"(?s).{{{n}}}"), F.lit(0)) for k in range(n)]
    return F.array_distinct(F.concat(*shifted))


def holding(texts: DataFrame, patterns: DataFrame, shard_bytes: int = SHARD_BYTES, most_shards: int = MOST_SHARDS) -> DataFrame:
    """id and pattern: each distinct pattern that is a substring of some text of id; texts (id, text), patterns (pattern).

    Exact and case-sensitive: fold both sides first where case does not matter. Null texts and patterns hold and match
    nothing; the empty pattern is in every text; repeated patterns, and texts of one id, count once. The patterns' counted
    bytes decide how they meet: up to most_shards automata of shard_bytes are broadcast and the texts are read once for
    each, in Arrow batches and without a shuffle until rows are made distinct; beyond that, texts and patterns are joined
    by pieces. Both give the same rows.
    """
    texts, distinct = texts.filter("text IS NOT NULL").select("id", "text"), patterns.filter("pattern IS NOT NULL").select("pattern").distinct()
    n_bytes = distinct.agg(F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-(n_bytes[0] + 8 * n_bytes[1]) // shard_bytes))
    if shards > most_shards:
        return by_pieces(texts, distinct)
    out = None
    for i in range(shards):
        own = [r[0] for r in distinct.filter(F.pmod(F.xxhash64("pattern"), F.lit(shards)) == i).collect()]  # some shard_bytes
        found = _scan(texts, own)
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def _scan(texts: DataFrame, patterns: list[str]) -> DataFrame:
    """id and pattern of the texts that hold one of patterns, which are broadcast."""
    out = texts.select("id", F.col("text").alias("pattern"))
    if not patterns:
        return out.limit(0)
    sent = texts.sparkSession.sparkContext.broadcast(patterns)

    def run(batches):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for p in sent.value:
            if p:
                machine.add_word(p, p)
        everywhere = [p for p in sent.value if not p]
        some = len(machine) > 0
        if some:
            machine.make_automaton()
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column("text")):
                held = {p for _, p in machine.iter(text.as_py())} if some else set()
                held.update(everywhere)
                at += [i] * len(held)
                found += held
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), pa.array(found, pa.string())], ["id", "pattern"])

    return texts.mapInArrow(run, out.schema)


def by_pieces(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """What holding() gives, by joins: a text that holds a pattern holds all its pieces, so each pattern meets texts by its rarest.

    Patterns shorter than a piece meet texts by themselves, as pieces of their length.
    """
    texts = texts.withColumn("_row", F.xxhash64("id", "text"))
    pieces = F.concat(F.array(F.lit("")), *[grams(F.col("text"), n) for n in range(1, PIECE + 1)])
    held = texts.select("_row", "id", F.explode(pieces).alias("g"))
    counts = held.groupBy("g").agg(F.count("*").alias("n"))
    own = F.when(F.length("pattern") < PIECE, F.array("pattern")).otherwise(grams(F.col("pattern"), PIECE))
    each = patterns.select("pattern", F.explode(own).alias("g")).join(counts, "g", "left").groupBy("pattern")
    rarest = each.agg(F.min_by("g", F.struct("n", "g")).alias("g"), F.bool_and(F.col("n").isNotNull()).alias("whole")).filter("whole")
    near = rarest.select("pattern", "g").join(held.select("g", "_row", "id"), "g").select("_row", "id", "pattern")
    return near.join(texts.select("_row", "id", "text"), ["_row", "id"]).filter(F.contains("text", F.col("pattern"))).select("id", "pattern").distinct()


def keyed(texts: DataFrame, named: DataFrame, **sizes) -> DataFrame:
    """id and key of texts (id, text) that hold a pattern of key; named: (key, pattern)."""
    return holding(texts, named, **sizes).join(named.distinct(), "pattern").select("id", "key").distinct()
