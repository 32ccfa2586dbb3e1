"""Hybrid retrieval as one lazy plan: expansion, two channels, two levels of fusion, confidence."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.functions.text import query_tokens
from corvina.operators import confidence, evaluation, fusion, lexical, ontology, rewrite, vector

MAX_FINAL, MIN_CANDIDATES = 10, 15
WIKI = "entities_wiki"


def limits(final: int, candidates: int) -> tuple[int, int]:
    final = min(max(final, 1), MAX_FINAL)
    return final, max(final, candidates, MIN_CANDIDATES)


def search(queries: DataFrame, rows: DataFrame | lexical.Index, id_: str = "", weights: dict[str, float] | None = None, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, final: int = 10, candidates: int = 15, expand: bool = True) -> DataFrame:
    """query_id, identity, retrieval_channels, rrf_score, best_rank, retrieval_rank and vector_distance.

    queries: (query_id, query, corpus). rows: a written index, or rows with the id and the weighted fields. vectors: (id, embedding) of the rows, query_vectors: (query_id, batch,
    query_vector); without them the vector channel is empty, which is no error.
    """
    final, candidates = limits(final, candidates)
    variants = rewrite.expand(queries, expand)
    asked = variants.select(F.struct("query_id", "batch").alias("query_id"), F.col("variant").alias("query"))
    index = rows if isinstance(rows, lexical.Index) else lexical.indexed(rows, id_, weights)
    found = lexical.search_index(index, asked, candidates)
    lex = fusion.fuse_batches(found.select("query_id.query_id", "query_id.batch", F.col("lexical_rank").alias("rank"), F.col("id").alias("identity")), candidates)
    both = lex.select("query_id", F.lit("lexical").alias("channel"), "rank", "identity")
    distance = None
    if vectors is not None and query_vectors is not None:
        named = query_vectors.select(F.struct("query_id", "batch").alias("query_id"), "query_vector")
        near = vector.knn(vectors, named, "id", "embedding", candidates)
        near = near.select("query_id.query_id", "query_id.batch", F.col("vector_rank").alias("rank"), F.col("id").alias("identity"), "distance")
        vec = fusion.fuse_batches(near, candidates)
        both = both.unionByName(vec.select("query_id", F.lit("vector").alias("channel"), "rank", "identity"))
        distance = near.groupBy("query_id", "identity").agg(F.min_by("distance", F.struct("batch", "rank")).alias("vector_distance"))
    fused = fusion.fuse_channels(both, final)
    if distance is None:
        return fused.withColumn("vector_distance", F.lit(None).cast("double"))
    return fused.join(distance, ["query_id", "identity"], "left")


def with_confidence(queries: DataFrame, *results: tuple[str, DataFrame]) -> DataFrame:
    """The level of support of each query by the first results of each corpus."""
    rows = None
    for corpus, found in results:
        s = confidence.signal(F.col("retrieval_channels"), F.col("vector_distance"), F.col("rrf_score"), F.lit(True))
        part = found.select("query_id", F.lit(corpus).alias("corpus"), F.col("retrieval_rank").alias("rank"), s.alias("signal"))
        rows = part if rows is None else rows.unionByName(part)
    return confidence.assess(queries, rows)


class Source(NamedTuple):
    """A corpus: its index, its vectors (id, embedding) and those of the query's variants (query_id, batch, query_vector)."""

    corpus: str
    index: lexical.Index
    vectors: DataFrame | None = None
    query_vectors: DataFrame | None = None


def search_corpus(queries: DataFrame, source: Source, final: int = MAX_FINAL, candidates: int = MIN_CANDIDATES, expand: bool = True) -> DataFrame:
    """search() of one corpus for queries (query_id, query)."""
    named = queries.withColumn("corpus", F.lit(source.corpus))
    return search(named, source.index, vectors=source.vectors, query_vectors=source.query_vectors, final=final, candidates=candidates, expand=expand)


def three_sources(queries: DataFrame, tech: Source, events: Source, wiki: DataFrame, expand: bool = True) -> tuple[DataFrame, DataFrame]:
    """What all three sources find for queries (query_id, query), and how each was searched.

    Found: source, query_id, identity, rank, score, channels. wiki: entries (slug, title, metadata). Searched: source,
    query_id, vector_enabled, ready, variants (of the wiki: the query's tokens).
    """
    found, searched = [], []
    for s in (tech, events):
        got = search_corpus(queries, s, expand=expand)
        found.append(got.select(F.lit(s.corpus).alias("source"), "query_id", F.col("identity").cast("string").alias("identity"), F.col("retrieval_rank").alias("rank"), F.col("rrf_score").alias("score"), F.array_join("retrieval_channels", ",").alias("channels")))
        variants = rewrite.expand(queries.withColumn("corpus", F.lit(s.corpus)), expand).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("batch", "variant"))), lambda x: x["variant"]).alias("variants"))
        searched.append(variants.select(F.lit(s.corpus).alias("source"), "query_id", F.lit(s.vectors is not None and s.query_vectors is not None).alias("vector_enabled"), F.lit(True).alias("ready"), "variants"))
    pages = ontology.entity_search(wiki, queries, F.col("title"), F.col("metadata"), "slug", "title")
    found.append(pages.select(F.lit(WIKI).alias("source"), "query_id", F.col("id").cast("string").alias("identity"), F.col("wiki_rank").alias("rank"), F.col("score").cast("double").alias("score"), F.lit("wiki").alias("channels")))
    searched.append(queries.select(F.lit(WIKI).alias("source"), "query_id", F.lit(False).alias("vector_enabled"), F.lit(not wiki.isEmpty()).alias("ready"), query_tokens(F.col("query")).alias("variants")))
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, searched)


def arms(queries: DataFrame, source: Source, relevant: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """arm, corpus, k, hits, total and ratio of three ways to search: vectors alone, both channels, and both after rewriting.

    relevant (query_id, identity): what counts as a hit; every query counts, also one that finds nothing.
    """
    first = source.query_vectors.filter("batch = 0").drop("batch")
    near = vector.knn(source.vectors, first, "id", "embedding", max(ks)).select("query_id", F.col("id").alias("identity"), F.col("vector_rank").alias("rank"))
    runs = {"vector": near}
    for name, expand in (("rrf", False), ("rewritten", True)):
        runs[name] = search_corpus(queries, source, max(ks), expand=expand).select("query_id", "identity", F.col("retrieval_rank").alias("rank"))
    rows = reduce(DataFrame.unionByName, [df.withColumn("arm", F.lit(n)) for n, df in runs.items()])
    hit = relevant.select("query_id", "identity").distinct().withColumn("hit", F.lit(True))
    ranked = rows.join(hit, ["query_id", "identity"], "left").select("arm", "query_id", "rank", F.coalesce("hit", F.lit(False)).alias("hit"))
    every = queries.select("query_id", F.explode(F.array(*map(F.lit, runs))).alias("arm"))
    cases = every.join(ranked, ["arm", "query_id"], "left").withColumn("case_id", F.struct("arm", "query_id"))
    found = evaluation.hits(cases, ks, F.coalesce("hit", F.lit(False))).select("case_id.arm", *[f"hit_{k}" for k in ks])
    return evaluation.summary(found, ks, "arm").withColumn("corpus", F.lit(source.corpus))
