"""Reciprocal-rank fusion in two levels: over the variants of one channel, then over channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions.text import in_locale

K = 60


def _by_identity(rows: DataFrame) -> list:
    """The last sort key: names in locale order, numbers as they are."""
    return in_locale("identity") if rows.schema["identity"].dataType.typeName() == "string" else [F.col("identity")]


def fuse_batches(rows: DataFrame, limit: int = 15, k: int = K) -> DataFrame:
    """One channel's rows (query_id, batch, rank, identity) as query_id, identity, rrf, best_rank, variant_hits and rank.

    Several rows of one identity in a batch each count; nothing is deduplicated before the sum.
    """
    fused = rows.groupBy("query_id", "identity").agg(
        F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("rrf"), F.min("rank").alias("best_rank"), F.count_distinct("batch").alias("variant_hits")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 12)), "best_rank", *_by_identity(fused))
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def fuse_channels(rows: DataFrame, limit: int = 10, k: int = K) -> DataFrame:
    """Rows (query_id, channel, rank, identity) of all channels as rrf_score, retrieval_channels and retrieval_rank."""
    fused = rows.groupBy("query_id", "identity").agg(
        F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("raw"), F.min("rank").alias("best_rank"), F.array_sort(F.collect_set("channel")).alias("retrieval_channels")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("raw", 12)), "best_rank", *_by_identity(fused))
    ranked = fused.withColumn("retrieval_rank", F.row_number().over(order)).filter(F.col("retrieval_rank") <= limit)
    return ranked.withColumn("rrf_score", F.round("raw", 8)).drop("raw")


def merged_payload(rows: DataFrame, columns: list[str], order: list[str], content: str | None = None) -> DataFrame:
    """Per (query_id, identity) the first value of each column that is not null or empty, and the longest content."""
    at = F.struct(*order)
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), at)).alias(c) for c in columns]
    longest = [F.min_by(content, F.struct(-F.length(content), *order)).alias(content)] if content else []
    return rows.groupBy("query_id", "identity").agg(*firsts, *longest)


def union_distinct(first: DataFrame, second: DataFrame, identity: str, position: str) -> DataFrame:
    """Rows of first, then those of second, each identity once at its first place."""
    both = first.withColumn("_source", F.lit(0)).unionByName(second.withColumn("_source", F.lit(1)))
    once = Window.partitionBy(identity).orderBy("_source", position)
    return both.withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n").withColumnRenamed("_source", "source_order")
