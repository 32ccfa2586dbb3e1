"""How far the retrieved rows support an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
NO_RESULTS, WEAK, CROSS, PARTIAL = "no retrieval results", "results are sparse and weakly supported", "multiple results are cross-supported", "some support exists but remains partial"


def signal(channels: Column, distance: Column, rrf: Column, explicit: Column) -> Column:
    """0 to 4: 2 for a lexical hit, 1 for a vector hit within distance 1, 1 for an RRF of 0.03; 2 for rows without any score."""
    points = (
        F.when(F.array_contains(channels, "lexical"), 2).otherwise(0)
        + F.when(F.array_contains(channels, "vector") & (distance <= 1.0), 1).otherwise(0)
        + F.when(rrf >= 0.03, 1).otherwise(0)
    )
    return F.when(explicit, points).otherwise(2)


def level(signals: Column) -> Column:
    best, good = F.array_max(signals), F.size(F.filter(signals, lambda s: s >= 2))
    none = F.coalesce(F.size(signals), F.lit(0)) <= 0
    return (
        F.when(none, F.struct(F.lit("low").alias("level"), F.lit(NO_RESULTS).alias("reason")))
        .when((best <= 1) & (good == 0), F.struct(F.lit("low").alias("level"), F.lit(WEAK).alias("reason")))
        .when((best >= 3) & (good >= 2), F.struct(F.lit("high").alias("level"), F.lit(CROSS).alias("reason")))
        .otherwise(F.struct(F.lit("medium").alias("level"), F.lit(PARTIAL).alias("reason")))
    )


def assess(queries: DataFrame, rows: DataFrame, sample: int = 3) -> DataFrame:
    """query_id, signals, level and reason from the first rows (query_id, corpus, rank, signal) of each corpus."""
    top = rows.filter(F.col("rank") <= sample).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("corpus", "rank", "signal"))).alias("s"))
    signals = F.coalesce(F.transform("s", lambda x: x["signal"]), F.array().cast("array<int>"))
    joined = queries.select("query_id").join(top, "query_id", "left").withColumn("signals", signals)
    return joined.select("query_id", "signals", level(F.col("signals")).alias("l")).select("query_id", "signals", "l.level", "l.reason")
