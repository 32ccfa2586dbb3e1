"""Retrieval quality (hit at k) and deterministic stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions.text import fold, markdown_row

STRATA = ("small", "medium", "large", "multi")


def hits(ranked: DataFrame, ks: tuple[int, ...], relevant: Column) -> DataFrame:
    """case_id and a 0/1 column hit_k for every k, over ranked rows (case_id, rank)."""
    return ranked.groupBy("case_id").agg(*[F.max(F.when((F.col("rank") <= k) & relevant, 1).otherwise(0)).alias(f"hit_{k}") for k in ks])


def starts_with_any(name: Column, prefixes: Column) -> Column:
    """Whether the folded name starts with one of the folded prefixes."""
    return F.exists(prefixes, lambda p: F.startswith(fold(name), fold(p)))


def summary(cases: DataFrame, ks: tuple[int, ...], *by: str) -> DataFrame:
    """hits, total and ratio (3 decimals) of every k."""
    rows = cases.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"hit_{k}").alias("hit")) for k in ks])).alias("x"))
    return rows.groupBy(*by, F.col("x.k").alias("k")).agg(F.sum("x.hit").alias("hits"), F.count("*").alias("total"), F.round(F.avg("x.hit"), 3).alias("ratio"))


def stratum(n_images: Column, size: Column, small: int = 75_000, medium: int = 160_000) -> Column:
    return F.when(n_images >= 2, "multi").when(size < small, "small").when(size < medium, "medium").otherwise("large")


def even_picks(rows: DataFrame, group: str, order: str, count: int) -> DataFrame:
    """count rows of each group at even distances in order: positions round(i * last / (count - 1)), halves up.

    A position is a target if some i in [0, count) rounds to it, which each row can tell from its own rank and the
    group's size; no targets are joined.
    """
    w = Window.partitionBy(group)
    rows = rows.withColumn("_at", F.row_number().over(w.orderBy(order)) - 1).withColumn("_size", F.count("*").over(w))
    last, steps = F.col("_size") - 1, max(count - 1, 1)
    # i = ceil((at - 1/2) * steps / last) is the first that rounds to at or beyond
    i = F.ceil((F.col("_at") - 0.5) * steps / F.greatest(last, F.lit(1)))
    target = (i >= 0) & (i <= steps) & (F.floor(i * last / steps + 0.5) == F.col("_at"))
    chosen = F.lit(count > 0) & ((F.col("_size") <= count) | (F.col("_at") == 0 if count == 1 else target | (F.col("_at") == 0)))
    return rows.filter(chosen).drop("_at", "_size")


def stratified_sample(rows: DataFrame, id_: str, order: str, limit: int, strata: int = len(STRATA)) -> DataFrame:
    """limit rows: even picks of each stratum (column stratum), filled up in order, then in order again."""
    if limit <= 0:
        return rows.limit(0)
    picked = even_picks(rows, "stratum", order, max(1, limit // strata))
    # at most limit rows are needed to fill up, so ranks are taken on top-k rows and never on all
    rest = rows.join(picked.select(id_), id_, "left_anti").orderBy(order, id_).limit(limit).withColumn("_filled", F.lit(1))
    both = picked.withColumn("_filled", F.lit(0)).unionByName(rest)
    return both.orderBy("_filled", order, id_).limit(max(limit, 1)).drop("_filled")


def markdown_report(title: str, rows: DataFrame, columns: list[str]) -> DataFrame:
    """pos and line of a Markdown report: a title, and a table of rows in order of its columns. For small aggregates."""
    spark, first = rows.sparkSession, [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + " - |" * len(columns)]
    head = spark.createDataFrame([*enumerate(first)], "pos long, line string")
    body = rows.withColumn("pos", F.row_number().over(Window.orderBy(*columns)) + (len(first) - 1))
    return head.unionByName(body.select(F.col("pos").cast("long").alias("pos"), markdown_row(*map(F.col, columns)).alias("line")))
