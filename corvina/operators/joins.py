"""Joins that several parts share: lookups in a given order, highlights, a dimension by a code in a name, first rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.sources import shared


def lookup_in_order(rows: DataFrame, id_: str, asked: DataFrame) -> DataFrame:
    """asked (pos, id, repeats allowed) with the row of each id, in order; ids without a row are left out."""
    named = asked.select(F.col("pos"), F.col("id").alias("_asked"))
    return rows.join(shared.broadcast_if_small(named, 64), F.col(id_) == F.col("_asked")).drop("_asked").orderBy("pos")


def with_highlights(rows: DataFrame, id_: str, hits: DataFrame, sep: str = "|") -> DataFrame:
    """rows that hits (id, pos, content) name, with the last position and the contents in order; sorted by the position."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), sep)
    found = hits.groupBy(F.col("id").alias("_hit")).agg(F.max("pos").alias("pos"), text.alias("highlights"))
    return rows.join(found, F.col(id_) == F.col("_hit")).drop("_hit").orderBy("pos")


def with_category(rows: DataFrame, name: Column, categories: DataFrame) -> DataFrame:
    """rows with the ATA code that name begins with and its category (ATA_code, ATA_category), Unknown if there is none."""
    coded = rows.withColumn("ATA_code", F.nullif(F.regexp_extract(name, r"^ATA-(\d{2})", 1), F.lit("")))
    return coded.join(shared.broadcast_if_small(categories, 64), "ATA_code", "left").withColumn("ATA_category", F.coalesce("ATA_category", F.lit("Unknown")))


def first_of_key(rows: DataFrame, key: str, *order, limit: int = 6) -> DataFrame:
    """The first limit rows of every key, numbered n; each task cuts its own before the shuffle."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("n") <= limit)


def counts_without_page(rows: DataFrame, pages: DataFrame, id_: str, root: Column) -> DataFrame:
    """doc_root and n: the rows whose id is on no page, by root, the most first."""
    missing = rows.join(pages.select(id_).distinct(), id_, "left_anti")
    return missing.groupBy(root.alias("doc_root")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_root")
