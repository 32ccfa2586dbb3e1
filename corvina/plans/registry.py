"""Named queries over the test tables, each with the SQL it can be compared with, and the index that several of them read."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.operators import lexical
from corvina.plans import sql
from corvina.sources import readers, segments, shared

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
WEIGHTS = {"doc_id": 8.0, "source": 4.0, "text": 1.0}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def given(spark: SparkSession, rows: list[tuple], schema: str) -> tuple[DataFrame, str]:
    """Stated rows as a table, and as SQL."""
    return spark.createDataFrame(rows, schema), sql.values(rows, ", ".join(c.split()[0] for c in schema.split(", ")))


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str, rows: list[tuple], schema: str) -> DataFrame:
    """Every row of a table, as id (and source, of documents), with one of the stated rows: the one at id modulo their number."""
    stated = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
    every = table(spark, sf_dir, name).select(F.col(key).alias("id"), *([F.col("source")] if name == "documents" else []))
    return every.join(F.broadcast(stated), F.col("id") % len(rows) == F.col("_i")).drop("_i")  # the stated rows are few


def dealt_sql(name: str, key: str, rows: list[tuple], columns: str) -> str:
    """What dealt() gives, as SQL."""
    source = ", t.source" if name == "documents" else ""
    return f"(SELECT t.{key} AS id{source}, v.* EXCLUDE (_i) FROM {name} t JOIN {sql.values([(i, *r) for i, r in enumerate(rows)], f'_i, {columns}')} v ON v._i = t.{key} % {len(rows)})"


def documents_index(spark: SparkSession, sf_dir: str, where: str = "true", bounded: bool = False) -> lexical.Index:
    """The index of the documents in the shared work folder, built where it is missing or older than its source."""
    path = f"{shared.work_dir(spark)}/corvina/index-{hashlib.md5(f'{sf_dir} {where}{" bounds" * bounded}'.encode()).hexdigest()}"
    source = readers.file_fingerprint(spark, f"{sf_dir}/documents.parquet")
    return segments.ensure_index(table(spark, sf_dir, "documents").filter(where), path, "doc_id", WEIGHTS, source, bounded=bounded)
