"""Session memory (the last turns) and episodic memory (validated episodes, upserted and superseded)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvina.operators import lexical

#: Field weights of the search over episodes.
EPISODE_WEIGHTS = {"case_ref": 4.0, "label": 2.0, "summary": 1.0, "corrections": 1.0}


def last_turns(rows: DataFrame, session: str, order: list[str], entry: list[str], n: int = 4) -> DataFrame:
    """The newest n rows of each session, oldest first, as an array; a session's rows are ranked before they are gathered."""
    rank = F.row_number().over(Window.partitionBy(session).orderBy(*[F.desc(c) for c in order]))
    newest = rows.withColumn("_n", rank).filter(F.col("_n") <= n)
    return newest.groupBy(session).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, *[c for c in entry if c not in order]))), lambda x: F.struct(*[x[c].alias(c) for c in entry])).alias("recent"))


def merge_history(requested, recent):
    """The request's own history if it has any, else the session's."""
    return F.when(F.coalesce(F.size(requested), F.lit(0)) > 0, requested).otherwise(recent)


def upsert(rows: DataFrame, key: str, order: list[str], created: str) -> DataFrame:
    """The latest row of each key, with the first creation time kept."""
    first = rows.groupBy(key).agg(F.min(created).alias("_first"))
    latest = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).filter("_n = 1").drop("_n")
    return latest.join(first, key).withColumn(created, F.col("_first")).drop("_first")


def supersede(episodes: DataFrame, key: str, supersedes: str) -> DataFrame:
    """episodes with superseded_by: the latest episode that names this one."""
    by = episodes.filter(F.col(supersedes).isNotNull()).groupBy(F.col(supersedes).alias("_old")).agg(F.max_by(key, "updated_at").alias("superseded_by"))
    return episodes.join(by, F.col(key) == F.col("_old"), "left").drop("_old")


def search(episodes: DataFrame, queries: DataFrame, limit: int = 3) -> DataFrame:
    """Live validated episodes by BM25 over four fields. Word statistics cover all episodes, dead ones too; filters come first."""
    live = episodes.filter(F.col("validated") & F.col("superseded_by").isNull())
    order = (F.desc("updated_at"), "id")
    hits = lexical.search(episodes, queries, "episode_id", EPISODE_WEIGHTS, limit, keep=live.select(F.col("episode_id").alias("id"), "updated_at"), order=order)
    named = hits.withColumnRenamed("id", "episode_id").withColumnRenamed("lexical_rank", "n")
    return named.join(live, "episode_id")
