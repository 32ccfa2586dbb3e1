"""A corpus pipeline of five operators: language, line dedup, near duplicates, personal data, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet into the shared folder and rereads as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.llm import language, lines, packing, pii, simhash
from corvina.llm.common import documents_of, free_name, materialise, quoted, release, small_enough
from corvina.llm.queries import WORD_BPE

#: No SQL expresses the classifier, the fingerprints or the tokenizer; tests compare with brute-force versions.
ORACLE_SQL = None
#: The least score of a known language; with four languages, one that is no likelier than the others scores 0.25.
MIN_SCORE = 0.3


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go; lang of the others, if there is such a column, becomes the one told.

    It cannot be told of a null or empty text, one without a letter, and one whose best language scores below MIN_SCORE,
    as texts in a language that no labelled row has do. Without a single labelled row there is nothing to learn from, and
    only texts without a letter go. An empty table stays empty; rows are neither merged nor ordered.
    """
    model = language.train(docs)
    if not language.languages(model):
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    labelled = language.label(docs, model)
    lang, score = labelled.columns[-2:]
    known = labelled.filter((F.col(lang) != language.UNDETERMINED) & (F.col(score) >= MIN_SCORE))
    told = {"lang": F.col(lang)} if "lang" in docs.columns else {}
    return known.withColumns(told).select(*map(quoted, docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents hold stay in one of them; every row stays, and n_chars follows its text.

    A null or empty text is one empty line and stays as it is; a row without doc_id loses what others hold.
    """
    return lines.drop_lines(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a component of near duplicates one row stays, the first by doc_id (nulls last), then by a digest of the row.

    Rows equal in all columns are reduced in each task before they are shuffled. Null and empty texts are near duplicates
    of each other.
    """
    heads = materialise(simhash.heads(docs), "heads")
    key = free_name(docs, "_key")
    keyed, named = docs.withColumn(key, simhash.row_key(docs)), heads.withColumnRenamed("key", key)
    kept = keyed.join(named.filter("n = 1"), key, "left_semi")
    copied = materialise(named.filter("n > 1"), "copied-heads")
    if not copied.isEmpty():
        copied = F.broadcast(copied) if small_enough(copied, 64) else copied
        kept = kept.unionByName(keyed.join(copied, key, "left_semi").dropDuplicates([key]))
    return kept.select(*map(quoted, docs.columns))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data and the words that tell of them are replaced; texts without any, null ones too, stay."""
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 4,096 tokens, as op3_packing returns them; a null text is the closing id alone."""
    return packing.best_fit_packing(docs, public_tokenizers.path(WORD_BPE))


STAGES = [
    ("language", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", keep_one_of_each_group),
    ("personal_data", replace_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; the tables of the others are deleted as soon as the next one is written."""
    docs = documents_of(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
