"""Preparing a corpus: row normalisation, the canonical dataset, page policy, fingerprints and chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvina.functions import text as X

#: Fixed value: longest content of an event record, in characters.
MAX_CONTENT = 30_000
# Page categories that carry no content, and words that mark front matter and procedures.
NON_CONTENT = ("index_page", "cover_page", "front_matter", "blank_page", "separation_page", "other_non_technical")
COVER_WORDS = "cover|training manual|manual|issue|revision|copyright|proprietary|table of contents"
PROCEDURE_WORDS = "figure|table|ref(?:erence)?|example|procedure|task|step|inspection|continued"
# End of fixed values.


def tech_records(rows: DataFrame) -> DataFrame:
    """Nine-column rows as records: doc, chunk_id and trimmed content must not be empty."""
    content = X.js_trim(F.coalesce("chunk", F.lit("")))
    meta = F.create_map(*[x for c in ("doc_root", "json_data", "ata", "parts", "doc_type") for x in (F.lit(c), F.coalesce(F.col(c), F.lit("")))])
    path = F.coalesce(X.blank_to_null(F.col("json_data")), X.blank_to_null(F.col("doc_root")), F.col("doc"))
    out = rows.select(F.lit("tech_docs").alias("corpus"), "doc", "chunk_id", content.alias("content"), path.alias("source_path"), X.int_or_zero(F.col("length")).alias("length"), meta.alias("metadata"))
    return out.filter((F.coalesce("doc", F.lit("")) != "") & (F.coalesce("chunk_id", F.lit("")) != "") & (F.col("content") != ""))


def event_records(rows: DataFrame, dedupe: bool = False, order: str | None = None) -> DataFrame:
    """Three-column rows as records, content cut to MAX_CONTENT; dedupe keeps the first row of each chunk_id by order."""
    content = F.substring(X.js_trim(F.coalesce("chunk", F.lit(""))), 1, MAX_CONTENT)
    if dedupe:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("chunk_id").orderBy(order or "doc"))).filter("_n = 1")
    kind = X.task_kind(F.col("doc"), F.col("chunk_id"), F.col("content"))
    ata = F.coalesce(F.get(X.ata_codes(F.col("doc"), F.col("content")), F.lit(0)), F.lit(""))
    out = rows.select(F.lit("non_conformities").alias("corpus"), "doc", "chunk_id", content.alias("content"), F.col("doc").alias("source_path"))
    out = out.filter((F.coalesce("doc", F.lit("")) != "") & (F.coalesce("chunk_id", F.lit("")) != "") & (F.col("content") != ""))
    return out.withColumn("metadata", F.create_map(F.lit("task_kind"), kind, F.lit("ATA_code"), ata))


def drop_reasons(rows: DataFrame, pages: DataFrame, alias_of: Column, malformed: Column, id_: str = "chunk_id", order: str = "row_idx", page: str = "doc") -> DataFrame:
    """rows with drop_reason: malformed, then missing_page, duplicate_chunk and alias, in this sequence; null stays.

    A row that falls earlier does not use up its chunk_id, and an alias document counts only while its canonical
    document still has rows. page: the column by which a row finds its page (doc of pages).
    """
    here = pages.select(F.col("doc").alias("_page")).distinct()
    step = rows.withColumn("_bad", malformed).join(here, F.col(page) == F.col("_page"), "left")
    step = step.withColumn("drop_reason", F.when(F.col("_bad"), "malformed").when(F.col("_page").isNull(), "missing_page")).drop("_bad", "_page")
    first = F.row_number().over(Window.partitionBy(id_, F.col("drop_reason").isNull()).orderBy(order))
    step = step.withColumn("_n", first).withColumn("drop_reason", F.coalesce("drop_reason", F.when(F.col("_n") > 1, "duplicate_chunk"))).drop("_n")
    kept = step.filter(F.col("drop_reason").isNull()).select(F.col("doc").alias("_target")).distinct()
    step = step.withColumn("_alias", alias_of).join(kept, F.col("_alias") == F.col("_target"), "left")
    return step.withColumn("drop_reason", F.coalesce("drop_reason", F.when(F.col("_target").isNotNull(), "alias"))).drop("_alias", "_target")


def audit(reasons: DataFrame) -> DataFrame:
    return reasons.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n_rows"))


def content_hashes(rows: DataFrame, doc: str, order: str, content: str) -> DataFrame:
    """SHA-256 of each document's white-space-normalised chunks, in order, as a JSON array."""
    chunks = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), X.compact(F.coalesce(content, F.lit(""))).alias("c")))), lambda x: x["c"])
    return rows.groupBy(doc).agg(F.sha2(F.to_json(chunks).cast("binary"), 256).alias("content_sha256"), F.count("*").alias("n_chunks"))


def fingerprint(rows: DataFrame, fields: list[str], order: str, width: int = 1000) -> DataFrame:
    """One SHA-256 over all rows in order (a whole number): rows are hashed, then runs of width numbers, then runs of runs.

    Runs are folded until fewer than width numbers are left, so no group holds more than width runs, or the rows that
    share a number. A row without a number takes the place of its hash; n_rows counts all.
    """
    row = F.sha2(F.concat_ws("\n", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]).cast("binary"), 256)
    level = rows.select(F.col(order).cast("long").alias("o"), row.alias("h"), F.lit(1).cast("long").alias("n"))
    level = level.withColumn("o", F.coalesce("o", F.pmod(F.xxhash64("h"), F.lit(1 << 40))))
    number = F.col(order).cast("long")
    least, most, without = (x or 0 for x in rows.agg(F.min(number), F.max(number), F.count_if(number.isNull())).first())
    if without:
        least, most = min(least, 0), max(most, (1 << 40) - 1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "h"))), lambda x: x["h"]), "")
    agg = [F.sha2(joined.cast("binary"), 256).alias("h"), F.sum("n").alias("n")]
    while True:
        run = F.expr(f"o div {width} - if(o % {width} < 0, 1, 0)").alias("run")
        level = level.groupBy(run).agg(*agg).withColumnRenamed("run", "o")
        least, most = least // width, most // width
        if most - least < width:
            return level.agg(agg[0].alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


def page_policy(category: Column, confidence: Column, non_content: Column, action: Column, weight: Column) -> Column:
    """(action, weight, reason) of a page: whether it is indexed, weighted down or left out."""
    def out(a: str, w, r: str) -> Column:
        return F.struct(F.lit(a).alias("action"), (w if isinstance(w, Column) else F.lit(float(w))).alias("weight"), F.lit(r).alias("reason"))

    empty = F.coalesce(non_content, F.lit(False)) | category.isin(*NON_CONTENT)
    asked = F.least(F.lit(0.6), F.greatest(F.lit(0.05), F.coalesce(F.nullif(weight, F.lit(0.0)), F.lit(0.4))))
    return (
        F.when(category == "unreadable", out("exclude", 0, "unreadable-page"))
        .when(empty & (confidence >= 0.75), out("exclude", 0, "high-confidence-non-content"))
        .when(empty & (confidence >= 0.55), out("downweight", 0.15, "medium-confidence-non-content"))
        .when(empty, out("downweight", 0.4, "low-confidence-non-content"))
        .when(action == "exclude", out("exclude", 0, "caption-requested-exclusion"))
        .when(action == "downweight", out("downweight", asked, "caption-requested-downweight"))
        .when(confidence < 0.55, out("downweight", 0.5, "low-confidence-technical-classification"))
        .otherwise(out("index", 1, "technical-content"))
    )


def default_analysis(markdown: Column, page: Column) -> Column:
    """(category, confidence, action) of a page without captions: blank, likely front matter, or a procedure."""
    clean = X.compact(markdown)
    def out(c: str, p: float, a: str) -> Column:
        return F.struct(F.lit(c).alias("category"), F.lit(p).alias("confidence"), F.lit(a).alias("action"))

    cover = (page > 0) & (page <= 2) & (F.length(clean) < 1200) & clean.rlike(X.word(COVER_WORDS))
    return F.when(clean == "", out("blank_page", 0.9, "exclude")).when(cover, out("front_matter", 0.7, "downweight")).otherwise(out("technical_procedure", 0.6, "index"))


def is_separator(markdown: Column, n_images: Column, width_coverage: Column) -> Column:
    """A chapter separator: one wide image and a single visible line, a chapter heading without words of procedures."""
    lines = X.visible_lines(markdown)
    head = F.get(lines, F.lit(0))
    heading = (F.length(head) <= 120) & head.rlike(r"(?i)^ATA[\s-]?\d{2}" + X.RIGHT) & ~head.rlike(X.word(PROCEDURE_WORDS))
    return (n_images == 1) & (F.size(lines) == 1) & F.coalesce(heading, F.lit(False)) & (width_coverage >= 0.92)


def chunk_bounds(text: str, size: int = 3000, overlap: int = 120) -> Iterator[str]:
    """Chunks of at most size characters, cut at the last blank line, line end or space of the last 500 of them."""
    text = text.strip()
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            cut = max(text.rfind(s, at, end + len(s)) for s in ("\n", " "))
            if cut > max(at + size // 2, end - 500):
                end = cut
        if piece := text[at:end].strip():
            yield piece
        if end >= len(text):
            return
        at = max(end - overlap, at + 1)


def chunks(rows: DataFrame, id_: str, text: str, size: int = 3000, overlap: int = 120) -> DataFrame:
    """id, pos and chunk of every row's text; the cut depends on the one before, so each text is walked in its task."""
    schema = T.StructType([T.StructField("id", rows.schema[id_].dataType), T.StructField("pos", T.IntegerType()), T.StructField("chunk", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(i, p, c) for i, t in zip(frame["id"], frame["text"], strict=True) for p, c in enumerate(chunk_bounds(t or "", size, overlap))]
            yield pd.DataFrame(found, columns=["id", "pos", "chunk"])

    return rows.select(F.col(id_).alias("id"), F.col(text).alias("text")).mapInPandas(run, schema)


def with_descriptions(markdown: Column, captions: Column) -> Column:
    """The ith image of a page becomes the ith caption, the last one repeated; without images captions are appended."""
    bare = F.split(markdown, r"!\[[^\]]*\]\([^)]*\)")
    intro = F.lit("> Image description: ")
    said = lambda i: F.concat(intro, F.element_at(captions, F.least(i, F.size(captions))))
    replaced = F.array_join(F.transform(bare, lambda part, i: F.when(i == 0, part).otherwise(F.concat(said(F.greatest(i, F.lit(1))), part))), "")
    appended = F.concat(F.regexp_replace(markdown, r"\s+$", ""), F.lit("\n\n"), intro, F.array_join(captions, "\n\n> Image description: "))
    return F.when(F.size(captions) <= 0, markdown).when(F.size(bare) > 1, replaced).otherwise(F.regexp_replace(appended, r"\s+$", ""))
