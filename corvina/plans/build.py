"""Building all artefacts of a corpus from prepared rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.functions.providers import Embedder, with_embedding
from corvina.operators import corpus, ocr, ontology
from corvina.sources import readers, segments, shared, writers

#: Documents and chunks that the row of a part lists; its page lists all documents.
LISTED = 1000
WEIGHTS = {"doc": 8.0, "chunk_id": 4.0, "content": 1.0}
#: Tables of every build; a full one has vectors and an index besides.
KNOWLEDGE = ("supports", "parts", "relations", "occurrences", "wiki")
#: Of the layout of what build() writes; artefacts of another version are stale.
VERSION = "1"


def build(records: DataFrame, events: DataFrame, path: str, embedder: Embedder, images: DataFrame | None = None, knowledge_only: bool = False, facts: dict[str, str] | None = None) -> DataFrame:
    """Write vectors, index, parts, relations, occurrences and wiki pages below path; returns the manifest.

    records: (row_idx, doc, chunk_id, content, ata, parts); events: (doc, chunk_id, content). knowledge_only: neither vectors
    nor index are written, and those of an earlier build stay as they are. facts: what the artefacts were made of or by
    (corpus, model, code), kept for inspect() beside the mode, the version and the counts of records, vectors and index rows.
    """
    spark, records = records.sparkSession, shared.spread(records)
    if not knowledge_only:
        writers.write_vectors(with_embedding(records, "content", embedder), f"{path}/vectors")
        segments.update_index(records, f"{path}/index", "row_idx", WEIGHTS)
    found = ontology.candidates(records)
    ontology.supports(found).write.mode("overwrite").parquet(f"{path}/supports")
    ontology.parts(found, most=LISTED).write.mode("overwrite").parquet(f"{path}/parts")
    parts = spark.read.parquet(f"{path}/parts")
    ontology.edges(found).write.mode("overwrite").parquet(f"{path}/relations")
    ontology.occurrences(events).write.mode("overwrite").parquet(f"{path}/occurrences")
    occurrences = spark.read.parquet(f"{path}/occurrences")
    pages = wiki_pages(parts, occurrences, images, spark.read.parquet(f"{path}/supports"))
    pages.write.mode("overwrite").parquet(f"{path}/wiki")
    mark = corpus.fingerprint(records, ["doc", "chunk_id", "content"], "row_idx")
    counts = {n: spark.read.parquet(f"{path}/{n}") for n in ("parts", "relations", "occurrences", "wiki")}
    if not knowledge_only:
        counts["vectors"] = readers.read_vectors(spark, f"{path}/vectors")
    out = writers.manifest(spark, counts, mark)
    out.write.mode("overwrite").json(f"{path}/manifest")
    said = {"mode": "knowledge-only" if knowledge_only else "full", "version": VERSION, "records": str(records.count())}
    if not knowledge_only:
        said |= {f"{name}_rows": str(n) for name, n in _stored(spark, path).items()}
    writers.write_meta(spark, path, said | (facts or {}))
    return out


def _stored(spark: SparkSession, path: str) -> dict[str, int | None]:
    """The rows of the vectors and of the index below path, by their own facts and manifest; None where there are none."""
    facts, live = f"{path}/vectors/facts", segments.manifest(spark, f"{path}/index")
    whole = shared.exists(spark, facts) and shared.exists(spark, f"{path}/vectors/rows")
    vectors = dict(map(tuple, spark.read.parquet(facts).collect()))["count"] if whole else None
    return {"vectors": vectors, "index": sum(s.n_rows for s in live) if live else None}


def inspect(spark: SparkSession, path: str, expected: dict[str, object]) -> list[str]:
    """Every reason why the artefacts below path do not serve retrieval over what is expected; none if they are fresh.

    expected: facts of the build and their values, such as records, corpus, model or code. Only manifests, facts and folders
    are read.
    """
    meta = writers.read_meta(spark, path)
    reasons = [] if shared.exists(spark, f"{path}/manifest") else ["manifest-missing"]
    if meta.get("mode") == "knowledge-only":
        reasons.append("knowledge-only")
    reasons += [f"{name}-mismatch" for name, value in ({"version": VERSION} | expected).items() if meta.get(name) != str(value)]
    for name, n in _stored(spark, path).items():
        if n is None:
            reasons.append(f"{name}-missing")
        elif meta.get(f"{name}_rows") != str(n):
            reasons.append(f"{name}_rows-mismatch")
    return reasons + [f"{name}-missing" for name in KNOWLEDGE if not shared.exists(spark, f"{path}/{name}")]


def wiki_pages(parts: DataFrame, occurrences: DataFrame, images: DataFrame | None = None, supported: DataFrame | None = None) -> DataFrame:
    """slug, title and markdown of every part; images: (id, doc, caption, ... asset_path), linked by score.

    parts: rows of ontology.parts(), with or without a limit on what they list; supported: the edges of ontology.supports(),
    from which a page lists all its documents, where rows may list the first ones only.
    """
    numbers = parts.select("slug", F.explode("part_numbers").alias("number"))
    of = occurrences.select("doc", F.explode("part_numbers").alias("number"))
    linked = ontology.shared(numbers, of, "slug", "doc", "number", "doc", 10).groupBy("slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "doc"))), lambda x: x["doc"]).alias("linked"))
    page = parts.join(linked, "slug", "left").withColumn("linked", F.coalesce("linked", F.array().cast("array<string>")))
    if supported is not None:
        whole = supported.groupBy("slug").agg(F.sort_array(F.collect_list("doc")).alias("_docs"))
        page = page.join(whole, "slug", "left").withColumn("supporting_docs", F.coalesce("_docs", F.array().cast("array<string>"))).drop("_docs")
    shown = None
    if images is not None:
        best = ontology.linked_images(ontology.image_relations(images, parts, supported), images)
        title = F.coalesce(F.get("figure_or_table_refs", F.lit(0)), F.col("doc"))
        lines = F.concat(F.lit("- !["), title, F.lit("](../"), F.regexp_replace("asset_path", "^wiki/", ""), F.lit(")\n  - Source: ["), F.col("doc"), F.lit("](../../pages/"), F.col("doc"), F.lit(")"), F.when(F.col("caption") != "", F.concat(F.lit("\n  - Summary: "), F.col("caption"))).otherwise(""))
        best = best.groupBy(F.substring(F.col("from"), 6, 1000).alias("slug")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", lines.alias("line")))), lambda x: x["line"]).alias("image_lines"))
        page = page.join(best, "slug", "left").withColumn("image_lines", F.coalesce("image_lines", F.array().cast("array<string>")))
        shown = F.col("image_lines")
    n_docs = F.col("n_supporting_docs") if "n_supporting_docs" in parts.columns else F.size("supporting_docs")
    described = F.concat(F.col("canonical_name"), F.lit(" in "), n_docs.cast("string"), F.lit(" documents."))
    text = ontology.wiki_markdown(F.col("slug"), F.col("canonical_name"), described, F.col("ata_codes"), F.col("zones"), F.col("aliases"), F.col("part_numbers"), F.col("supporting_docs"), F.col("linked"), shown)
    return page.select("slug", F.col("canonical_name").alias("title"), text.alias("markdown"))


def ensure(records: DataFrame | None, events: DataFrame, path: str, embedder: Embedder, source: str, spark: SparkSession | None = None, facts: dict[str, str] | None = None) -> str:
    """Build the artefacts below path if inspect() finds a reason to; what was done.

    source: a fingerprint of the corpus; facts: what else they have to be made of or by, such as a model. fresh: nothing had to be done; missing: there is nothing to build from.
    """
    spark = spark or events.sparkSession
    made_of = (facts or {}) | {"built_of": source}
    if not inspect(spark, path, made_of):
        return "fresh"
    if records is None:
        return "missing"
    build(records, events, path, embedder, facts=made_of)
    return "built"


def ocr_corpus(pages: DataFrame, done: DataFrame, read, captions: DataFrame, size: int = 3000, overlap: int = 120) -> DataFrame:
    """Prepared rows of pages (doc): those in done (doc, value) are not read again, read() gives the OCR JSON of the others.

    captions (doc, value): caption JSON of pages.
    """
    documents = ocr.parse_documents(ocr.read_pages(pages, done, read), "doc", "value")
    return ocr.prepared(documents, ocr.captions(captions, "doc", "value"), size, overlap)
