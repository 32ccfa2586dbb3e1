"""Scans: escaped TSV, Markdown and JSON trees, page listings, scenario texts, batch results, vector exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.functions.text import in_locale, js_trim
from corvina.operators import joins
from corvina.sources import shared, tsv

TECH_COLUMNS = ("doc", "doc_root", "json_data", "chunk", "length", "chunk_id", "ata", "parts", "doc_type")
EVENT_COLUMNS = ("doc", "chunk_id", "chunk")


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...], header: bool) -> DataFrame:
    """Escaped TSV (gzip by extension) by its own grammar; records of another width carry their text in _corrupt."""
    return tsv.read_table(spark, path, columns, header)


def read_tech_docs(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, TECH_COLUMNS, True)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Three columns without header; rows of another width are left out."""
    return read_tsv(spark, path, EVENT_COLUMNS, False).filter(F.col("_corrupt").isNull())


def read_raw_tsv(spark: SparkSession, path: str) -> DataFrame:
    """path, row_idx, fields and raw (the record's exact source text, without its line end)."""
    return tsv.read_records(spark, path)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """One document for each *.md file: doc (file name), chunk_id (stem), content."""
    rows = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).text(path, wholetext=True)
    name = F.col("_metadata.file_name")
    return rows.select(F.url_decode(name).alias("doc"), F.regexp_replace(F.url_decode(name), r"\.md$", "").alias("chunk_id"), F.col("value").alias("content"), F.col("_metadata.file_path").alias("source_path"))


def read_json_objects(spark: SparkSession, path: str, ata: DataFrame | None = None) -> DataFrame:
    """One JSON object for each *.json file, as a map of raw JSON values; files that do not parse are left out.

    ata (ATA_code, ATA_category), a small dimension, adds code and category by the file name.
    """
    rows = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).withColumn("doc", F.col("_metadata.file_name"))
    rows = rows.withColumn("payload", F.from_json("value", "map<string,string>")).filter(F.col("payload").isNotNull() & F.coalesce(F.try_parse_json("value").isNotNull(), F.lit(False)))
    rows = rows.select("doc", F.regexp_replace("doc", r"\.json$", "").alias("nc_event_id"), "payload")
    if ata is None:
        return rows.withColumn("ATA_code", F.nullif(F.regexp_extract("doc", r"^ATA-(\d{2})", 1), F.lit("")))
    return joins.with_category(rows, F.col("doc"), ata)


def is_safe_name(name):
    """Whether a file name stays inside its folder."""
    return ~(F.contains(name, F.lit("..")) | F.contains(name, F.lit("/")))


def list_pages(spark: SparkSession, path: str, suffix: str = "pdf", limit: int | None = None) -> DataFrame:
    """File names with the suffix in any case, in locale order; only the listing is read, no content."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("doc"), "length", "modificationTime")
    files = files.filter(F.lower("doc").endswith("." + suffix)).orderBy(*in_locale("doc"))
    return files.limit(limit) if limit is not None else files


def parse_scenarios(rows: DataFrame, text: str = "value", start: str = r"NC-\d{4}-\d{3}", keep: list[str] | None = None) -> DataFrame:
    """Records of scenario texts: each begins with an id at a line's start; id, title (rest of the line) and body. keep: columns of rows."""
    parts = F.posexplode(F.split(F.col(text), rf"(?m)(?=^{start}\b)"))
    out = rows.select(*(keep or []), parts.alias("pos", "record")).filter(js_trim(F.col("record")) != "")
    ref = F.regexp_extract("record", f"^({start})", 1)
    return out.select(*(keep or []), "pos", F.nullif(ref, F.lit("")).alias("case_ref"), F.trim(F.regexp_extract("record", rf"^{start}[ \t:-]*([^\n]*)", 1)).alias("title"), js_trim(F.regexp_replace("record", r"^[^\n]*\n?", "")).alias("body"), F.when(ref == "", "unparsed").otherwise("parsed").alias("status"))


def parse_double_json(rows: DataFrame, id_: str, value: str) -> DataFrame:
    """id, json and ok of a column whose JSON may itself be a JSON text."""
    once = F.try_parse_json(F.col(value))
    inner = F.try_variant_get(once, "$", "string")
    twice = F.when(F.schema_of_variant(once) == "STRING", F.try_parse_json(inner)).otherwise(once)
    return rows.select(F.col(id_).alias("id"), F.to_json(twice).alias("json"), twice.isNotNull().alias("ok"))


def parse_labels(rows: DataFrame, value: str, allowed: list[str]) -> DataFrame:
    """doc and label of a JSON array of {doc, label} or a map of doc to label; other labels are left out."""
    as_list = F.from_json(F.col(value), "array<struct<doc:string,label:string>>")
    as_map = F.from_json(F.col(value), "map<string,string>")
    is_list = F.trim(F.col(value)).startswith("[")
    pairs = F.when(is_list, as_list).otherwise(F.transform(F.map_entries(as_map), lambda e: F.struct(e["key"].alias("doc"), e["value"].alias("label"))))
    return rows.select(F.inline(pairs)).filter(F.col("label").isin(*allowed) & (F.coalesce("doc", F.lit("")) != ""))


def read_batch_results(spark: SparkSession, path: str) -> DataFrame:
    """custom_id, body (JSON text) and error of a JSONL of batch results."""
    return spark.read.schema("custom_id string, response string, error string").json(path)


def file_fingerprint(spark: SparkSession, path: str) -> str:
    """SHA-256 over path, size and time of change of every file below path; no content is read.

    Files are dealt to groups of about a thousand by a hash of their line, so no group grows with the listing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    line = files.select(F.concat_ws(":", "path", F.col("length").cast("string"), F.unix_millis("modificationTime").cast("string")).alias("line"))
    hashed = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n").cast("binary"), 256)
    groups = max(1, line.count() // 1000)
    runs = line.groupBy(F.pmod(F.xxhash64("line"), F.lit(groups)).alias("g")).agg(hashed("line").alias("h"))
    return runs.agg(hashed("h")).first()[0]


def read_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    """The vectors that writers.write_vectors wrote below path; None where there are none, which turns the channel off.

    A count or a dimension other than the table of facts says is an error.
    """
    if not shared.exists(spark, f"{path}/rows"):
        return None
    rows = spark.read.parquet(f"{path}/rows")
    facts = dict(map(tuple, spark.read.parquet(f"{path}/facts").collect()))
    count, least, most = rows.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if count != facts["count"] or (count and not least == most == facts["dims"]):
        raise ValueError(f"vectors do not match their facts: {count} of {facts['count']} rows, {least} to {most} of {facts['dims']} dimensions")
    return rows


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON artefact (one array of objects a file) in the given columns; empty where the path is missing."""
    if not shared.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def point_lookup(rows: DataFrame, name: str, asked: DataFrame) -> DataFrame:
    """The rows whose name is asked for (asked: one column, name); names that leave their folder find nothing."""
    wanted = asked.select(F.col(asked.columns[0]).alias(name)).filter(is_safe_name(F.col(name)) & (F.col(name) != "")).distinct()
    return rows.join(shared.broadcast_if_small(wanted, 128), name)


def with_pages(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """rows (doc, ...) whose document is among the listed pages (doc)."""
    return rows.join(pages.select("doc").distinct(), "doc", "left_semi")
