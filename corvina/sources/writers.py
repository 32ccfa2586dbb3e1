"""Sinks: staged overwrites, escaped TSV, canonical texts, manifests, bundle listings."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvina.functions.text import tsv_field
from corvina.operators import vector
from corvina.sources import files, shared

#: Suffix of a table that is being replaced.
ASIDE = ".old"


def replace_table(df: DataFrame, path: str, **options) -> None:
    """Write beside path, put the old table aside, move the new one in, and delete the old: at no time is either lost.

    After a crash between the two moves, recover() brings the old table back.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(staging)
    move_in(spark, staging, path)


def move_in(spark: SparkSession, staging: str, path: str) -> None:
    """Put what was written at staging in the place of path by two moves."""
    recover(spark, path)
    aside = path + ASIDE
    old = shared.rename(spark, path, aside)
    if not shared.rename(spark, staging, path):
        if old:
            shared.rename(spark, aside, path)
        raise OSError(f"cannot replace {path}")
    if old:
        shared.delete(spark, aside)


def recover(spark: SparkSession, path: str) -> None:
    """After a crash of replace_table(): the old table comes back if no new one took its place, else it goes."""
    aside = path.rstrip("/") + ASIDE
    if shared.exists(spark, aside) and (shared.exists(spark, path) or not shared.rename(spark, aside, path)):
        shared.delete(spark, aside)


def write_tsv(df: DataFrame, path: str, columns: list[str], header: bool = False, gz: bool = False) -> None:
    """Escaped TSV that quotes only fields that need it. header: the names at the head of each file, where readers skip them.

    A task's file begins with its first row, which takes the names before it; a table without rows is a file of the names.
    """
    line = F.concat_ws("\t", *[tsv_field(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])
    head = "\t".join(columns)
    if header:
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # the lower bits number a partition's rows
        line = F.concat(F.when(first, head + "\n").otherwise(""), line)

    def write(rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("compression", "gzip" if gz else "none").text(path)

    write(df.select(line.alias("value")))
    if header and df.sparkSession.read.text(path).isEmpty():
        write(df.sparkSession.createDataFrame([(head,)], "value string").coalesce(1))


def write_files(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A file of its own, called name (folders included), for each row (name, content text or bytes).

    Files appear when all tasks have ended (see sources.files); overwrite removes what was there.
    """
    files.register(df.sparkSession)
    rows = df.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content"))
    rows.write.format(files.NAME).mode("overwrite" if overwrite else "append").option("path", path).save()


def write_meta(spark: SparkSession, path: str, values: dict[str, str]) -> None:
    """Upsert key and value pairs into the small table meta below path."""
    merged = read_meta(spark, path) | values
    replace_table(spark.createDataFrame(sorted(merged.items()), "key string, value string").coalesce(1), f"{path}/meta")


def read_meta(spark: SparkSession, path: str) -> dict[str, str]:
    """The pairs of the table meta below path; none if it is missing."""
    recover(spark, f"{path}/meta")
    return dict(map(tuple, spark.read.parquet(f"{path}/meta").collect())) if shared.exists(spark, f"{path}/meta") else {}


def write_vectors(rows: DataFrame, path: str, vector_column: str = "embedding") -> None:
    """Vectors with their single-precision squared norms, then their count and dimension as facts to read them by.

    Rows without a vector are left out; vectors of more than one dimension are an error.
    """
    vector.with_norm(rows.filter(F.col(vector_column).isNotNull()), vector_column).withColumnRenamed(vector_column, "embedding").write.mode("overwrite").parquet(f"{path}/rows")
    written = rows.sparkSession.read.parquet(f"{path}/rows")
    count, least, most = written.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if least != most:
        raise ValueError(f"vectors of {least} to {most} dimensions")
    rows.sparkSession.createDataFrame([("count", count), ("dims", least or 0)], "name string, value long").coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")


def copy_assets(spark: SparkSession, source: str, target: str) -> None:
    """The files below source as a table (name, content) at target, named by their path below source; what was there goes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source)
    root = re.sub("^[a-z0-9]+:(//[^/]*)?", "", source).rstrip("/") + "/"
    below = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?", ""), "^" + re.escape(root), "")
    replace_table(found.select(below.alias("name"), "content"), target)


#: Records of one group of the running byte offsets.
OFFSET_ROWS = 1 << 16


def text_digest(lines: DataFrame, group: str, *order: str) -> DataFrame:
    """One row: n_lines, n_bytes, and two sums of hashes over every line's bytes and its byte offset in the whole text.

    lines: (group, ..., line); groups follow one another in order, lines inside a group by order. Offsets are running sums
    inside each group plus the sizes of the groups before it, so no task holds more than a group, and lines that change
    places change the digest.
    """
    size = F.octet_length("line").cast("long") + 1
    sizes = lines.groupBy(group).agg(F.sum(size).alias("_size"))
    before = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)  # one row a group
    starts = sizes.select(group, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = F.sum(size).over(Window.partitionBy(group).orderBy(*order)) - size
    placed = lines.withColumn("_inside", inside).join(starts, group).withColumn("_at", F.col("_start") + F.col("_inside"))
    hashed = F.xxhash64("_at", "line")
    return placed.agg(F.count("*").alias("n_lines"), F.coalesce(F.sum(size), F.lit(0)).alias("n_bytes"), F.sum(hashed.cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), "_at", "line")).alias("x"))


def _source_lines(rows: DataFrame) -> DataFrame:
    """The lines of records (order, raw) in groups of neighbouring rows."""
    lines = rows.select("order", F.posexplode(F.split("raw", "\n")).alias("pos", "line"))
    return lines.withColumn("group", F.floor(F.col("order") / OFFSET_ROWS))


def _file_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the text files below path as they stand; compressed files, so that one is read as one stream in order."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_name").alias("group"), F.col("value").alias("line"))
    return lines.withColumn("pos", F.monotonically_increasing_id())


def audit_text(rows: DataFrame, path: str) -> dict[str, object]:
    """Whether the gzip text files below path hold exactly the records (order, raw), each followed by a line end, in order."""
    source = text_digest(_source_lines(rows), "group", "order", "pos").first()
    written = text_digest(_file_lines(rows.sparkSession, path), "group", "pos").first()
    return {"rows": rows.count(), "n_lines": written.n_lines, "n_bytes": written.n_bytes, "source": f"{source.h}:{source.x}", "written": f"{written.h}:{written.x}", "exact": source == written}


def write_canonical(rows: DataFrame, path: str) -> dict[str, object]:
    """Write the exact source text raw of records as gzip files in order, compare, and only then put them at path.

    rows: (order, raw), order being the record's index, once each; raw is kept to the byte, carriage returns and line ends
    in quotes too. Returns the audit. Texts that do not come back exactly are an error, and what was at path stays.
    """
    spark, path = rows.sparkSession, path.rstrip("/")
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    dealt = rows.repartitionByRange("order").sortWithinPartitions("order").select(F.col("raw").alias("value"))
    dealt.write.option("compression", "gzip").option("lineSep", "\n").text(staging)
    audit = audit_text(rows, staging)
    if not audit["exact"]:
        shared.delete(spark, staging)
        raise OSError(f"{path}: written and read texts differ")
    move_in(spark, staging, path)
    return audit


def append_turns(rows: DataFrame, path: str, session: str, buckets: int = 64) -> None:
    """Append turns of sessions to the working memory, in folders by a hash of the session."""
    rows.withColumn("bucket", F.pmod(F.xxhash64(session), F.lit(buckets)).cast("int")).write.mode("append").partitionBy("bucket").parquet(path)


def manifest(spark: SparkSession, counts: dict[str, DataFrame], fingerprint: DataFrame) -> DataFrame:
    """One row: the corpus fingerprint and a count of every artefact."""
    out = fingerprint.select("fingerprint")
    for name, df in counts.items():
        out = out.join(F.broadcast(df.agg(F.count("*").alias(f"{name}_count"))))  # one row each
    return out


def mismatches(found: DataFrame, expected: dict[str, object]) -> DataFrame:
    """found (one row) with the array of names whose value is not the expected one."""
    checks = [F.when(~F.col(c).eqNullSafe(F.lit(v)), F.lit(f"{c}-mismatch")) for c, v in expected.items()]
    return found.select(F.array_compact(F.array(*checks)).alias("reasons"))


def bundle_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Every file below path with its size, in order, and the totals."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return found.orderBy("path"), found.agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))
