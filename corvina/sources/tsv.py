"""Escaped TSV by its own grammar, in parallel.

A double quote toggles quoting anywhere in a field, a backslash escapes the next character inside quotes only, line ends
inside quotes belong to the field, carriage returns outside are dropped, and a quote without an end is an error. So whether
a line end closes a record depends on all text before it, which would make one file one task's work. Here blocks of a file
(the reader's own splits) are lexed at once, for both states that a block may begin in, outside and inside quotes; a block
maps the one to the other, and a prefix composition of these maps over the blocks of a file gives every block its state.
Then blocks are cut into records by themselves; the few pieces of records that go over a block's end are put together after.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvina.functions.batches import HELD_BYTES, text_slices
from corvina.sources import shared

QUOTED = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)
TOKEN = re.compile(r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"|([^"\t]+)|(\t)', re.S)
ESCAPED = re.compile(r"\\(.)", re.S)
#: Bytes of a block's row in the table of blocks, which is broadcast up to shared.BROADCAST_BYTES: half a million blocks.
BLOCK_ROW = 32


class UnterminatedQuote(ValueError):
    pass


def fields_of(raw: str) -> list[str]:
    """The fields of one record's source text."""
    if '"' not in raw:
        return raw.replace("\r", "").split("\t")
    fields, field = [], []
    for quoted, plain, tab in TOKEN.findall(raw):
        if tab:
            fields.append("".join(field))
            field = []
        else:
            field.append(ESCAPED.sub(r"\1", quoted) if quoted else plain.replace("\r", ""))
    return [*fields, "".join(field)]


def leaves_open(line: str, inside: bool) -> bool:
    """Whether the end of a line lies inside quotes, if its start does or not."""
    return '"' in QUOTED.sub("", '"' + line if inside else line)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """path, file (its hash), block and line, in the order of each block. A file that is compressed is one block."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """The rows of one block after the other, in pieces."""
    for batch in batches:
        n = batch.num_rows
        if n:
            same = pc.and_(pc.equal(batch["file"].slice(1), batch["file"].slice(0, n - 1)), pc.equal(batch["block"].slice(1), batch["block"].slice(0, n - 1)))
            cuts = [0, *[i + 1 for i in range(n - 1) if not same[i].as_py()], n] if n > 1 and not pc.all(same).as_py() else [0, n]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield (batch["file"][a].as_py(), batch["block"][a].as_py()), batch.slice(a, b - a)


def _maps(batches):
    """For each block: the state at its end, and the records that end in it, if it begins outside or inside quotes."""
    known: dict[tuple[int, int], list] = {}
    for key, rows in _runs(batches):
        state = known.setdefault(key, [[False, 0], [True, 0]])
        lines = rows["line"]
        quoted = pc.indices_nonzero(pc.match_substring(lines, '"')).to_pylist()
        blank = pc.equal(lines, "")
        for hypothesis in state:
            at = 0
            for i in [*quoted, len(lines)]:
                if not hypothesis[0] and i > at:  # lines without a quote keep the state; empty ones outside are no records
                    hypothesis[1] += i - at - (pc.sum(blank.slice(at, i - at)).as_py() or 0)
                if i < len(lines):
                    hypothesis[0] = leaves_open(lines[i].as_py(), hypothesis[0])
                    hypothesis[1] += not hypothesis[0]
                at = i + 1
    rows = [(*key, *out, *in_) for key, (out, in_) in known.items()]
    names = ["file", "block", "exit_out", "n_out", "exit_in", "n_in"]
    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema([("file", pa.int64()), ("block", pa.int64()), ("exit_out", pa.bool_()), ("n_out", pa.int64()), ("exit_in", pa.bool_()), ("n_in", pa.int64())]))


def blocks(lines: DataFrame) -> DataFrame:
    """file, block, entry (whether it begins inside quotes), first (the records that end before it) and exit of every block.

    A block either sets the state whatever it was before, or keeps it, or swaps it: so the entry state is that of the last
    block that sets it, turned by each swap since.
    """
    maps = lines.select("file", "block", "line").mapInArrow(_maps, "file long, block long, exit_out boolean, n_out long, exit_in boolean, n_in long")
    by_file = Window.partitionBy("file").orderBy("block")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    swap = (F.col("exit_out") & ~F.col("exit_in")).cast("int")
    rows = shared.materialise(maps, "tsv-blocks").withColumn("swaps", F.sum(swap).over(by_file))
    sets = F.when(F.col("exit_out") == F.col("exit_in"), F.struct(F.col("exit_out").cast("int").alias("exit"), "swaps"))
    last = F.last(sets, ignorenulls=True).over(before)
    turned = F.coalesce(last["exit"], F.lit(0)) + F.coalesce(F.max("swaps").over(before), F.lit(0)) - F.coalesce(last["swaps"], F.lit(0))
    entered = rows.withColumn("entry", turned % 2 == 1)
    counted = entered.withColumn("n", F.when(F.col("entry"), F.col("n_in")).otherwise(F.col("n_out"))).withColumn("exit", F.when(F.col("entry"), F.col("exit_in")).otherwise(F.col("exit_out")))
    return counted.select("file", "block", "entry", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), "exit")


PIECE = pa.schema([("path", pa.string()), ("row_idx", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("raw", pa.string()), ("fields", pa.list_(pa.string()))])


def _pieces(batches):
    """Records with their fields, and the pieces of those that a block's end cuts; a record is named by the number of records
    that end before it. Lines and records are held as objects by batches.HELD_BYTES, besides the one that goes on."""
    key, path, held, index, inside, whole = None, None, [], 0, False, True
    out: list[tuple] = []
    size = 0

    def flush():
        nonlocal out, size
        rows, out, size = out, [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECE, strict=True)], schema=PIECE)

    for now, rows in _runs(batches):
        if now != key:
            if held:
                out.append((path, index, key[1], False, "\n".join(held), None))
            key, path, held = now, rows["path"][0].as_py(), []
            inside, index = rows["entry"][0].as_py(), rows["first"][0].as_py()
            whole = not inside
        for some in text_slices(rows, "line"):
            for line in some["line"].to_pylist():
                if not inside and line == "":
                    continue
                inside = leaves_open(line, inside) if '"' in line else inside
                held.append(line)
                if not inside:
                    raw = "\n".join(held) if len(held) > 1 else line
                    out.append((path, index, key[1], whole, raw, fields_of(raw) if whole else None))
                    held, whole, index, size = [], True, index + 1, size + len(raw)
                    if len(out) >= 4096 or size >= HELD_BYTES:
                        yield flush()
    if held:
        out.append((path, index, key[1], False, "\n".join(held), None))
    if out:
        yield flush()


def _with_fields(batches):
    for batch in batches:
        for some in text_slices(batch, "raw"):
            yield pa.RecordBatch.from_arrays([some["path"], some["row_idx"], pa.array([fields_of(r) for r in some["raw"].to_pylist()], pa.list_(pa.string())), some["raw"]], ["path", "row_idx", "fields", "raw"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """path, row_idx (from 0 in each file), fields and raw: the exact source text of a record without its line end.

    Empty lines outside quotes are no records. The files are read twice, once here for the state of every block. An
    uncompressed file is read by as many tasks as it has splits, a compressed one by one task, as a stream. Records that
    blocks cut, at most two pieces a block and a record's length each, are shuffled; no others are. More blocks than half a
    million are refused: larger splits (spark.sql.files.maxPartitionBytes) make fewer.
    """
    lines = _lines(spark, path)
    table = shared.materialise(blocks(lines), "tsv-entries")
    if table.count() * BLOCK_ROW > shared.BROADCAST_BYTES:
        raise ValueError("too many blocks: set spark.sql.files.maxPartitionBytes higher")
    ends = table.withColumn("last", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("block")))).filter("last = 1")
    if not ends.filter("exit").isEmpty():
        raise UnterminatedQuote("unterminated quote")
    pieces = "path string, row_idx long, block long, whole boolean, raw string, fields array<string>"

    def cut(where: str) -> DataFrame:
        known = F.broadcast(table.filter(where).select("file", "block", "entry", "first"))
        return lines.join(known, ["file", "block"]).mapInArrow(_pieces, pieces)

    records = cut("true").filter("whole").select("path", "row_idx", "fields", "raw")
    crossing = table.filter("entry OR exit")
    if not crossing.isEmpty():
        parts = cut("entry OR exit").filter("NOT whole").groupBy("path", "row_idx").agg(F.array_sort(F.collect_list(F.struct("block", "raw"))).alias("p"))
        joined = parts.select("path", "row_idx", F.array_join(F.transform("p", lambda x: x["raw"]), "\n").alias("raw"))
        records = records.unionByName(joined.mapInArrow(_with_fields, "path string, row_idx long, fields array<string>, raw string"))
    return records


def read_table(spark: SparkSession, path: str, columns: tuple[str, ...], header: bool) -> DataFrame:
    """The columns by position, all of them texts, and _corrupt: the source text of a record of another width, else null.

    header: each file's first record is left out. A record of a single empty field is none. Fields beyond the columns are
    cut off, and columns without a field are null; an empty field is the empty text.
    """
    rows = read_records(spark, path).filter((F.size("fields") > 1) | (F.get("fields", F.lit(0)) != ""))
    if header:
        rows = rows.filter("row_idx > 0")
    corrupt = F.when(F.size("fields") != len(columns), F.col("raw")).alias("_corrupt")
    return rows.select(*[F.get("fields", F.lit(i)).alias(c) for i, c in enumerate(columns)], corrupt)
