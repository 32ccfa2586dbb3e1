"""Document fingerprints: a Merkle tree over the paragraphs and sections of a text.

A text is cut into paragraphs, which end with a line break, and paragraphs into pieces, which end with a sentence or after
48 code points. A section ends with a blank paragraph, before a Markdown heading, or after a paragraph whose own hash ends
it (one in four), so an edit moves no cut beyond the section that it lies in. The hash of a piece is the SHA-256 of its
text, that of a paragraph, a section and the text (the root) the SHA-256 of its children's hashes. Equal roots mean equal
texts. Two trees are compared by going down only where branches differ, from the left and from the right, which gives the
span that an edit changed; what they have in common is told by their pieces.

A fingerprint is the tree as text: the root, then "|" and a branch for each section, "hash:" with paragraphs parted by ";",
each "hash=" with pieces parted by ",". Hashes below the root are cut to 16 digits; a piece is the hexadecimal number of
its code: 48 bits of its hash, then 7 bits of its length.

Only functions of Spark SQL are used. Array functions evaluate an outer value once for each element, so values that are
used in a lambda are bound by let() first; no step costs more than the text's length.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARAGRAPH = r"[^\n]*\n|[^\n]+"
#: A piece, of 64 code points at most.
PIECE = r"[^.!?]{1,48}(?:[.!?]{1,8} {0,8})?|[.!?]{1,8} {0,8}"
SHOWN, LENGTHS = 16, 128
#: A paragraph whose hash begins so ends its section.
ENDS = "[0-3]"
#: Bytes of text that meet in one task to find each document's next, and the most such groups.
GROUP_BYTES, MOST_GROUPS = 8 << 20, 1 << 15


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _hash(hashes: Column) -> Column:
    return F.sha2(F.array_join(hashes, "").cast("binary"), 256)


def _field(nodes: Column, name: str) -> Column:
    return F.transform(nodes, lambda x: x[name])


def _total(nodes: Column) -> Column:
    return F.aggregate(nodes, F.lit(0).cast("long"), lambda s, x: s + x["n"])


def weight(pieces: Column) -> Column:
    """Code points of pieces, by their codes."""
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda s, x: s + x % LENGTHS)


def _paragraph(line: Column) -> Column:
    """h, n and pieces of a paragraph."""
    pieces = F.transform(F.regexp_extract_all(line, F.lit(PIECE), F.lit(0)), lambda p: F.struct(F.sha2(p.cast("binary"), 256).alias("h"), F.length(p).alias("n")))

    def made(p: Column) -> Column:
        codes = F.transform(p, lambda x: F.conv(F.substring(x["h"], 1, 12), 16, 10).cast("long") * LENGTHS + x["n"])
        return F.struct(_hash(_field(p, "h")).alias("h"), F.length(line).alias("n"), codes.alias("pieces"))

    return let(pieces, made)


def _starts(paragraphs: Column, lines: Column) -> Column:
    """The positions that sections start at, from 0: the first, headings, and what follows a blank or an ending paragraph."""
    blank = F.transform(lines, lambda x, i: F.when(x.rlike(r"^[ \t\r]*\n$"), i + 1))
    ending = F.transform(paragraphs, lambda p, i: F.when(p["h"].rlike("^" + ENDS), i + 1))
    heading = F.transform(lines, lambda x, i: F.when(x.rlike("^#{1,6} "), i))
    at = F.concat(F.array(F.lit(0)), blank, ending, heading)
    return F.array_sort(F.array_distinct(F.filter(at, lambda i: i.isNotNull() & (i < F.size(lines)))))


def _section(paragraphs: Column) -> Column:
    return F.struct(_hash(_field(paragraphs, "h")).alias("h"), _total(paragraphs).alias("n"), paragraphs.alias("paragraphs"))


def sections(text: Column) -> Column:
    """The tree below the root: sections (h, n, paragraphs), paragraphs (h, n, pieces), pieces as codes. A null text counts as empty."""
    lines = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))

    def cut(ls: Column) -> Column:
        def of(ps: Column) -> Column:
            def slices(st: Column) -> Column:
                return F.transform(st, lambda s, k: _section(F.slice(ps, s + 1, F.coalesce(F.get(st, k + 1), F.size(ps)) - s)))

            return let(_starts(ps, ls), slices)

        return let(F.transform(ls, _paragraph), of)

    return let(lines, cut)


def root(tree: Column) -> Column:
    """The root hash, which only equal texts share; that of the empty text is the hash of no children."""
    return _hash(_field(tree, "h"))


def pieces(tree: Column) -> Column:
    """The distinct codes of a tree's pieces."""
    return F.array_distinct(F.flatten(F.transform(tree, lambda s: F.flatten(_field(s["paragraphs"], "pieces")))))


def as_text(tree: Column) -> Column:
    """The fingerprint of a tree of sections()."""

    def shown(p: Column) -> Column:
        return F.concat(F.substring(p["h"], 1, SHOWN), F.lit("="), F.array_join(F.transform(p["pieces"], lambda c: F.lower(F.hex(c))), ","))

    branches = F.transform(tree, lambda s: F.concat(F.lit("|"), F.substring(s["h"], 1, SHOWN), F.lit(":"), F.array_join(F.transform(s["paragraphs"], shown), ";")))
    return F.concat(root(tree), F.array_join(branches, ""))


def fingerprint(text: Column) -> Column:
    """The Merkle tree of a text, as text."""
    return let(sections(text), as_text)


def pieces_of(fp: Column) -> Column:
    """The distinct codes of the pieces of a fingerprint."""
    codes = F.regexp_extract_all(fp, F.lit("[=,]([0-9a-f]+)"), F.lit(1))
    return F.array_distinct(F.transform(codes, lambda c: F.conv(c, 16, 10).cast("long")))


def likeness(a: Column, b: Column) -> Column:
    """Twice the code points of the distinct pieces that two texts share, over those of both: 0 to 1; 1 if neither has any.

    a, b: pieces() of trees or pieces_of() fingerprints. 1 means equal texts or the same pieces in another order or number.
    """

    def shared(p: Column) -> Column:
        all_ = weight(p["a"]) + weight(p["b"])
        return F.when(all_ == 0, 1.0).otherwise(2.0 * weight(F.array_intersect(p["a"], p["b"])) / all_)

    return let(F.struct(a.alias("a"), b.alias("b")), shared)


def _same(x: Column, y: Column) -> Column:
    """How many elements two arrays share from the left."""
    return F.coalesce(F.nullif(F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False), F.lit(0)) - 1, F.size(x)).cast("int")


def _same_length(a: Column, b: Column, turn: Callable[[Column], Column]) -> Column:
    """Code points that two trees share from one end (turn orders branches): equal branches count whole by their hashes, and
    of the first branches that differ, the children are compared."""

    def at(x: Column, y: Column, keys: Callable[[Column], Column], total: Callable[[Column], Column], below: Callable[[Column, Column], Column] | None) -> Column:
        def level(p: Column) -> Column:
            def found(k: Column) -> Column:
                whole = total(F.slice(p["x"], 1, k))
                if below is None:
                    return whole
                return whole + F.when(k < F.least(F.size(p["x"]), F.size(p["y"])), below(F.get(p["x"], k), F.get(p["y"], k))).otherwise(0)

            return let(_same(keys(p["x"]), keys(p["y"])), found)

        return let(F.struct(turn(x).alias("x"), turn(y).alias("y")), level)

    by_hash = lambda nodes: _field(nodes, "h")
    leaves = lambda p, q: at(p["pieces"], q["pieces"], lambda c: c, weight, None)
    middle = lambda s, t: at(s["paragraphs"], t["paragraphs"], by_hash, _total, leaves)
    return at(a, b, by_hash, _total, middle)


def edit(a: Column, b: Column) -> Column:
    """start, before and after of the change that makes text a text b, by their trees: the code points that stay at the
    start, and the ends of the changed span in a and in b. Spans are whole pieces; equal texts have an empty one at their end."""

    def span(p: Column) -> Column:
        most = F.least(p["a"], p["b"])
        start = F.least(p["left"], most)
        tail = F.least(p["right"], most - start)
        return F.struct(start.alias("start"), (p["a"] - tail).alias("before"), (p["b"] - tail).alias("after"))

    return let(F.struct(_total(a).alias("a"), _total(b).alias("b"), _same_length(a, b, lambda x: x).alias("left"), _same_length(a, b, F.reverse).alias("right")), span)


def with_next(docs: DataFrame, columns: dict[str, Column], names: list[str]) -> DataFrame:
    """doc_id and text (null: empty) of each document, the columns computed from them one after the other, and next_<name>
    of the named columns of the document that follows by ascending doc_id; the last is followed by the first.

    Rows that repeat a doc_id follow one another by text; rows without a doc_id come last. Texts are shuffled once, to groups
    of neighbouring doc_ids, cut at quantiles so that a group holds about GROUP_BYTES; the first document of the next group
    joins each group as a guest. There are at most MOST_GROUPS; beyond that, groups grow and their sort spills to disk.
    """
    most = (1 << 63) - 1
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(most))
    rows = docs.select("doc_id", key.alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    count, size = rows.agg(F.count("*"), F.sum(F.octet_length("text").cast("long"))).first()
    groups = min(MOST_GROUPS, max(1, math.ceil((size or 0) / GROUP_BYTES)), max(1, count))
    shares = [i / groups for i in range(1, groups)]
    cuts = sorted(set(rows.agg(F.percentile_approx("k", shares or [0.5], max(10_000, 8 * groups))).first()[0] or [])) if shares else []
    bound = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    halves = [1 << i for i in reversed(range(max(1, len(cuts).bit_length())))]
    # binary search: the group is the number of cuts that the key reaches
    group = F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), lambda p, s: F.when(F.get(bound, p + s - 1) <= F.col("k"), p + s).otherwise(p))
    grouped = rows.withColumn("g", group)
    firsts = [tuple(r) for r in grouped.groupBy("g").agg(F.min("k").alias("k")).orderBy("g").collect()]  # one row a group
    guests = rows.sparkSession.createDataFrame([(firsts[i - 1][0], k) for i, (_, k) in enumerate(firsts)], "g int, k long")
    visiting = rows.join(F.broadcast(guests), "k").select("g", F.lit(True).alias("guest"), "doc_id", "k", "text")
    dealt = grouped.select("g", F.lit(False).alias("guest"), "doc_id", "k", "text").unionByName(visiting).repartition("g")
    # computed after the shuffle, before the window: once for each document
    for name, column in columns.items():
        dealt = dealt.withColumn(name, column)
    ordered = Window.partitionBy("g").orderBy("guest", "k", "text")
    return dealt.withColumns({f"next_{n}": F.lead(n).over(ordered) for n in names}).filter("NOT guest").drop("g", "guest", "k")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next, and the
    found edit: edit_start, edit_end (in the text) and edited_end (in the edited text).

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many, or all, of the next document.
    A single document is followed by itself. Every row has its own result; other columns are ignored.
    """
    rows = with_next(docs, {"tree": sections(F.col("text")), "pieces": pieces(F.col("tree"))}, ["text", "pieces"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    text = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut))
    own = ["doc_id", "n_chars", "tree", "pieces", "next_pieces"]
    edited = rows.select(*own, text.alias("edited")).select(*own, F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sections(F.col("edited")).alias("edited_tree"))
    found = edited.withColumn("span", edit(F.col("tree"), F.col("edited_tree")))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("tree")).alias("fingerprint"), as_text(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("pieces"), pieces(F.col("edited_tree"))).alias("near_edited"), likeness(F.col("pieces"), F.col("next_pieces")).alias("near_next"),
        F.col("span.start").alias("edit_start"), F.col("span.before").alias("edit_end"), F.col("span.after").alias("edited_end"),
    )
