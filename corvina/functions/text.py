"""Text functions as Column builders. ASCII word bounds and Unicode white space are spelled out, since the regular
expressions of the JVM treat them otherwise than the semantics asked for."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zones with their canonical form (empty: the match itself, lower-cased), part and heading patterns.
ZONES = (
    (r"RH", "RH"), (r"LH", "LH"), (r"right-hand", "right-hand"), (r"left-hand", "left-hand"), (r"right", "right"), (r"left", "left"),
    (r"forward", "forward"), (r"aft", "aft"), (r"frame\s+\d+(?:/\d+)?", ""), (r"station\s+\d+", ""),
)
GENERIC_WORDS = "scope|reference|references|purpose|abbreviations|acronyms|requirements|manual|familiarization|policy|appendix|table of contents"
PART_WORDS = (
    "door|frame|panel|tank|wing|window|windshield|fuselage|rib|spar|valve|pump|seal|flap|gear|screen|orifice|drain|hinge|sensor|duct|pipe|skin|bracket|"
    "beam|bulkhead|fairing|actuator|reservoir|strut|spoiler|aileron|rudder|elevator|nacelle|cowl|latch|handle"
)
ADMIN_WORDS = "confidential|administrative office|appendix|table of contents"
SECTION = r"^\(?\d+(?:\.\d+)*\)?[\s.:_-]+"
# End of fixed values.

SPACE = r"[\s   -     　﻿]"
LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: Latin letters with marks below U+0250 and the letters that they decompose to.
_MARKED = [(chr(c), d[0]) for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(c))) > 1]
#: All other characters whose NFKD form holds ASCII, with that: one letter for most, up to WIDE for ligatures and the like.
_FOLDED = {chr(c): a for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and (a := "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if x < "\x80"))}
WIDE = max(map(len, _FOLDED.values()))
_ONE = {c: a for c, a in _FOLDED.items() if len(a) == 1}
_MORE = {c: a for c, a in _FOLDED.items() if len(a) > 1}
#: The characters of several letters, and their letters side by side, each filled up to WIDE with a character that goes later.
MORE, LETTERS = "".join(_MORE), "".join(a.ljust(WIDE, "\x80") for a in _MORE.values())
TOKEN = r"[\p{L}\p{N}]+"
MARKED, PLAIN = "".join(a for a, _ in _MARKED), "".join(b for _, b in _MARKED)


def word(pattern: str, flags: str = "(?i)") -> str:
    """pattern between ASCII word bounds."""
    return f"{flags}{LEFT}(?:{pattern}){RIGHT}"


def js_trim(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def compact(x: Column) -> Column:
    """White space collapsed to single spaces, trimmed."""
    return F.trim(F.regexp_replace(x, f"{SPACE}+", " "))


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _spread(x: Column) -> Column:
    """x with characters of several letters spelled out; only characters outside ASCII are looked up."""
    at = lambda c: F.position(c, F.lit(MORE))
    letters = lambda c: let(at(c), lambda i: F.when(i > 0, F.substring(F.lit(LETTERS), (i - 1) * WIDE + 1, F.lit(WIDE))).otherwise(F.lit("")))
    parts = F.regexp_extract_all(x, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]"), F.lit(0))
    return F.array_join(F.transform(parts, lambda c: F.when(F.ascii(c) < 128, c).otherwise(letters(c))), "")


def fold(x: Column) -> Column:
    """NFKD, all but ASCII removed, lower case, inside the JVM: é is e, ﬁ is fi, ２ is 2."""
    other = r"[^\x00-\x7F]"
    folded = let(F.translate(x, "".join(_ONE), "".join(_ONE.values())), lambda s: F.regexp_replace(F.when(s.rlike(other), _spread(s)).otherwise(s), other, ""))
    return F.lower(F.when(x.rlike(other), folded).otherwise(x))


def query_tokens(x: Column, distinct: bool = True) -> Column:
    """Runs of two or more ASCII letters and digits of the folded text, in order."""
    tokens = F.regexp_extract_all(fold(x), F.lit("[a-z0-9]{2,}"), F.lit(0))
    return F.array_distinct(tokens) if distinct else tokens


def raw_tokens(x: Column) -> Column:
    """Runs of letters and digits, lower-cased, with their marks."""
    return F.regexp_extract_all(F.lower(x), F.lit(TOKEN), F.lit(0))


def unmarked(x: Column) -> Column:
    """Latin letters without their marks; slow by the character, so best used on single distinct tokens."""
    return F.translate(x, MARKED, PLAIN)


def index_tokens(x: Column) -> Column:
    """Runs of letters and digits, lower-cased, without marks; other letters stay."""
    return raw_tokens(unmarked(x))


def match_query(tokens: Column, operator: str = "AND") -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.concat(t, F.lit("*"))), f" {operator} ")


def title_case(x: Column) -> Column:
    return F.initcap(compact(x))


def candidate_label(x: Column) -> Column:
    return compact(F.regexp_replace(x, r"(?i)<br\s*/?>", " "))


def slugify(x: Column, cap: int | None = 96) -> Column:
    """ASCII slug; over cap characters: a cut slug and ten hex digits of the whole slug's SHA-1."""
    base = F.regexp_replace(F.regexp_replace(fold(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    if cap is None:
        return base
    cut = F.regexp_replace(F.substring(base, 1, cap - 11), "-+$", "")
    return F.when(F.length(base) <= cap, base).otherwise(F.concat(cut, F.lit("-"), F.substring(F.sha1(base), 1, 10)))


def stable_slug(x: Column, cap: int = 160) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, cap)


#: The collation of lists and titles that people read: accents and case decide only between names that are else equal.
LOCALE = "UNICODE"


def in_locale(x: str | Column) -> list[Column]:
    """Sort keys by the Unicode collation's root order; names that it holds equal go by their bytes."""
    x = F.col(x) if isinstance(x, str) else x
    return [F.collate(x, LOCALE), x]


def locale_sorted(x: Column) -> Column:
    """An array of texts in the order of in_locale(): sorting keeps the order by bytes of those that the collation holds equal."""
    collated = F.array_sort(F.transform(F.array_sort(x), lambda v: F.collate(v, LOCALE)))
    return F.transform(collated, lambda v: F.collate(v, "UTF8_BINARY"))


def unique_sorted(x: Column) -> Column:
    """Trimmed, non-empty, distinct, in the order of in_locale()."""
    return locale_sorted(F.array_distinct(F.filter(F.transform(x, js_trim), lambda v: v != "")))


def ata_codes(*texts: Column) -> Column:
    codes = F.regexp_extract_all(F.concat_ws("\n", *texts), F.lit(word(r"ATA[\s-]?(\d{2})")), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(codes, lambda c: F.concat(F.lit("ATA-"), c))))


def zones(text: Column) -> Column:
    found = []
    for pattern, name in ZONES:
        hits = F.regexp_extract_all(text, F.lit(word(pattern)), F.lit(0))
        found.append(F.transform(hits, (lambda n: lambda z: F.lit(n))(name) if name else lambda z: F.lower(z)))
    return F.array_sort(F.array_distinct(F.concat(*found)))


def part_numbers(text: Column) -> Column:
    return unique_sorted(F.regexp_extract_all(text, F.lit(word("[A-Z0-9]+(?:-[A-Z0-9]+){2,}", "")), F.lit(0)))


def is_part_candidate(label: Column) -> Column:
    """Whether a normalised label may name a part."""
    return (
        F.length(label).between(4, 400)
        & ~label.rlike(SECTION)
        & ~label.rlike(word(GENERIC_WORDS))
        & (label.rlike(word(PART_WORDS)) | label.rlike(word(r"ATA[\s-]?\d{2}")))
    )


def split_parts(field: Column) -> Column:
    labels = F.transform(F.split(F.coalesce(field, F.lit("")), "[;,|]"), candidate_label)
    return unique_sorted(F.filter(labels, lambda p: (F.length(p) >= 3) & is_part_candidate(p)))


def heading_candidates(content: Column) -> Column:
    """Markdown headings of levels 1 to 3 that may name a part: the first three, then distinct and sorted."""
    heads = F.transform(F.regexp_extract_all(content, F.lit(r"(?m)^#{1,3}\s+(.+)$"), F.lit(1)), candidate_label)
    fit = F.filter(heads, lambda h: F.length(h).between(4, 120) & is_part_candidate(h) & (F.lower(h) != "airbus") & ~h.rlike(f"(?i){ADMIN_WORDS}"))
    return unique_sorted(F.slice(fit, 1, 3))


def task_kind(doc: Column, chunk_id: Column, content: Column) -> Column:
    """Three digits out of chunk_id, else content, else doc; empty if none."""
    tries = (F.regexp_extract(chunk_id, r"-(\d{3})-", 1), F.regexp_extract(content, r"(?<=[A-Za-z0-9_])-\s*(\d{3})\s*:", 1), F.regexp_extract(doc, word(r"(\d{3})", ""), 1))
    return F.coalesce(*[blank_to_null(t) for t in tries], F.lit(""))


def result_identity(doc: Column, chunk_id: Column) -> Column:
    """Identity of a ranked row: of doc, or where that is null of chunk_id, the file stem before the first space."""
    first = F.split(F.coalesce(doc, chunk_id), " ")[0]
    return F.lower(F.regexp_replace(F.regexp_replace(first, "^.*/", ""), r"(?<=.)\.[^.]*$", ""))


def page_root(doc: Column) -> Column:
    return F.regexp_replace(doc, r"_page_\d+.*$", ".pdf")


def page_number(doc: Column) -> Column:
    return F.coalesce(F.regexp_extract(doc, r"_page_(\d+)", 1).try_cast("int"), F.lit(0))


def image_alt_texts(markdown: Column) -> Column:
    alts = F.transform(F.regexp_extract_all(markdown, F.lit(r"!\[([^\]]+)\]\([^)]+\)"), F.lit(1)), compact)
    return F.filter(alts, lambda a: a != "")


def visible_lines(markdown: Column) -> Column:
    bare = F.split(F.regexp_replace(markdown, r"!\[[^\]]*\]\([^)]*\)", "\n"), r"\r?\n")
    clean = F.transform(bare, lambda x: compact(F.regexp_replace(F.regexp_replace(x, r"^#{1,6}\s*", ""), r"(?i)<br\s*/?>", " ")))
    return F.filter(clean, lambda x: x != "")


def approx_bytes(data_url: Column) -> Column:
    return F.floor(F.length(F.substring_index(data_url, ",", -1)) * 3 / 4)


def int_or_zero(x: Column) -> Column:
    return F.coalesce(F.regexp_extract(x, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def includes_alias(text: Column, aliases: Column) -> Column:
    """Whether the text holds an alias of three letters or more, in any case."""
    return F.exists(aliases, lambda a: (F.length(F.trim(a)) >= 3) & F.contains(F.lower(text), F.lower(F.trim(a))))


def lists_alias(values: Column, aliases: Column) -> Column:
    """Whether some value and some alias of three letters or more equal or hold one another, in any case."""
    def meets(a: Column) -> Column:
        return F.exists(values, lambda v: F.contains(F.lower(v), F.lower(F.trim(a))) | F.contains(F.lower(F.trim(a)), F.lower(v)))

    return F.exists(aliases, lambda a: (F.length(F.trim(a)) >= 3) & meets(a))


def article_body(markdown: Column) -> Column:
    """A wiki page without its title and the closing sections."""
    no_title = F.regexp_replace(markdown, r"^# [^\n]*\n+", "")
    return js_trim(F.regexp_replace(no_title, r"(?s)\n## (?:Linked images|Technical documents|Linked occurrences)\b.*$", ""))


def tsv_field(x: Column) -> Column:
    """A field of an escaped TSV file: quoted only where it must be."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(x.rlike(r'["\t\r\n\\]'), quoted).otherwise(x)


def markdown_row(*cells: Column) -> Column:
    """A line of a Markdown table: bars are escaped and white space is collapsed."""
    plain = [F.replace(compact(F.coalesce(c.cast("string"), F.lit(""))), F.lit("|"), F.lit("\\|")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *plain), F.lit(" |"))


def template(text: str | Column, values: dict[str, Column]) -> Column:
    """{{name}} replaced by each value in turn."""
    out = F.lit(text) if isinstance(text, str) else text
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def sse_block(event: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def sorted_json(entries: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))
