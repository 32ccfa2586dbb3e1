"""Operator 9: personal data, by patterns and by information-theoretic sanitisation.

Patterns find the base spans. Their values are the protected entities. A word of a document with an entity discloses it
as far as it tells of it: from document counts over the whole corpus, disclosure = PMI(word; entity) / IC(entity), where
PMI = ln(N n(e,t) / (n(e) n(t))) and IC = ln(N / n(e)). Where a word at or over the threshold, seen with the entity in
min_docs documents or more, stands in a document of the entity, all its mentions outside base spans become spans of kind
``term`` (to be removed) or, below the removal threshold, ``general`` (to be generalised). min_docs is the support that
PMI needs: with one document every word found nowhere else would tell all. No text is shuffled, only hashes of words.

Defined results: null and empty texts have no spans; every row counts as a document, also one that repeats another, and
rows with equal doc_id and text have equal spans; an empty table gives no rows; other columns are ignored. Spans of one
kind never overlap.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm import common as C

KINDS = ("email", "ip", "card", "phone")
ADDED = ("general", "term")
# Possessive repeats and look-behinds give the leftmost matches of the plain patterns in time linear in the text.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_TERM = re.compile(r"[^\W\d_]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Distinct words a task counts before it hands them on.
FLUSH = 200_000
#: Pairs of entities and words of one document that one task makes; a document with more is dealt to several.
PAIRS = 1 << 20
SCAN = "row binary, doc_id long, counts array<long>, base string, entities array<long>, words array<struct<t:long,s:int,f:int>>, t long, df long"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all base matches, by kind as listed, then by start."""
    out = []
    if "@" in text:
        last = 0  # where the previous address ended
        for m in _DOMAIN.finditer(text):
            at = start = m.start()
            while start > last and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                out.append(("email", start, m.end()))
                last = m.end()
    if _DIGIT.search(text) is None:
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if not p[:-3].strip("0") else "999") <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _hash(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value.encode("utf-8")) - 2**63


def entity(text: str, kind: str, start: int, end: int) -> int:
    """The hash of a span's entity: its kind and value, however it is written."""
    value = text[start:end].lower() if kind == "email" else _NOT_DIGIT.sub("" if kind != "ip" else ".", text[start:end])
    return _hash(f"{kind}:{value}")


def occurrences(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(word, start, end) of every word of a text, lower-cased; start and end are -1 for a word that touches a span."""
    out, inside = [], sorted((s, e) for _, s, e in spans)
    at, reach = 0, -1  # spans before at begin before the word's end; the furthest of them ends at reach
    for m in _TERM.finditer(text):
        start, end = m.span()
        while at < len(inside) and inside[at][0] < end:
            reach = max(reach, inside[at][1])
            at += 1
        out.append((m[0].lower(), -1, -1) if start < reach else (m[0].lower(), start, end))
    return out


def row_key() -> Column:
    """What tells rows apart: a digest of doc_id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary")))


def scan(docs: DataFrame) -> DataFrame:
    """A row for each document (base spans; its entities and all its words if it has any), and rows (t, df) of how many documents hold a word."""

    def run(batches):
        df: Counter[int] = Counter()
        entry = pa.struct([("t", pa.int64()), ("s", pa.int32()), ("f", pa.int32())])
        shape = pa.schema([("row", pa.binary()), ("doc_id", pa.int64()), ("counts", pa.list_(pa.int64())), ("base", pa.string()), ("entities", pa.list_(pa.int64())), ("words", pa.list_(entry)), ("t", pa.int64()), ("df", pa.int64())])
        hashes: dict[str, int] = {}

        def hashed(word: str) -> int:
            h = hashes.get(word)
            if h is None:
                if len(hashes) >= FLUSH:
                    hashes.clear()
                h = hashes[word] = _hash(word)
            return h

        def record(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in shape], schema=shape)

        def counted() -> pa.RecordBatch:
            out = record(len(df), t=np.fromiter(df.keys(), np.int64, len(df)), df=np.fromiter(df.values(), np.int64, len(df)))
            df.clear()
            return out

        for batch in batches:
            for part in C.blocks(batch):
                counts, base, entities, at, words = [], [], [], [0], ([], [], [])
                for text in part.column("text").to_pylist():
                    text = text or ""
                    spans = base_spans(text)
                    kinds = Counter(k for k, _, _ in spans)
                    counts.append([kinds[k] for k in KINDS])
                    base.append(",".join(f"{k}:{s}:{e}" for k, s, e in spans))
                    entities.append(list({entity(text, *x) for x in spans}))
                    if spans:
                        for word, s, f in occurrences(text, spans):
                            words[0].append(hashed(word))
                            words[1].append(s)
                            words[2].append(f)
                        df.update(set(words[0][at[-1] :]))
                    else:
                        df.update(map(hashed, {w.lower() for w in set(_TERM.findall(text))}))
                    at.append(len(words[0]))
                held = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(words, entry, strict=True)], fields=list(entry))
                held = pa.ListArray.from_arrays(pa.array(at, pa.int32()), held, type=shape.field("words").type)
                yield record(part.num_rows, row=part.column("row"), doc_id=part.column("doc_id"), counts=counts, base=base, entities=entities, words=held)
                if len(df) >= FLUSH:
                    yield counted()
        yield counted()

    return docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCAN)


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if C.small_enough(df, row_bytes) else df


def disclosing(scanned: DataFrame, threshold: float, min_docs: int) -> DataFrame:
    """(row, t, disclosure), written, of the words of each document that tell enough of one of its entities.

    An entity and a word count as seen together in every document that holds both. Pairs are made only where the counts
    of the two allow the threshold at all: n_et is at most n_e and n_t, and the disclosure rises with it.
    """
    docs = scanned.filter(F.col("row").isNotNull())
    n = docs.count()
    held = docs.filter(F.size("entities") > 0)
    # times: the rows of one doc_id and text, which are documents of their own here as they are in n and n_t
    parts = F.ceil(F.size("entities").cast("long") * F.size("words") / PAIRS).cast("int").alias("parts")
    seen = held.select("row", parts, F.explode("entities").alias("e")).groupBy("row", "parts", "e").agg(F.count("*").alias("times"))
    entities = C.materialise(seen.groupBy("e").agg(F.sum("times").alias("n_e")).filter(F.col("n_e").between(min_docs, n - 1)), "entities")
    named = C.materialise(seen.join(broadcast_if_small(entities, 32), "e"), "named")
    here = C.materialise(named.groupBy("row").agg(F.max("n_e").alias("most")), "named-rows")
    words = scanned.filter(F.col("t").isNotNull()).groupBy("t").agg(F.sum("df").alias("n_t")).filter(F.col("n_t") >= min_docs)
    told = held.select("row", parts, "words.t").join(broadcast_if_small(here, 48), "row")
    told = told.select("row", "parts", "most", F.explode(F.array_distinct("t")).alias("t")).distinct().join(words, "t")
    # a word that is too common for the document's commonest entity is so for all: the disclosure falls as n_t / n_e rises
    common = F.log(F.lit(float(max(n, 1))) / F.col("n_t")) >= (threshold - 1e-9) * F.log(F.lit(float(max(n, 1))) / F.col("most"))
    told = told.filter(common | (F.col("n_t") <= F.col("most"))).drop("most").withColumn("part", F.pmod(F.xxhash64("t"), F.greatest("parts", F.lit(1)))).drop("parts")
    dealt = named.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("parts", F.lit(1)).cast("long") - 1))).drop("parts")

    def disclosure(n_et: Column) -> Column:
        pmi = F.log(F.lit(float(max(n, 1))) * n_et / (F.col("n_e") * F.col("n_t")))
        return pmi / F.log(F.lit(float(max(n, 1))) / F.col("n_e"))

    together = dealt.join(told, ["row", "part"]).filter(disclosure(F.least("n_e", "n_t")) >= threshold - 1e-9)
    together = C.materialise(together.select("row", "e", "t", "n_e", "n_t", "times"), "together")
    pairs = together.groupBy("e", "t").agg(F.sum("times").alias("n_et"), F.min("n_e").alias("n_e"), F.min("n_t").alias("n_t")).filter(F.col("n_et") >= min_docs)
    telling = C.materialise(pairs.select("e", "t", disclosure(F.col("n_et")).alias("disclosure")).filter(F.col("disclosure") >= threshold), "telling")
    told = together.select("row", "e", "t").join(broadcast_if_small(telling, 48), ["e", "t"]).groupBy("row", "t").agg(F.max("disclosure").alias("disclosure"))
    told = C.materialise(told, "disclosing")
    for step in (entities, named, here, together, telling):
        C.release(step)
    return told


def find(docs: DataFrame, threshold: float = 0.9, removal: float = 0.97, min_docs: int = 3) -> DataFrame:
    """row, doc_id, counts, base and added (array of kind, start, end) of every row of docs."""
    scanned = C.materialise(scan(docs), "pii")
    telling = broadcast_if_small(disclosing(scanned, threshold, min_docs), 64)
    rows = scanned.filter(F.col("row").isNotNull())
    words = rows.filter(F.size("entities") > 0).select("row", F.explode("words").alias("w")).select("row", "w.*").filter("s >= 0")
    kind = F.when(F.col("disclosure") >= removal, ADDED[1]).otherwise(ADDED[0]).alias("kind")
    spans = words.join(telling, ["row", "t"]).select("row", F.struct(kind, "s", "f").alias("a")).groupBy("row").agg(F.sort_array(F.collect_set("a")).alias("added"))
    return rows.drop("entities", "words", "t", "df").join(spans, "row", "left")


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row."""
    added = F.array_join(F.transform("added", lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["f"].cast("string"))), ",")
    found = find(docs, **options)
    counts = [F.col("counts")[i].alias(f"n_{k}") for i, k in enumerate(KINDS)]
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), added)
    return found.select("doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


def sanitised(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Base spans become the name of their kind, general terms a class, terms go; spans that overlap are one, by the first."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], "[WORD]" if kind == "general" else "[REMOVED]" if kind == "term" else f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """docs with the spans in text replaced; n_chars follows. Texts without spans stay as they are.

    Added spans, few as they are, are broadcast below a checked size and joined by shuffle above it; the base spans are
    found again where the text is.
    """
    given, docs = docs.columns, C.plainly_named(docs)
    key, row, added = (C.free_name(docs, n) for n in ("_key", "_row", "_added"))
    found = find(docs, **options).filter(F.col("added").isNotNull()).select(F.col("row").alias(row), F.col("added").alias(added)).dropDuplicates([row])
    found = C.materialise(found, "added")
    names, schema = docs.columns, docs.schema
    held = found.agg(F.count("*"), F.sum(F.size(added))).first()
    small = 64 * (held[0] or 0) + 48 * (held[1] or 0) <= C.BROADCAST_BYTES
    joined = docs.withColumn(key, row_key()).join(F.broadcast(found) if small else found, F.col(key) == F.col(row), "left").drop(row, key)

    def run(batches):
        for batch in batches:
            for part in C.blocks(batch):
                texts, added = part.column("text").to_pylist(), part.column(part.num_columns - 1).to_pylist()
                out = []
                for text, more in zip(texts, added, strict=True):
                    spans = base_spans(text or "") + [(m["kind"], m["s"], m["f"]) for m in more or []]
                    out.append(sanitised(text, spans) if spans else text)
                cols = {n: part.column(n) for n in names} | {"text": pa.array(out, part.column("text").type)}
                if "n_chars" in cols:
                    kind, old = cols["n_chars"].type, cols["n_chars"].to_pylist()
                    cols["n_chars"] = pa.array([o if a is b or a == b else len(b) for a, b, o in zip(texts, out, old, strict=True)], kind)
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return joined.mapInArrow(run, schema).toDF(*given)
