"""Full-text search: an index of postings and document lengths, and weighted BM25 over batches of prefix queries.

An index may have bounds: its documents form blocks of like length, and a row of maxima for each term and block bounds what the
block's documents can score. A search then scores a few promising blocks first, and after them only those whose bound reaches
the score of the last place. It pays where lengths and frequencies differ much between documents; ranks are the same.
"""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions import text as X
from corvina.sources import shared

K1, B = 1.2, 0.75
#: Idf of a term that half of the rows or more hold.
IDF_FLOOR = 1e-6
#: The head of terms that no query token can begin: these are ASCII letters and digits, two at least.
OTHER = "_"
#: Bytes of the texts whose tokens one task counts; it holds some fifty times that.
TASK_BYTES = 8 << 20

#: Lengths within a factor of the fourth root of two are one band; a block is a band of one slot of documents.
BANDS = 256
#: Documents of a block, about, where lengths fall into some sixteen bands.
BLOCK_DOCS = 64
#: Blocks a query scores first, by falling bound.
SEEDS = 8
#: Bounds and scores are sums in different orders; scores are compared to nine digits.
SLACK = 1e-8
#: Bytes of a picked block, or of a query's token, in a broadcast.
PICKED = 128


class Index(NamedTuple):
    """postings: (head, term, id, wtf, n, dl), head being the term's first two characters; totals: one row (n_rows, avgdl).

    With bounds, postings are placed(), and blocks are their block_rows(), in any number of rows a term and block.
    """

    postings: DataFrame
    totals: DataFrame
    blocks: DataFrame | None = None


def _tokens(rows: DataFrame, id_: str, weights: dict[str, float]) -> DataFrame:
    """id, dl, w and raw: every token of every field with the field's weight, and the number of tokens of the row."""
    fields = [X.raw_tokens(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in weights]
    by_field = F.array(*[F.struct(F.lit(float(w)).alias("w"), t.alias("t")) for t, w in zip(fields, weights.values(), strict=True)])
    counted = rows.select(F.col(id_).alias("id"), by_field.alias("f")).withColumn("dl", F.aggregate("f", F.lit(0), lambda n, x: n + F.size(x["t"])).cast("long"))
    # there is always a field; of inline(), Spark would infer a filter on f and push it, with all regexps, to where rows are read
    return counted.select("id", "dl", F.inline_outer("f")).select("id", "dl", "w", F.explode("t").alias("raw"))


def head_of(term: Column) -> Column:
    head = F.substring(term, 1, 2)
    return F.when(head.rlike("^[a-z0-9]{2}$"), head).otherwise(OTHER)


def tasks(rows: DataFrame, fields: list[str]) -> int:
    """How many tasks count the tokens of rows: one for TASK_BYTES of text, more while there are cores for a MB of it each."""
    size = sum((F.coalesce(F.octet_length(F.col(f).cast("string")), F.lit(0)) for f in fields), F.lit(0).cast("long"))
    n_bytes = rows.agg(F.sum(size)).first()[0] or 0
    return max(1, -(-n_bytes // TASK_BYTES), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // (1 << 20))))


def postings(rows: DataFrame, id_: str, weights: dict[str, float]) -> DataFrame:
    """head, term, id, wtf (weighted frequency), n (plain) and dl (tokens of the row).

    Rows are dealt by id while they are texts; counts then stay where they are, so tokens are not shuffled by them. Texts are
    dealt by their counted bytes, TASK_BYTES to a task: a number that is given is kept, where Spark would join small parts.
    """
    texts = rows.select(id_, *[f for f in weights if f != id_])
    dealt = texts.repartition(tasks(texts, list(weights)), F.col(id_))
    raw = F.col("raw")
    plain = F.when(F.octet_length(raw) > F.length(raw), X.unmarked(raw)).otherwise(raw)
    merged = _tokens(dealt, id_, weights).select("id", "dl", plain.alias("term"), "w").groupBy("id", "dl", "term").agg(F.sum("w").alias("wtf"), F.count("*").alias("n"))
    return merged.select(head_of(F.col("term")).alias("head"), "term", "id", "wtf", "n", "dl")


def placed(postings: DataFrame) -> DataFrame:
    """postings with lcp, nth and block, the band of the least of the id's lengths.

    lcp: characters shared with the row's term before in order, 0 where the first two differ, so that the postings under a
    prefix of which lcp is smaller count its rows. nth: which of the id's lengths, where rows that differ in length share one.
    """
    by_id = Window.partitionBy("id").orderBy("dl", "term")
    near = postings.select("*", F.lag("term").over(by_id).alias("_p"), F.lag("dl").over(by_id).alias("_d"), F.first("dl").over(by_id).alias("_least"), F.dense_rank().over(Window.partitionBy("id").orderBy("dl")).alias("nth"))
    differs = F.zip_with(F.split("_p", ""), F.split("term", ""), lambda x, y: ~x.eqNullSafe(y))
    same = (F.col("_d") == F.col("dl")) & (F.substring("_p", 1, 2) == F.substring("term", 1, 2))
    lcp = F.when(same, F.array_position(differs, True) - 1).otherwise(0).cast("int")
    band = F.least(F.floor(F.log2(F.col("_least") + 1) * 4), F.lit(BANDS - 1)).cast("long")
    return near.select("head", "term", "id", "wtf", "n", "dl", lcp.alias("lcp"), "nth", band.alias("block"))


def with_slots(postings: DataFrame, n_docs: int) -> DataFrame:
    """postings with the blocks of an index of n_docs documents: their bands, of as many slots as keep blocks small."""
    slots = max(1, n_docs // (16 * BLOCK_DOCS))
    return postings.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(slots)) * BANDS + F.col("block") % BANDS)


def block_rows(postings: DataFrame) -> DataFrame:
    """head, term, block, lcp, rows, wtf and nth (largest) and dl (least) of postings whose terms a query may ask for.

    Every batch is grouped where it is read: written postings are sorted by term and block, so what a batch cuts is one group,
    and readers group once more. Nothing is shuffled.
    """
    names = ["head", "term", "block", "lcp"]

    def grouped(batches):
        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch]).group_by(names, use_threads=False).aggregate([("wtf", "max"), ("nth", "max"), ("dl", "min"), ("n", "count", pc.CountOptions(mode="all"))])
                t = t.select([*names, "n_count", "wtf_max", "nth_max", "dl_min"]).rename_columns([*names, "rows", "wtf", "nth", "dl"])
                yield from t.combine_chunks().to_batches()

    asked = postings.filter(F.col("head") != OTHER).select(*names, "wtf", "nth", "dl", "n")
    return asked.mapInArrow(grouped, "head string, term string, block long, lcp int, rows long, wtf double, nth int, dl long")


def field_sizes(fields) -> Column:
    """The number of tokens over all fields of a row, unweighted."""
    sizes = [F.regexp_count(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit(X.TOKEN)) for f in fields]
    return sum(sizes[1:], sizes[0]).cast("long")


def lengths(rows: DataFrame, id_: str, fields: list[str]) -> DataFrame:
    """id and dl, the number of tokens over all fields, unweighted."""
    return rows.select(F.col(id_).alias("id"), field_sizes(fields).alias("dl"))


def indexed(rows: DataFrame, id_: str, weights: dict[str, float], bounded: bool = False) -> Index:
    """The index of rows, with bounds if asked for, not written anywhere: for few rows, unlike sources.segments."""
    total = lengths(rows, id_, list(weights)).agg(F.count("*").alias("n_rows"), F.avg("dl").alias("avgdl"))
    found = postings(rows, id_, weights)
    if not bounded:
        return Index(found, total)
    found = placed(found)
    return Index(found, total, block_rows(found))


def search(rows: DataFrame, queries: DataFrame, id_: str, weights: dict[str, float], limit: int = 10, mode: str = "fallback", keep: DataFrame | None = None, order: tuple = ("id",)) -> DataFrame:
    """search_index() over rows that have no written index."""
    return search_index(indexed(rows, id_, weights), queries, limit, mode, keep, order)


def _asked(queries: DataFrame) -> tuple[DataFrame, Column]:
    """query_id, n_tokens and token of queries, and the condition on heads that they need: 36 * 36 at most."""
    asked = queries.select("query_id", X.query_tokens(F.col("query")).alias("tokens")).filter(F.size("tokens") > 0)
    asked = asked.select("query_id", F.size("tokens").alias("n_tokens"), F.explode("tokens").alias("token")).withColumn("head", F.substring("token", 1, 2))
    return asked, F.col("head").isin([r[0] for r in asked.select("head").distinct().collect()])


def bounds(index: Index, queries: DataFrame, needed: tuple[DataFrame, Column] | None = None) -> DataFrame:
    """query_id, n_tokens, token, head, block, idf, avgdl, bound and most, for each block that has the token.

    bound: what the token can add to the score of the block's documents, whose counts of it are most at most.
    """
    asked, near = needed or _asked(queries)
    few = F.broadcast if shared.is_small(asked, PICKED) else lambda df: df
    wanted = few(asked.select("token", "head").distinct())
    first = F.when(F.col("lcp") < F.length("token"), F.col("rows")).otherwise(0)
    terms = index.blocks.filter(near).join(wanted, "head").filter(F.startswith("term", "token"))
    terms = terms.groupBy("token", "head", "block", "term").agg(F.max("wtf").alias("tf"), F.min("dl").alias("dl"), F.max("nth").alias("nth"), F.sum(first).alias("n"))
    blocks = terms.groupBy("token", "head", "block").agg(F.sum("tf").alias("tf"), F.min("dl").alias("dl"), F.max("nth").alias("most"), F.sum("n").alias("n"))
    idf = _idf(blocks.groupBy("token").agg(F.sum("n").alias("n")), index.totals)
    known = blocks.join(few(idf), "token").withColumn("bound", F.col("most") * _part())
    return few(asked).join(known.select("token", "block", "idf", "avgdl", "bound", "most"), "token")


def _idf(df: DataFrame, totals: DataFrame) -> DataFrame:
    raw = F.log((F.col("n_rows") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    return df.join(F.broadcast(totals)).select("token", "avgdl", F.when(raw > 0, raw).otherwise(IDF_FLOOR).alias("idf"))  # one row of totals


def _part() -> Column:
    """What a token of frequency tf adds to the score of a row of dl tokens: it rises with tf and falls with dl."""
    return F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def _scored_all(index: Index, asked: DataFrame, near: Column, keep: DataFrame | None) -> DataFrame:
    """query_id, n_tokens, id, bm25 and n_matched of every document that has a token.

    Tokens are broadcast if they are few, by count: postings are then joined where they are read, and no task gets all those of
    a head or token. Counts of tf are those of rows, and let both uses of hits read one shuffle.
    """
    few = F.broadcast if shared.is_small(asked, PICKED) else lambda df: df
    wanted = few(asked.select("token", "head").distinct())
    hits = index.postings.filter(near).join(wanted, "head").filter(F.startswith("term", "token")).groupBy("token", "id", "dl").agg(F.sum("wtf").alias("tf"))
    idf = _idf(hits.groupBy("token").agg(F.count("tf").alias("n")), index.totals)
    scored = hits.join(few(idf), "token").select("token", "id", _part().alias("part"))
    found = few(asked).join(scored, "token").groupBy("query_id", "n_tokens", "id").agg((-F.sum("part")).alias("bm25"), F.count("*").alias("n_matched"))
    return found if keep is None else found.join(keep, "id")


def _scored(index: Index, picked: DataFrame, near: Column, keep: DataFrame | None) -> DataFrame:
    """query_id, n_tokens, id, bm25 and n_matched of all documents in picked, rows of bounds() for whole queries and blocks."""
    picked = shared.broadcast_if_small(picked.select("query_id", "n_tokens", "token", "head", "block", "idf", "avgdl"), PICKED)
    hits = index.postings.filter(near).join(picked, ["head", "block"]).filter(F.startswith("term", "token"))
    hits = hits.groupBy("query_id", "n_tokens", "token", "id", "dl", "idf", "avgdl").agg(F.sum("wtf").alias("tf"))
    found = hits.select("query_id", "n_tokens", "id", _part().alias("part")).groupBy("query_id", "n_tokens", "id").agg((-F.sum("part")).alias("bm25"), F.count("*").alias("n_matched"))
    return found if keep is None else found.join(keep, "id")


def picked_blocks(index: Index, queries: DataFrame, limit: int = 10, mode: str = "fallback", keep: DataFrame | None = None, needed: tuple[DataFrame, Column] | None = None) -> DataFrame:
    """The rows of bounds() that a search for the first limit rows has to score; written, as several jobs read them.

    The SEEDS blocks of the largest bounds are scored first. Their row of place limit is a score the others must reach, so a
    block stays if the sum of its tokens' bounds does. Rows of all tokens, where they are asked for or come first, can only be
    in blocks that have all.
    """
    needed = needed or _asked(queries)
    all_, near = shared.materialise(bounds(index, queries, needed), "bounds"), needed[1]
    by_block = all_.groupBy("query_id", "n_tokens", "block").agg(F.sum("bound").alias("bound"), F.sum("most").alias("most"))
    by_block = by_block.select("query_id", "block", "bound", (F.col("most") >= F.col("n_tokens")).alias("whole"))
    if mode == "and":
        by_block = by_block.filter("whole")
    first = [F.desc("whole")] if mode == "fallback" else []
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*first, F.desc("bound"), "block"))
    seeds = by_block.withColumn("_place", place).filter(F.col("_place") <= SEEDS)
    found = _scored(index, all_.join(seeds.select("query_id", "block"), ["query_id", "block"]), near, keep)
    full = F.col("n_matched") == F.col("n_tokens")
    found = found.filter(full) if mode == "and" else found
    by_query = Window.partitionBy("query_id")
    found = found.select("query_id", (-F.col("bm25")).alias("score"), full.alias("full"))
    best = found.withColumn("_any", F.row_number().over(by_query.orderBy(F.desc("score")))).withColumn("_full", F.row_number().over(Window.partitionBy("query_id", "full").orderBy(F.desc("score"))))
    reach = best.filter((F.col("_any") <= limit) | (F.col("full") & (F.col("_full") <= limit))).groupBy("query_id").agg(
        F.max(F.when(F.col("_any") == limit, F.col("score"))).alias("any"),
        F.max(F.when(F.col("full") & (F.col("_full") == limit), F.col("score"))).alias("all"),
        F.max("full").alias("some"),
    )
    reaches = lambda score: F.coalesce(F.col("bound") >= F.col(score) - SLACK, F.lit(True))
    if mode == "fallback":
        stays = F.when(F.coalesce("some", F.lit(False)), F.col("whole") & reaches("all")).otherwise(F.col("whole") | reaches("any"))
    else:
        stays = reaches("any")
    kept = by_block.join(reach, "query_id", "left").filter(stays).select("query_id", "block")
    out = shared.materialise(all_.join(kept, ["query_id", "block"]), "picked")
    shared.release(all_)
    return out


def search_index(index: Index, queries: DataFrame, limit: int = 10, mode: str = "fallback", keep: DataFrame | None = None, order: tuple = ("id",)) -> DataFrame:
    """query_id, id, bm25, n_matched and lexical_rank for queries (query_id, query).

    Every token matches as a prefix. mode: and | or | fallback (all tokens, or any where no row has all). Lower scores are
    better; ties go by order, columns of keep or id. keep (id, ...): the rows that may be found; word statistics cover all
    rows, but the fallback is decided on these. Only postings under the first two characters of some query token are read:
    there are 36 * 36 such heads at most, whatever the number of queries, and a written index has a folder for each. Of an
    index with bounds, only postings in picked_blocks() are scored; queries need a query_id there.
    """
    needed = _asked(queries)
    if index.blocks is None:
        found = _scored_all(index, *needed, keep)
    else:
        found = _scored(index, picked_blocks(index, queries, limit, mode, keep, needed), needed[1], keep)
    full = F.col("n_matched") == F.col("n_tokens")
    if mode == "and":
        found = found.filter(full)
    # Rows with all tokens come first, so the first limit rows, which each task cuts before the shuffle, tell whether there
    # are any. Sums differ in their last bits with the order of their terms, hence the rounding.
    first = [F.when(full, 0).otherwise(1)] if mode == "fallback" else []
    by_query = Window.partitionBy("query_id")
    ranked = found.withColumn("lexical_rank", F.row_number().over(by_query.orderBy(*first, F.round("bm25", 9), *order))).filter(F.col("lexical_rank") <= limit)
    if mode == "fallback":
        ranked = ranked.withColumn("_any", F.max(full).over(by_query)).filter(full | ~F.col("_any"))
    return ranked.select("query_id", "id", "bm25", "n_matched", "lexical_rank")


def token_frequency(rows: DataFrame, id_: str, text: str) -> DataFrame:
    """id, token, tf and df of the query tokens of every row."""
    counts = rows.select(F.col(id_).alias("id"), F.explode(X.query_tokens(F.col(text), distinct=False)).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))
    return counts


def keyword_scores(rows: DataFrame, queries: DataFrame, id_: str, name: str, text: str, limit: int = 10) -> DataFrame:
    """The plain baseline: for each query token, repeats included, twice its frequency, and 5 if name holds it."""
    asked = queries.select("query_id", F.explode(X.query_tokens(F.col("query"), distinct=False)).alias("token"))
    asked = asked.groupBy("query_id", "token").agg(F.count("*").alias("times"))
    counts = token_frequency(rows, id_, text)
    in_text = asked.join(counts, "token").select("query_id", "id", (F.col("times") * 2 * F.col("tf")).alias("points"))
    # a name that holds a token holds its first two characters, so distinct names meet tokens by pairs of characters
    names = rows.select(F.col(id_).alias("id"), F.lower(F.col(name)).alias("name"))
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - 1), lambda i: F.substring("name", i, F.lit(2))))
    distinct = names.select("name").distinct().filter(F.length("name") >= 2).select("name", F.explode(pairs).alias("head"))
    held = distinct.join(asked.withColumn("head", F.substring("token", 1, 2)), "head").filter(F.contains(F.col("name"), F.col("token"))).drop("head")
    in_name = names.join(held, "name").select("query_id", "id", (F.col("times") * 5).alias("points"))
    scored = in_text.unionByName(in_name).groupBy("query_id", "id").agg(F.sum("points").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= limit)
