"""Filter interaction audit: what each of five filters removes, in every order they may be applied in.

Method: every document gets five failure flags, flags and part are counted, and SQL CUBE over the five flags and the part
adds the counts up. A grouping-set row whose selected flags are all false counts the survivors of that subset of filters, so
the 32 subsets of a part say everything: a step from subset P to P + f is a join of the two subsets' rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import materialise, release

FILTERS = "ABCDE"
#: Failure conditions: fewer words than this, a smaller share of distinct words, a larger one of capitals (in hundredths), these signs.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 2, "[#$%&*|]"
WORD = r"[^\x20\x09-\x0D]+"
COUNTS = ("n", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """The failures of filters A to D, which one text decides; a null text counts as empty."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    # one pass over the words: their array is bound once, and its two sizes are read from it
    sizes = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("words"), F.size(F.array_distinct(w)).cast("long").alias("distinct")))[0]
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    return {"sizes": sizes, "C": 100 * capitals > MOST_CAPITALS * F.length(text).cast("long"), "D": text.rlike(SIGNS)}


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, the flags A to E and good, toxic and n of the documents that share them.

    docs: doc_id, text, source; labels: doc_id, quality, toxic. A null source is the part ''. Of several labels of a doc_id
    one suffices to make it good or toxic; documents without any are neither.

    E needs the smallest doc_id of every text. Texts go by SHA-256, and only digests, ids and flags are shuffled. Rows that
    agree in these are counted in each task first, so neither a text that a third of all rows hold nor a repeated doc_id
    makes one task's group; the first of each text is then found by (digest, doc_id), of which no pair is common.
    Rows that repeat a doc_id with its text are no copies of a smaller one, and so pass E or fail it together. A row without
    a doc_id is compared with nothing: it passes E and makes no other row fail it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(F.col("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *[c.alias(n) for n, c in text_failures(text).items()])
    few = (F.col("sizes.words") < LEAST_WORDS).alias("A")
    repeating = (100 * F.col("sizes.distinct") < LEAST_DISTINCT * F.col("sizes.words")).alias("B")
    rows = read.select("digest", "doc_id", "part", few, repeating, "C", "D").groupBy("digest", "doc_id", "part", "A", "B", "C", "D").agg(F.count("*").alias("n"))
    marked = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = materialise(rows, "audit")  # two jobs read it
    named = rows.filter("doc_id IS NOT NULL")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = named.join(first, ["digest", "doc_id"], "left").join(marked, "doc_id", "left").withColumn("E", F.col("first").isNull())
    # rows without a doc_id join nothing, so that they do not meet in one task
    nameless = rows.filter("doc_id IS NULL").withColumns({"E": F.lit(False), "good": F.lit(False), "toxic": F.lit(False)})
    known = known.select(*nameless.columns).unionByName(nameless)
    times = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    counted = known.groupBy("part", *FILTERS).agg(F.sum("n").alias("n"), times("good").alias("good"), times("toxic").alias("toxic"))
    out = materialise(counted, "audit-flags")
    release(rows)
    return out


def survivors(counted: DataFrame) -> DataFrame:
    """part, mask and n, good, toxic of the documents that no filter of the mask's letters (A is bit 0) fails; part null: all parts.

    All 32 masks of each part are there, also those that nothing survives.
    """
    cube = counted.cube(*FILTERS, "part").agg(*[F.sum(c).alias(c) for c in COUNTS], F.grouping("part").alias("whole"), *[(1 - F.grouping(f)).alias(f"in_{f}") for f in FILTERS])
    left = cube.filter(~F.greatest(*[F.coalesce(F.col(f), F.lit(False)) for f in FILTERS]))
    mask = sum((F.col(f"in_{f}").cast("int") * (1 << i) for i, f in enumerate(FILTERS)), F.lit(0))
    found = left.select("part", mask.alias("mask"), "whole", *COUNTS)
    # the empty mask has a row for every part
    every = found.filter("mask = 0").select("part", "whole", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))).alias("mask"))
    same = (F.col("a.mask") == F.col("b.mask")) & F.col("a.part").eqNullSafe(F.col("b.part")) & (F.col("a.whole") == F.col("b.whole"))
    out = every.alias("a").join(found.alias("b"), same, "left")
    return out.select("a.part", "a.whole", "a.mask", *[F.coalesce(f"b.{c}", F.lit(0)).alias(c) for c in COUNTS])


def steps() -> list[tuple[str, int, str, int]]:
    """filter_order, step, filter and the mask of the filters before it, for all orders."""
    out = []
    for order in permutations(FILTERS):
        mask = 0
        for i, f in enumerate(order, 1):
            out.append(("".join(order), i, f, mask))
            mask |= 1 << FILTERS.index(f)
    return out


def audit(left: DataFrame, whole: bool = False) -> DataFrame:
    """A row for each part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    left: survivors(). whole: one part over all documents instead, named by null. Each of the 80 steps of a part from a
    subset to the next is a join of two subsets' rows; the 600 steps of all orders, a fixed table, then look theirs up.
    """
    spark = left.sparkSession
    plan = F.broadcast(spark.createDataFrame(steps(), "filter_order string, step int, filter string, before int"))  # 600 rows
    taken = plan.groupBy("filter", "before").agg(F.count("*").alias("orders"))
    side = left.filter(F.col("whole") == (1 if whole else 0)).drop("whole")
    bit = F.lit(0)
    for i, f in enumerate(FILTERS):
        bit = F.when(F.col("filter") == f, 1 << i).otherwise(bit)
    full = (1 << len(FILTERS)) - 1
    moves = F.broadcast(taken.select("filter", "before", "orders", bit.alias("bit")))  # 80 rows
    part = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    a = side.join(moves, F.col("mask") == F.col("before")).withColumn("after", F.col("before") + F.col("bit")).alias("a")
    pairs = a.join(side.alias("b"), part("a.part", "b.part") & (F.col("a.after") == F.col("b.mask")))
    pairs = pairs.select(
        "a.part", "a.filter", "a.before", "a.bit", F.col("b.n").alias("kept"), (F.col("a.n") - F.col("b.n")).alias("removed"), "a.orders",
        (F.col("a.good") - F.col("b.good")).alias("good_lost"), (F.col("a.toxic") - F.col("b.toxic")).alias("toxic_lost"),
    )
    alone = F.col("before") == 0
    last = F.col("before") + F.col("bit") == full
    of_filter = pairs.groupBy("part", "filter").agg(
        F.sum(F.col("orders") * F.col("removed")).alias("shapley"), F.sum(F.when(alone, F.col("removed"))).alias("failing"), F.sum(F.when(last, F.col("removed"))).alias("unique_fails"),
    )
    out = pairs.alias("p").join(of_filter.alias("f"), part("p.part", "f.part") & (F.col("p.filter") == F.col("f.filter")))
    out = out.select("p.part", "p.filter", "p.before", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
    return out.join(plan, ["filter", "before"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """audit() of the five filters over all documents, by part; an empty table has no parts and so no rows."""
    return audit(survivors(flagged(docs, labels)))
