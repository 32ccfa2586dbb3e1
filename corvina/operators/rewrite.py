"""Rule-based query expansion: keyword families add domain variants of a query; at most four distinct ones stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.operators.payloads import merged_variants
from corvina.functions.text import compact, query_tokens

# Keyword families and the variants they add.
FUEL = ["fuel", "tank", "reservoir", "collector", "surge", "refuel", "defuel", "pump", "quantity", "gauge", "probe"]
ELECTRICAL = ["electrostatic", "static", "esd", "grounding", "bonding", "electrical"]
STRUCTURAL = ["windshield", "frame", "flushness", "rivets", "rivet", "pare", "brise", "structural", "repair"]
DAMAGE = ["scratch", "damage", "rayure", "zone", "surface", "aluminum", "aluminium"]
DOOR = ["door", "delamination", "composite"]
LEFT, RIGHT = ["left", "gauche"], ["right", "droite", "droit"]
EVENTS = "non_conformities"
FUEL_EVENTS = "ATA 28 fuel system fuel tank fuel quantity fuel pump sensor wiring"
FUEL_DOCS = "ATA 28 fuel system fuel tank collector tank surge tank"
ELECTRICAL_TEXT = "electrical grounding bonding electrostatic discharge static discharge ESD"
BOTH = "ATA 28 fuel tank electrical grounding bonding electrostatic discharge"
BOTH_EVENTS, BOTH_DOCS = "wiring fuel pump sensor", "collector tank surge tank"
STRUCTURAL_TEXT = "ATA 56 windshield frame rivet structural repair flushness"
DAMAGE_TEXT = "surface damage structural repair airframe scratch zone"
DOOR_TEXT = "ATA 52 door composite delamination frame structure"
LEFT_TEXT, RIGHT_TEXT = "left wing left main tank", "right wing right main tank"
# End of fixed values.


def variants(query: Column, corpus: Column, cap: int = 4) -> Column:
    """The query and its expansions, in order, distinct by their tokens."""
    tokens = query_tokens(query)
    has = lambda words: F.arrays_overlap(tokens, F.lit(words))
    events = corpus == EVENTS
    fuel, electrical, left, right = has(FUEL), has(ELECTRICAL), has(LEFT), has(RIGHT)
    sides = F.concat_ws(" ", F.when(left, LEFT_TEXT), F.when(right, RIGHT_TEXT))
    both = F.concat_ws(" ", F.lit(BOTH), F.nullif(sides, F.lit("")), F.when(events, BOTH_EVENTS).otherwise(BOTH_DOCS))
    tried = F.array(
        compact(query),
        F.when(fuel, F.when(events, FUEL_EVENTS).otherwise(FUEL_DOCS)),
        F.when(electrical, F.lit(ELECTRICAL_TEXT)),
        F.when(fuel & electrical, both),
        F.when(has(STRUCTURAL), F.lit(STRUCTURAL_TEXT)),
        F.when(has(DAMAGE), F.lit(DAMAGE_TEXT)),
        F.when(has(DOOR), F.lit(DOOR_TEXT)),
        F.when((left | right) & ~(fuel & electrical), sides),
    )
    named = F.transform(F.array_compact(tried), lambda v: F.struct(v.alias("text"), F.array_join(query_tokens(v), " ").alias("key")))
    keys = F.transform(named, lambda v: v["key"])
    # the query itself stays whatever its tokens; an expansion needs tokens that no earlier one has
    kept = F.filter(named, lambda v, i: (i == 0) | ((v["key"] != "") & (F.array_position(keys, v["key"]) == i + 1)))
    return F.slice(F.transform(kept, lambda v: v["text"]), 1, cap)


def expand(queries: DataFrame, rewrite: bool = True, cap: int = 4) -> DataFrame:
    """queries (query_id, query, corpus) as query_id, corpus, batch (from 0) and variant."""
    texts = variants(F.col("query"), F.col("corpus"), cap) if rewrite else F.array(F.trim("query"))
    return queries.select("query_id", "corpus", F.posexplode(texts).alias("batch", "variant"))


def wants_model(query: Column) -> Column:
    """Whether a query is worth a model's variants: it is about fuel and electricity, or names an ATA chapter and fuel."""
    tokens = query_tokens(query)
    has = lambda words: F.arrays_overlap(tokens, F.lit(words))
    return (has(FUEL) & has(ELECTRICAL)) | (F.array_contains(tokens, "ata") & F.array_contains(tokens, "fuel"))


def expand_with_model(queries: DataFrame, model, cap: int = 4) -> DataFrame:
    """expand(), with the variants and hints that model adds (distinct queries (query, corpus) to query, corpus, variants, hints).

    Each distinct query goes to the model once, and only if wants_model().
    """
    asked = queries.select("query", "corpus").filter(wants_model(F.col("query"))).distinct()
    told = queries.join(model(asked).dropDuplicates(["query", "corpus"]), ["query", "corpus"], "left")
    rules, none = variants(F.col("query"), F.col("corpus"), cap), F.array().cast("array<string>")
    merged = merged_variants(rules, F.coalesce("variants", none), F.coalesce("hints", none), cap)
    return told.select("query_id", "corpus", F.posexplode(merged).alias("batch", "variant"))
