"""Captions of the second generation: routing profiles brought into one shape, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.functions import text as X
from corvina.operators import ocr, routing

# Visual types, domains, entity types and relations.
SAME_IN_BOTH = ("cover_page", "front_matter", "index_page", "blank_page", "separation_page", "technical_table", "technical_photo", "technical_procedure")
OTHER_TYPES = ("simple_labeled_component_view", "cockpit_panel_or_display", *routing.DEEP_TYPES, "other", "unclear")
DOMAINS = ("fuel", "power_plant_oil", "flight_controls", "hydraulics", "avionics_electrical", "airframe", "doors", "landing_gear", "cabin", "oxygen", "fire_protection", "unknown")
ENTITIES = ("ata", "part", "zone", "system", "system_component", "sensor", "actuator", "valve", "panel", "display", "procedure", "figure", "other")
RELATIONS = (
    "contains", "part_of", "located_in", "connected_to", "interfaces_with", "feeds", "sends_signal_to", "receives_signal_from", "controls", "monitors", "actuates", "transfers_to", "routes_to", "indicates", "protects", "other",
)
# End of fixed values.
FLAGS = ("has_named_entities", "has_entity_relationships", "has_part_zone_or_ata_candidates", "has_component_hierarchy")
PROFILE = (
    "struct<visual_content_type:string,domain_candidates:array<string>,rag_signal:struct<ocr_markdown_sufficient:string,visual_caption_adds_retrieval_terms:string,retrieval_terms:array<string>>,"
    f"wiki_signal:struct<{','.join(f + ':string' for f in FLAGS)},entity_candidates:array<struct<label:string,type:string,evidence:string>>,relationship_candidates:array<struct<source:string,relation:string,target:string,evidence:string>>>,routing_evidence:array<string>>"
)


def one_of(x: Column, known: tuple[str, ...], other: str) -> Column:
    return F.when(x.isin(*known), x).otherwise(other)


def flag(x: Column) -> Column:
    """Booleans written as such or as texts."""
    return F.lower(F.trim(F.coalesce(x, F.lit("")))).isin("true", "yes", "1")


def texts(x: Column) -> Column:
    """Trimmed texts of a list, blanks left out; null is an empty list."""
    return F.coalesce(F.filter(F.transform(x, X.compact), lambda v: v != ""), F.array().cast("array<string>"))


def type_of_category(category: Column) -> Column:
    return F.when(category.isin(*SAME_IN_BOTH), category).when(category == "technical_diagram", "unclear").otherwise("other")


def category_of_type(kind: Column) -> Column:
    return one_of(kind, SAME_IN_BOTH, "technical_diagram")


def profiles(rows: DataFrame, doc: str, value: str) -> DataFrame:
    """doc and the normalised fields of routing_profile_v1 of a caption's JSON, with its category, summary and description.

    Unknown types follow the page category, unknown domains are "unknown", candidates without label (or without both ends)
    are left out, unknown entity types and relations are "other"; a missing category follows the visual type.
    """
    c = F.from_json(F.col(value), f"struct<page_category:string,page_category_confidence:double,short_summary:string,technical_description:string,routing_profile_v1:{PROFILE}>")
    p, blank = c["routing_profile_v1"], lambda x: X.compact(F.coalesce(x, F.lit("")))
    given = X.blank_to_null(F.trim(c["page_category"]))
    base = F.when(given.isNotNull(), one_of(given, ocr.CATEGORIES, "technical_procedure"))
    kind = F.when(p["visual_content_type"].isin(*SAME_IN_BOTH, *OTHER_TYPES), p["visual_content_type"]).when(base.isNotNull(), type_of_category(base)).otherwise("technical_procedure")
    domains = F.array_distinct(F.transform(texts(p["domain_candidates"]), lambda d: one_of(d, DOMAINS, "unknown")))
    entities = F.filter(
        F.transform(p["wiki_signal"]["entity_candidates"], lambda e: F.struct(blank(e["label"]).alias("label"), one_of(e["type"], ENTITIES, "other").alias("type"), blank(e["evidence"]).alias("evidence"))), lambda e: e["label"] != ""
    )
    relations = F.filter(
        F.transform(p["wiki_signal"]["relationship_candidates"], lambda r: F.struct(blank(r["source"]).alias("source"), one_of(r["relation"], RELATIONS, "other").alias("relation"), blank(r["target"]).alias("target"), blank(r["evidence"]).alias("evidence"))),
        lambda r: (r["source"] != "") & (r["target"] != ""),
    )
    out = rows.select(
        F.col(doc).alias("doc"), base.alias("_base"), F.coalesce(c["page_category_confidence"], F.lit(0.75)).alias("page_category_confidence"), blank(c["short_summary"]).alias("_summary"), blank(c["technical_description"]).alias("_description"),
        kind.alias("visual_content_type"), F.when(F.size(domains) > 0, domains).otherwise(F.array(F.lit("unknown"))).alias("domain_candidates"), flag(p["rag_signal"]["ocr_markdown_sufficient"]).alias("ocr_markdown_sufficient"),
        texts(p["rag_signal"]["retrieval_terms"]).alias("retrieval_terms"), *[flag(p["wiki_signal"][f]).alias(f) for f in FLAGS], F.coalesce(entities, F.array().cast("array<struct<label:string,type:string,evidence:string>>")).alias("entity_candidates"),
        F.coalesce(relations, F.array().cast("array<struct<source:string,relation:string,target:string,evidence:string>>")).alias("relationship_candidates"), texts(p["routing_evidence"]).alias("routing_evidence"),
    )
    out = out.withColumn("page_category", F.coalesce("_base", category_of_type(F.col("visual_content_type"))))
    out = out.withColumn("short_summary", F.coalesce(X.blank_to_null(F.col("_summary")), summary())).withColumn("technical_description", F.coalesce(X.blank_to_null(F.col("_description")), description()))
    return out.withColumn("is_non_content_page", F.col("page_category").isin(*routing.EMPTY_TYPES)).drop("_base", "_summary", "_description")


def summary() -> Column:
    """The visual type with its first terms, or with its first entity."""
    terms = F.array_join(F.slice("retrieval_terms", 1, 6), ", ")
    what = F.coalesce(X.blank_to_null(terms), F.get("entity_candidates", F.lit(0))["label"])
    return F.concat(F.replace("visual_content_type", F.lit("_"), F.lit(" ")), F.coalesce(F.concat(F.lit(": "), what), F.lit("")), F.lit("."))


def description() -> Column:
    """Summary, entities, relations and evidence as one text."""
    said = lambda name, items: F.when(F.size(items) > 0, F.concat(F.lit(name + ": "), F.array_join(items, "; "), F.lit(".")))
    entity = lambda e: F.concat(e["label"], F.lit(" ("), e["type"], F.when(e["evidence"] != "", F.concat(F.lit(", "), e["evidence"])).otherwise(""), F.lit(")"))
    relation = lambda r: F.concat_ws(" ", r["source"], r["relation"], r["target"])
    return F.concat_ws(" ", "short_summary", said("Entities", F.transform(F.slice("entity_candidates", 1, 12), entity)), said("Relationships", F.transform(F.slice("relationship_candidates", 1, 12), relation)), said("Evidence", F.slice("routing_evidence", 1, 8)))


def routed(rows: DataFrame) -> DataFrame:
    """profiles() with route and reason."""
    route = routing.caption_route(
        F.col("visual_content_type"), F.col("has_component_hierarchy"), F.col("has_entity_relationships"), F.size("entity_candidates"), F.size("relationship_candidates"), F.size("retrieval_terms"), F.col("domain_candidates"),
        F.array_join("retrieval_terms", " "), F.col("ocr_markdown_sufficient"),
    )
    return rows.withColumn("_r", route).select("*", "_r.route", "_r.reason").drop("_r")


def cascade(rows: DataFrame) -> DataFrame:
    """selected, model and trigger of pages (doc, route, light, light_error, deep, deep_error) after both captioners ran.

    The light caption stands unless it failed (technical_retry) or its page is routed deep; a deep pass that failed falls
    back to it.
    """
    deep_wanted = F.col("route") == routing.DEEP
    trigger = F.when(F.col("light").isNull(), "technical_retry").when(~deep_wanted, "nano_route").when(F.col("deep").isNull(), "deep_pass_failed_fallback_to_nano").otherwise("routing_deep_pass")
    use_deep = F.col("trigger").isin("technical_retry", "routing_deep_pass")
    out = rows.withColumn("trigger", trigger)
    return out.select("doc", F.when(use_deep, F.col("deep")).otherwise(F.col("light")).alias("selected"), F.when(use_deep, routing.DEEP).otherwise(routing.LIGHT_MODEL).alias("model"), "trigger", "light_error", "deep_error")


# ---- batches of requests and their results


def custom_id(phase: str, doc: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(doc, r"(?i)\.pdf$", ""), "(?i)[^a-z0-9_-]+", "-"), "^-+|-+$", "")
    return F.concat(F.lit(f"{phase}:"), F.substring(slug, 1, 180))


def pending(pages: DataFrame, captioned: DataFrame, audits: DataFrame, phase: str, force: bool = False) -> DataFrame:
    """Pages (doc, ...) still to be asked for: without a caption in the primary phase, routed deep but not done in the deep one."""
    if phase == "primary":
        return pages if force else pages.join(captioned.select("doc").distinct(), "doc", "left_anti")
    todo = audits.filter((F.col("route") == routing.DEEP) & ~F.col("model").eqNullSafe(F.lit(routing.DEEP)))
    return pages.join(todo.select("doc").distinct(), "doc", "left_semi")


def requests(pages: DataFrame, phase: str, model: str, max_tokens: int) -> DataFrame:
    """custom_id, doc and the JSON line of each page (doc, markdown, images); pages without images are left out."""
    body = F.struct(F.lit(model).alias("model"), F.col("markdown"), F.col("images"), F.lit(max_tokens).alias("max_output_tokens"))
    rows = pages.filter(F.size("images") > 0).withColumn("custom_id", custom_id(phase, F.col("doc")))
    return rows.select("custom_id", "doc", F.to_json(F.struct("custom_id", F.lit("POST").alias("method"), F.lit("/v1/responses").alias("url"), body.alias("body"))).alias("line"))


def batch_manifest(asked: DataFrame, phase: str, model: str) -> DataFrame:
    """One row about a batch of requests: phase, model, how many, and an order-free mark of their ids."""
    return asked.agg(F.lit(phase).alias("phase"), F.lit(model).alias("model"), F.count("*").alias("n_requests"), F.count_distinct("custom_id").alias("n_ids"), F.bit_xor(F.xxhash64("custom_id")).alias("ids_mark"))


def results(lines: DataFrame, asked: DataFrame) -> DataFrame:
    """doc, text and failure of result lines (value) by the requests (custom_id, doc) that they answer."""
    r = F.from_json("value", "struct<custom_id:string,response:struct<status_code:int,body:string>,error:struct<message:string,code:string>>")
    got = lines.filter(F.trim("value") != "").select(r.alias("r")).select("r.custom_id", F.col("r.response.status_code").alias("status"), F.col("r.response.body").alias("text"), F.coalesce("r.error.message", "r.error.code").alias("error"))
    joined = got.join(asked.select("custom_id", "doc"), "custom_id", "left")
    failure = (
        F.when(F.col("doc").isNull(), F.concat(F.lit("Unknown custom_id: "), F.coalesce("custom_id", F.lit(""))))
        .when(F.col("error").isNotNull(), F.concat("doc", F.lit(": "), "error"))
        .when(~F.coalesce("status", F.lit(0)).between(200, 299), F.concat("doc", F.lit(": response status "), F.coalesce("status", F.lit(0)).cast("string")))
    )
    return joined.select("custom_id", "doc", F.when(failure.isNull(), F.col("text")).alias("text"), failure.alias("failure"))


def import_counters(imported: DataFrame) -> DataFrame:
    """One row of counts over results (text, failure, route): imported, failed, and the route of what was imported."""
    ok = F.col("failure").isNull()
    return imported.agg(F.count_if(ok).alias("imported"), F.count_if(~ok).alias("failed"), F.count_if(ok & (F.col("route") == routing.LIGHT)).alias("routed_nano"), F.count_if(ok & (F.col("route") == routing.DEEP)).alias("routed_deep"))


def batch_status(asked: DataFrame, answered: DataFrame) -> DataFrame:
    """One row of counts over requests (custom_id) and results (custom_id, failure): requested, answered, failed and open."""
    got = answered.groupBy("custom_id").agg(F.min(F.col("failure").isNotNull()).alias("failed"))
    both = asked.select("custom_id").join(got, "custom_id", "left")
    return both.agg(F.count("*").alias("requested"), F.count_if(F.col("failed").isNotNull()).alias("answered"), F.count_if(F.col("failed")).alias("failed"), F.count_if(F.col("failed").isNull()).alias("open"))


def latest(listing: DataFrame) -> DataFrame:
    """The path changed last, then by name, of a listing (path, modificationTime)."""
    return listing.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))
