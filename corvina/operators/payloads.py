"""Replies, source groups, memory events and entity labels of a conversation about documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.functions.text import blank_to_null, js_trim

# Fixed values.
GROUPS = ("tech_docs", "non_conformities", "entities_wiki")
CAUTION = (
    "Low-confidence retrieval. I kept the current input conservative and did not infer additional technical specifics. "
    "Provide ATA, zone, part number, measurements, or a validated similar case."
)
UNTITLED = "Untitled entity"
# End of fixed values.


def final_payload(reply: Column) -> Column:
    """(text, label, description) of a reply: fields of its JSON object, or the reply itself as text.

    description keeps the JSON of an object. The text is the comment, or the reply where neither label nor description came.
    """
    v = F.try_parse_json(reply)
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    field = lambda n: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")) == "STRING", F.try_variant_get(v, f"$.{n}", "string"))
    nested = F.try_variant_get(v, "$.description", "variant")
    description = F.coalesce(field("description"), F.when(F.schema_of_variant(nested).rlike("^(OBJECT|ARRAY)"), F.to_json(nested)))
    label, description, comment = (F.when(is_object, x) for x in (field("label"), description, field("comment")))
    some = (F.coalesce(label, F.lit("")) != "") | (F.coalesce(description, F.lit("")) != "")
    text = F.coalesce(comment, F.when(some, None).otherwise(reply))
    return F.struct(text.alias("text"), label.alias("label"), description.alias("description"))


def needs_repair(json_mode: Column, payload: Column) -> Column:
    return json_mode & (F.coalesce(payload["label"], F.lit("")) == "") & payload["description"].isNull()


def source_groups(sources: Column) -> Column:
    """The groups that have items, in fixed order, as (name, items) of a struct with one array a group."""
    groups = [F.struct(F.lit(g).alias("name"), sources[g].alias("items")) for g in GROUPS]
    return F.filter(F.array(*groups), lambda g: F.coalesce(F.size(g["items"]), F.lit(0)) > 0)


def usable_sources(sources: Column) -> Column:
    """The sources given by a caller, or null where one of the first two groups is missing."""
    return F.when(sources[GROUPS[0]].isNotNull() & sources[GROUPS[1]].isNotNull(), sources)


def earlier_tasks(history: Column, current: Column) -> Column:
    """The tasks of a map by task id that lie before the current one."""
    return F.map_filter(history, lambda k, v: k < current)


def cautious(requests: DataFrame) -> DataFrame:
    """The fixed reply to requests (user_message, role, label, description) whose retrieval found too little."""
    return requests.select(F.lit(CAUTION).alias("text"), "label", "description", F.col("user_message").alias("user_query"), F.col("description").alias("input_description"), F.lit("ai").alias("role"), F.col("role").alias("user_role"))


def episodes(events: DataFrame) -> DataFrame:
    """Episodes of memory events (type, summary, response_text, validated, ...): only validated outputs with a summary count."""
    summary = js_trim(F.coalesce("summary", "response_text", F.lit("")))
    rows = events.filter(F.coalesce(F.col("type") == "validated_output", F.lit(False))).withColumn("summary", summary)
    return rows.filter((F.col("summary") != "") & F.coalesce("validated", F.lit(True)))


def merged_variants(rules: Column, model: Column, hints: Column, cap: int = 4) -> Column:
    """Variants by rule, then a model's, then its hints as one, distinct and cut to cap."""
    joined = F.filter(F.array(F.array_join(hints, " ")), lambda v: v != "")
    return F.slice(F.array_distinct(F.concat(rules, model, joined)), 1, cap)


# ---- entities


def entity_key(*values: Column) -> Column:
    """The first of path, slug, doc, title and chunk_id that is not blank."""
    return F.coalesce(*[blank_to_null(js_trim(v)) for v in values])


def shortened(values: Column, limit: int = 2) -> Column:
    more = F.size(values) - limit
    return F.when(more <= 0, F.array_join(values, ", ")).otherwise(F.concat(F.array_join(F.slice(values, 1, limit), ", "), F.lit(" +"), more.cast("string")))


def counted(n: Column, noun: str) -> Column:
    return F.when(n == 0, "").when(n == 1, f"1 {noun}").otherwise(F.concat(n.cast("string"), F.lit(f" {noun}s")))


def entity_labels(title: Column, doc: Column, chunk_id: Column, docs: Column, primary: Column, images: Column, ata: Column, zones: Column, aliases: Column) -> dict[str, Column]:
    """Columns of an entity's entry in a list. images: array of (asset_path, doc, id)."""
    all_docs = F.array_distinct(F.concat(docs, F.filter(F.array(primary), lambda d: d.isNotNull())))
    keys = F.transform(images, lambda i: F.coalesce(blank_to_null(i["asset_path"]), F.when(blank_to_null(i["doc"]).isNotNull(), F.concat_ws(":", i["doc"], blank_to_null(i["id"])))))
    meta = F.array_join(F.slice(F.concat(ata, F.transform(zones, lambda z: F.concat(F.lit("Zone "), z))), 1, 3), " / ")
    named = F.coalesce(entity_key(title, doc, chunk_id), F.lit(UNTITLED))
    return {
        "title": named, "meta": meta, "alias": shortened(aliases), "docs_label": counted(F.size(all_docs), "doc"),
        "images_label": counted(F.size(F.array_distinct(F.array_compact(keys))), "image"), "aria_label": F.concat(F.lit("Open entity "), named),
    }


def selected_entity(rows: DataFrame, group: str, key: str, position: str, current: Column, has_images: Column) -> DataFrame:
    """One entity of each group: the current one if it is there, else the first with images, else the first."""
    preference = F.when(F.col(key).eqNullSafe(current), 0).when(has_images, 1).otherwise(2)
    return rows.groupBy(group).agg(F.min_by(key, F.struct(preference, F.col(position))).alias("selected"))
