"""Parts, codes, zones and their relations; images linked to parts; wiki pages; neighbours of an entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions import text as X
from corvina.operators import patterns
from corvina.sources import shared as shared_files

#: Bytes of a query's token in a broadcast.
TOKEN_BYTES = 128


def collected(x: str) -> Column:
    return F.sort_array(F.collect_set(x))


def nested(x: str) -> Column:
    """Distinct values of an array column over a group, sorted."""
    return F.sort_array(F.array_distinct(F.flatten(F.collect_set(x))))


def candidates(records: DataFrame) -> DataFrame:
    """records (row_idx, doc, chunk_id, content, ata, parts) with codes, zones, numbers and one row for each candidate part.

    Patterns are searched by many tasks, and once for a record, before its parts become rows.
    """
    named = X.split_parts(F.col("parts"))
    chosen = F.when(F.size(named) > 0, named).otherwise(X.heading_candidates(F.col("content")))
    read = shared_files.spread(records).select(
        "row_idx", "doc", "chunk_id", F.substring(F.col("content"), 1, 280).alias("snippet"),
        X.ata_codes(F.coalesce("ata", F.lit("")), F.col("content")).alias("ata_codes"), X.zones(F.col("content")).alias("zones"), X.part_numbers(F.col("content")).alias("part_numbers"),
        chosen.alias("raw"),
    )
    return read.withColumn("raw", F.explode("raw")).withColumn("slug", X.slugify(F.col("raw"))).filter("slug <> ''")


def supports(found: DataFrame) -> DataFrame:
    """Edges (slug, doc): the documents that name a part, as rows, for parts that very many documents name."""
    return found.select("slug", "doc").filter(F.col("doc").isNotNull()).distinct()


def first_values(found: DataFrame, column: str, name: str, most: int) -> DataFrame:
    """slug, the first most distinct values of a column as an array, and how many there are; each task cuts its own first."""
    rows = found.select("slug", F.col(column).alias("v")).filter("v IS NOT NULL").distinct()
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("slug").orderBy("v"))).filter(F.col("_n") <= most)
    return first.groupBy("slug").agg(collected("v").alias(name)).join(rows.groupBy("slug").agg(F.count("*").alias(f"n_{name}")), "slug")


def parts(found: DataFrame, names: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """One row for each slug: seed name by row order, all aliases, numbers, codes, zones, documents and first three snippets.

    names (slug, name): canonical names given by a model; a part without one goes by its seed name. most: the documents and
    chunks that a row lists, beside the number of all (n_supporting_docs, n_supporting_chunks); supports() has all of them.

    Snippets are cut to three before the shuffle's end by a window rank, so a part of many rows gathers three of them.
    """
    first = F.row_number().over(Window.partitionBy("slug").orderBy("row_idx", "raw"))
    snippets = found.withColumn("_n", first).filter("_n <= 3").groupBy("slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "snippet"))), lambda x: x["snippet"]).alias("snippets"))
    listed = {"doc": "supporting_docs", "chunk_id": "supporting_chunks"}
    whole = found.groupBy("slug").agg(
        F.min_by("raw", F.struct("row_idx", "raw")).alias("seed"), collected("raw").alias("aliases"), nested("part_numbers").alias("part_numbers"), nested("ata_codes").alias("ata_codes"),
        nested("zones").alias("zones"), *([collected(c).alias(n) for c, n in listed.items()] if most is None else []),
    )
    if most is not None:
        for c, n in listed.items():
            whole = whole.join(first_values(found, c, n, most), "slug", "left").withColumns({n: F.coalesce(n, F.array().cast("array<string>")), f"n_{n}": F.coalesce(f"n_{n}", F.lit(0))})
    out = whole.join(snippets, "slug")
    titled = X.title_case(F.col("seed"))
    if names is None:
        return out.withColumn("canonical_name", titled)
    given = names.select("slug", X.blank_to_null(X.compact(F.col("name"))).alias("_name")).filter("_name IS NOT NULL").dropDuplicates(["slug"])
    return out.join(given, "slug", "left").withColumn("canonical_name", F.coalesce("_name", titled)).drop("_name")


def relations(part_rows: DataFrame) -> DataFrame:
    """Edges (from, relation, to): a part belongs to its codes and lies in its zones."""
    source = F.concat(F.lit("part:"), F.col("slug"))
    named = lambda prefix, values: F.explode(F.transform(values, lambda v: F.concat(F.lit(prefix), v))).alias("to")
    belongs = part_rows.select(source.alias("from"), F.lit("belongs_to").alias("relation"), named("ata:", "ata_codes"))
    located = part_rows.select(source.alias("from"), F.lit("located_in").alias("relation"), named("zone:", "zones"))
    return belongs.unionByName(located)


def edges(found: DataFrame) -> DataFrame:
    """What relations() gives for the parts of candidates(), made distinct as rows: no part's values are gathered."""
    to = lambda relation, prefix, column: F.transform(column, lambda v: F.struct(F.lit(relation).alias("relation"), F.concat(F.lit(prefix), v).alias("to")))
    both = F.concat(to("belongs_to", "ata:", "ata_codes"), to("located_in", "zone:", "zones"))
    return found.select("slug", F.inline(both)).distinct().select(F.concat(F.lit("part:"), F.col("slug")).alias("from"), "relation", "to")


def dimension(found: DataFrame, column: str) -> DataFrame:
    """Distinct values of an array column with the row that brought each first."""
    return found.select("row_idx", F.explode(column).alias("value")).groupBy("value").agg(F.min("row_idx").alias("first_row"))


def occurrences(records: DataFrame) -> DataFrame:
    return records.select(
        "doc", "chunk_id", X.ata_codes(F.col("doc"), F.col("content")).alias("ata_codes"), X.zones(F.col("content")).alias("zones"), X.part_numbers(F.col("content")).alias("part_numbers"),
        X.task_kind(F.col("doc"), F.col("chunk_id"), F.col("content")).alias("task_kind"),
    )


def shared(left: DataFrame, right: DataFrame, left_id: str, right_id: str, key: str, order: str, limit: int) -> DataFrame:
    """left_id, right_id and n: the first limit rows of right, by order, that share a key with a row of left.

    Overlap of arrays as an equi-join of their exploded keys, so that neither side is compared with all of the other.
    """
    distinct = left.join(right, key).groupBy(left_id, right_id).agg(F.min(order).alias("_o"), F.count("*").alias("n_shared"))
    rank = F.row_number().over(Window.partitionBy(left_id).orderBy("_o", right_id))
    return distinct.withColumn("n", rank).filter(F.col("n") <= limit).drop("_o")


# Points of the signals that link an image with a part; a link needs one of the first three and MIN_SCORE.
CANDIDATE, IDENTIFIER, DESCRIPTION, SUPPORT, FIGURE, FLOW, MIN_SCORE = 5, 4, 3, 1, 1, 1, 3


def image_score(candidate: Column, identifier: Column, description: Column, support: Column, figure: Column, flow: Column) -> tuple[Column, Column, Column]:
    """Points, sorted reasons and whether the link holds, from the six signals."""
    named = [(candidate, CANDIDATE, "caption_candidate"), (identifier, IDENTIFIER, "visible_identifier"), (description, DESCRIPTION, "description_alias"), (support, SUPPORT, "supporting_doc"), (figure, FIGURE, "figure_or_table_ref"), (flow, FLOW, "relationship_or_flow")]
    score = sum((F.when(c, p).otherwise(0) for c, p, _ in named[1:]), F.when(candidate, CANDIDATE).otherwise(0))
    reasons = F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, _, n in named])))
    return score, reasons, (candidate | identifier | description) & (score >= MIN_SCORE)


#: The lists of a caption that an image keeps; one of the first three is a sign that it shows something.
IMAGE_LISTS = ("visible_identifiers", "part_or_zone_candidates", "relationships_or_flows", "figure_or_table_refs")


def image_relations(images: DataFrame, part_rows: DataFrame, supported: DataFrame | None = None) -> DataFrame:
    """Links of images (id, doc, caption, technical_description and the arrays of its caption) with parts.

    supported: the edges of supports(), for part rows that do not list all their documents.

    Images and parts meet where a text or value of one holds an alias of the other, or an alias holds a value, which
    patterns.holding() finds for all at once; only pairs that meet are scored. An empty value is in every alias.
    """
    aliases = F.array_distinct(F.concat(F.array("canonical_name"), "aliases", F.array(F.regexp_replace("slug", "-", " "))))
    p = part_rows.select("slug", aliases.alias("names"), "supporting_docs")
    named = p.select("slug", F.explode("names").alias("a")).filter(F.length(F.trim("a")) >= 3).select("slug", F.lower(F.trim("a")).alias("a"))
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    values = images.select("id", F.explode(F.concat(listed("part_or_zone_candidates"), listed("visible_identifiers"))).alias("x")).filter("x IS NOT NULL").select("id", F.lower("x").alias("text"))
    texts = images.select("id", F.explode(F.array("caption", "technical_description")).alias("x")).filter("x IS NOT NULL").select("id", F.lower("x").alias("text")).unionByName(values)
    held = patterns.keyed(texts, named.select(F.col("slug").alias("key"), F.col("a").alias("pattern"))).select(F.col("key").alias("slug"), "id")
    inside = patterns.keyed(named.select(F.col("slug").alias("id"), F.col("a").alias("text")), values.select(F.col("id").alias("key"), F.col("text").alias("pattern"))).select(F.col("id").alias("slug"), F.col("key").alias("id"))
    meet = held.unionByName(inside).distinct()
    both = meet.join(p, "slug").join(images, "id")
    backed = F.array_contains("supporting_docs", F.col("doc"))
    if supported is not None:
        both = both.join(supported.select("slug", "doc", F.lit(True).alias("_backed")), ["slug", "doc"], "left")
        backed = F.coalesce("_backed", F.lit(False))
    score, reasons, holds = image_score(
        X.lists_alias(F.col("part_or_zone_candidates"), F.col("names")), X.lists_alias(F.col("visible_identifiers"), F.col("names")),
        X.includes_alias(F.col("technical_description"), F.col("names")) | X.includes_alias(F.col("caption"), F.col("names")),
        backed, F.size("figure_or_table_refs") > 0, F.size("relationships_or_flows") > 0,
    )
    return both.filter(holds).select(F.concat(F.lit("part:"), "slug").alias("from"), F.lit("illustrated_by").alias("relation"), F.concat(F.lit("image:"), "id").alias("to"), "doc", score.alias("score"), reasons.alias("reasons"))


def linked_images(edges: DataFrame, images: DataFrame, limit: int = 6) -> DataFrame:
    """The limit best images of each part."""
    joined = edges.join(images.drop("doc"), edges["to"] == F.concat(F.lit("image:"), images["id"]))
    rank = F.row_number().over(Window.partitionBy("from").orderBy(F.desc("score"), "doc", "id"))
    return joined.withColumn("n", rank).filter(F.col("n") <= limit)


def wiki_markdown(slug: Column, title: Column, description: Column, ata: Column, zone: Column, aliases: Column, numbers: Column, docs: Column, occurrences_: Column, images: Column | None = None) -> Column:
    """The page of a part. images: lines of the section of linked images, if any."""
    line = lambda name, values: F.when(F.size(values) > 0, F.concat(F.lit(f"- {name}: "), F.array_join(values, ", ")))
    listed = F.array_join(F.transform(docs, lambda d: F.concat(F.lit("- ["), d, F.lit("](../../pages/"), d, F.lit(")"))), "\n")
    pictures = F.when(F.size(images) > 0, F.concat(F.lit("## Linked images\n\n"), F.array_join(images, "\n"), F.lit("\n"))) if images is not None else F.lit(None)
    return F.concat_ws(
        "\n", F.concat(F.lit("# "), title), F.lit(""), description, F.lit(""), F.lit("## Canonical identity"), F.lit(""), F.concat(F.lit("- Slug: `"), slug, F.lit("`")), line("ATA", ata),
        line("Zones", zone), line("Aliases", aliases), line("Part numbers", numbers), F.lit(""), pictures, F.lit("## Technical documents"), F.lit(""),
        F.when(F.size(docs) > 0, listed).otherwise("- No linked technical document recorded."), F.lit(""), F.lit("## Linked occurrences"), F.lit(""),
        F.when(F.size(occurrences_) > 0, F.array_join(F.transform(occurrences_, lambda o: F.concat(F.lit("- "), o)), "\n")), F.lit(""),
    )


def entity_search(entries: DataFrame, queries: DataFrame, title: Column, metadata: Column, id_: str, order: str, limit: int = 10) -> DataFrame:
    """query_id, id, score, wiki_rank: 3 for each query token in the title, else 1 for each in the metadata.

    Tokens are joined, not entries with queries; title and metadata are texts. Ties go by title in locale order, then id.
    """
    q = queries.select("query_id", F.explode(X.query_tokens(F.col("query"))).alias("token"))
    in_title = entries.select(F.col(id_).alias("id"), F.explode(X.query_tokens(title)).alias("token"), F.lit(3).alias("points"))
    in_meta = entries.select(F.col(id_).alias("id"), F.explode(X.query_tokens(metadata)).alias("token"), F.lit(1).alias("points"))
    # only tokens that are asked for are grouped
    wanted = shared_files.broadcast_if_small(q.select("token").distinct(), TOKEN_BYTES)
    best = in_title.unionByName(in_meta).join(wanted, "token", "left_semi").groupBy("id", "token").agg(F.max("points").alias("points"))
    scored = q.join(best, "token").groupBy("query_id", "id").agg(F.sum("points").alias("score"))
    named = scored.join(entries.select(F.col(id_).alias("id"), F.col(order).alias("_title")), "id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *X.in_locale("_title"), "id"))
    return named.withColumn("wiki_rank", rank).filter(F.col("wiki_rank") <= limit).drop("_title")


def neighbours(entities: DataFrame, classes: list[str], id_: str, title: str, limit: int = 10) -> DataFrame:
    """Entities that share a value with another, by class of value (columns of one value or an array), in any case."""
    out = None
    for c in classes:
        values = F.col(c) if entities.schema[c].dataType.typeName() == "array" else F.array(c)
        side = entities.select(F.col(id_).alias("entity"), F.col(title).alias("_t"), F.explode(values).alias("_v"))
        side = side.withColumn("_v", F.lower(F.trim(F.col("_v").cast("string")))).filter("_v <> ''").groupBy("entity", "_v").agg(F.min("_t").alias("_t"))
        # rows rank inside the value's group: of each value, an entity's first neighbours are among the group's first limit + 1
        first = side.withColumnRenamed("entity", "neighbour").withColumn("_n", F.row_number().over(Window.partitionBy("_v").orderBy("_t", "neighbour"))).filter(F.col("_n") <= limit + 1)
        pairs = side.drop("_t").join(first, "_v").filter("entity <> neighbour").groupBy("entity", "neighbour").agg(F.min("_t").alias("_t"))
        n = F.row_number().over(Window.partitionBy("entity").orderBy("_t", "neighbour"))
        part = pairs.withColumn("n", n).filter(F.col("n") <= limit).select(F.lit(c).alias("class"), "entity", "neighbour", "n")
        out = part if out is None else out.unionByName(part)
    return out


def image_nodes(documents: DataFrame, captions: DataFrame) -> DataFrame:
    """The images of pages (doc, images as data URLs) that may be shown: id, doc, image_index, asset_path, caption, ... and content.

    captions: rows of ocr.with_policy(). Image i goes by the ith caption of its page, or the last; pages without captions,
    images whose caption is left out or says nothing, and images that do not decode have no node. A doc counts once.
    """
    said = F.array_sort(F.collect_list(F.struct("pos", "policy", "short_summary", "technical_description", "page_category", *IMAGE_LISTS)))
    of = captions.groupBy("doc").agg(said.alias("s"))
    pages = documents.dropDuplicates(["doc"]).join(of, "doc").select("doc", "s", F.posexplode("images").alias("image_index", "url"))
    rows = pages.withColumn("c", F.element_at("s", F.least(F.col("image_index") + 1, F.size("s")))).withColumn("content", F.try_to_binary(F.substring_index("url", ",", -1), F.lit("base64")))
    rows = rows.withColumn("caption", X.compact(F.coalesce(X.blank_to_null(F.col("c.short_summary")), F.col("c.technical_description"), F.lit(""))))
    listed = [F.size(f"c.{n}") > 0 for n in IMAGE_LISTS[:3]]
    signal = (F.col("caption") != "") | listed[0] | listed[1] | listed[2]
    kept = rows.filter((F.col("c.policy.action") != "exclude") & signal & F.col("content").isNotNull())
    name = F.concat(X.slugify(F.regexp_replace("doc", r"(?i)\.pdf$", "")), F.lit("-"), (F.col("image_index") + 1).cast("string"))
    return kept.select(
        name.alias("id"), "doc", X.page_root(F.col("doc")).alias("doc_root"), "image_index", F.concat(F.lit("wiki/images/"), name, F.lit(".png")).alias("asset_path"), "caption", "c.technical_description", "c.page_category",
        *[f"c.{n}" for n in IMAGE_LISTS], F.col("c.policy.action").alias("retrieval_action"), "content",
    )


def wiki_content(description: Column, ata: Column, zone: Column, aliases: Column, numbers: Column, docs: Column, limit: int = 5) -> Column:
    """What a found wiki page says in one line, with the first documents that support it."""
    named = lambda name, values: F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.concat(F.lit(name + ": "), v))
    said = F.concat(F.array(F.coalesce(description, F.lit(""))), named("ATA", ata), named("Zone", zone), named("Alias", aliases), named("Part number", numbers), F.slice(named("Supporting doc", docs), 1, limit))
    return F.array_join(F.filter(said, lambda v: v != ""), " · ")


def wiki_path(raw: Column) -> Column:
    """The path of a wiki page or image below the wiki's folder; null for any other path."""
    path = F.regexp_replace(F.regexp_replace(F.try_url_decode(raw), "^/+", ""), "^wiki/", "")
    image = path.rlike(r"(?i)^images/[^/]+\.(?:png|jpe?g|webp)$")
    bad = (path == "") | F.contains(path, F.lit("\x00")) | F.contains(path, F.lit("\\")) | F.startswith(path, F.lit("/")) | F.array_contains(F.split(path, "/"), "..")
    return F.when(~bad & (path.endswith(".md") | image), path)


def minimum_counts(found: dict[str, DataFrame], least: dict[str, int]) -> DataFrame:
    """kind and id of the artefacts that have fewer rows than they must; each is counted up to that number only."""
    spark = next(iter(found.values())).sparkSession
    short = [("too-few", f"{n}: {got} of {least[n]}") for n, df in found.items() if (got := df.limit(least.get(n, 0)).count()) < least.get(n, 0)]
    return spark.createDataFrame(short, "kind string, id string")
