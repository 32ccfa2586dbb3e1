"""Pages read by OCR: their JSON in two layouts, captions brought into one shape, and prepared rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.functions import text as X
from corvina.operators import corpus

# Page categories and actions of a caption.
TECHNICAL = ("technical_diagram", "technical_table", "technical_photo", "technical_procedure")
CATEGORIES = (*TECHNICAL, *corpus.NON_CONTENT, "unreadable")
ACTIONS = ("index", "downweight", "exclude")
LISTS = ("visible_text", "visible_identifiers", "ata_candidates", "part_or_zone_candidates", "diagram_elements", "relationships_or_flows", "warnings_or_limits", "figure_or_table_refs", "uncertainties")
# End of fixed values.
_IMAGE = "struct<id:string,imageBase64:string,image_base64:string,top_left_x:double,top_left_y:double,bottom_right_x:double,bottom_right_y:double>"
_PAGE = f"struct<index:int,markdown:string,markdown_alt:string,dimensions:struct<width:double,height:double>,images:array<{_IMAGE}>>"
DOCUMENT = f"struct<pages:array<{_PAGE}>,markdown:string,ocrResponse:struct<pages:array<{_PAGE}>>>"


def parse_documents(rows: DataFrame, doc: str, value: str) -> DataFrame:
    """doc, markdown, n_images, width_coverage and images (data URLs) of the first page of each OCR document."""
    o = F.from_json(F.col(value), DOCUMENT)
    page = F.get(F.coalesce(o["pages"], o["ocrResponse"]["pages"]), F.lit(0))
    images = F.coalesce(page["images"], F.array().cast(f"array<{_IMAGE}>"))
    first = F.get(images, F.lit(0))
    left, right, width = first["top_left_x"], first["bottom_right_x"], page["dimensions"]["width"]
    coverage = F.when((width > 0) & (right > left), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (right - left) / width))).otherwise(0.0)
    data = F.filter(F.transform(images, lambda i: data_url(F.coalesce(i["imageBase64"], i["image_base64"]))), lambda u: u.isNotNull())
    markdown = F.coalesce(X.blank_to_null(page["markdown_alt"]), page["markdown"], o["markdown"], F.lit(""))
    return rows.select(F.col(doc).alias("doc"), markdown.alias("markdown"), F.size(images).alias("n_images"), F.coalesce(coverage, F.lit(0.0)).alias("width_coverage"), data.alias("images"))


def data_url(x: Column) -> Column:
    """A base64 image as a data URL; blank is null."""
    return F.when(F.trim(x) == "", None).when(x.startswith("data:"), x).otherwise(F.concat(F.lit("data:image/jpeg;base64,"), x))


def decoded(url: Column) -> Column:
    """The bytes of a data URL, or null."""
    return F.try_to_binary(F.substring_index(url, ",", -1), F.lit("base64"))


def captions(rows: DataFrame, doc: str, value: str) -> DataFrame:
    """doc, pos and the normalised caption of each entry: a JSON object or an array of them.

    Unknown categories are technical_procedure, unknown actions follow the category, numbers are clamped to [0, 1],
    lists that are not arrays are empty, and entries of lists that are no texts keep their JSON.
    """
    fields = "page_category string, page_category_confidence double, is_non_content_page boolean, retrieval_action string, retrieval_weight double, short_summary string, technical_description string, " + ", ".join(f"{c} array<string>" for c in LISTS)
    as_list = F.from_json(F.col(value), f"array<struct<{fields.replace(' string', ':string').replace(' double', ':double').replace(' boolean', ':boolean').replace(' array<', ':array<')}>>")
    c = rows.select(F.col(doc).alias("doc"), F.posexplode(as_list).alias("pos", "c")).filter("c IS NOT NULL")  # from_json wraps a lone object
    known = F.when(F.col("c.page_category").isin(*CATEGORIES), F.col("c.page_category")).otherwise("technical_procedure")
    clamp = lambda x, other: F.when(x.isNull() | F.isnan(x), other).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))
    out = c.withColumn("category", known).withColumn("empty", F.coalesce("c.is_non_content_page", F.col("category").isin(*corpus.NON_CONTENT)))
    action = F.when(F.col("c.retrieval_action").isin(*ACTIONS), F.col("c.retrieval_action")).otherwise(F.when(F.col("empty"), "exclude").otherwise("index"))
    lists = [F.coalesce(F.filter(F.transform(f"c.{n}", X.compact), lambda v: v != ""), F.array().cast("array<string>")).alias(n) for n in LISTS]
    return out.select(
        "doc", "pos", F.col("category").alias("page_category"), clamp(F.col("c.page_category_confidence"), 0.5).alias("page_category_confidence"), F.col("empty").alias("is_non_content_page"), action.alias("retrieval_action"),
        clamp(F.col("c.retrieval_weight"), 1.0).alias("retrieval_weight"), X.compact(F.coalesce("c.short_summary", F.lit(""))).alias("short_summary"), X.compact(F.coalesce("c.technical_description", F.lit(""))).alias("technical_description"), *lists,
    )


def with_policy(rows: DataFrame) -> DataFrame:
    p = corpus.page_policy(F.col("page_category"), F.col("page_category_confidence"), F.col("is_non_content_page"), F.col("retrieval_action"), F.col("retrieval_weight"))
    return rows.withColumn("policy", p)


def prepared(documents: DataFrame, caption_rows: DataFrame, size: int = 3000, overlap: int = 120) -> DataFrame:
    """doc, pos, chunk, chunk_id, action and reason: pages that are not left out, with captions in the place of images, in chunks.

    A page's own analysis: a separator page is left out, else captions decide, else the page's text does.
    """
    said = with_policy(caption_rows).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "policy", F.coalesce(X.blank_to_null(F.col("technical_description")), F.col("short_summary")).alias("text")))).alias("s"))
    page = documents.join(said, "doc", "left")
    default = corpus.default_analysis(F.col("markdown"), X.page_number(F.col("doc")))
    page = page.withColumn("d", default)
    own = corpus.page_policy(F.col("d.category"), F.col("d.confidence"), F.lit(False), F.col("d.action"), F.when(F.col("d.category") == "front_matter", 0.15).otherwise(1.0))
    separator = corpus.page_policy(F.lit("separation_page"), F.lit(0.99), F.lit(True), F.lit("exclude"), F.lit(0.0))
    policy = F.when(corpus.is_separator(F.col("markdown"), F.col("n_images"), F.col("width_coverage")), separator).otherwise(F.coalesce(F.get("s", F.lit(0))["policy"], own))
    texts = F.filter(F.transform(F.filter("s", lambda x: x["policy"]["action"] != "exclude"), lambda x: x["text"]), lambda t: t != "")
    kept = page.withColumn("policy", policy).filter("policy.action <> 'exclude'")
    full = kept.select("doc", corpus.with_descriptions(F.col("markdown"), F.coalesce(texts, F.array().cast("array<string>"))).alias("content"), "policy")
    cut = corpus.chunks(full, "doc", "content", size, overlap).withColumnRenamed("id", "doc")
    return cut.join(full.select("doc", "policy"), "doc").select("doc", "pos", "chunk", F.concat("doc", F.lit(" "), F.col("pos").cast("string")).alias("chunk_id"), "policy.action", "policy.reason")


def violations(pages: DataFrame, relations: DataFrame, images: DataFrame, parts: DataFrame) -> DataFrame:
    """kind and id of what refers to nothing: relations to missing images or parts, pages of missing parts."""
    image_ids = images.select(F.concat(F.lit("image:"), "id").alias("to"))
    part_ids = parts.select(F.concat(F.lit("part:"), "slug").alias("from"))
    lost_images = relations.join(image_ids, "to", "left_anti").select(F.lit("missing-image").alias("kind"), F.col("to").alias("id"))
    lost_parts = relations.join(part_ids, "from", "left_anti").select(F.lit("missing-part").alias("kind"), F.col("from").alias("id"))
    lost_pages = pages.join(parts, "slug", "left_anti").select(F.lit("page-without-part").alias("kind"), F.col("slug").alias("id"))
    return lost_images.unionByName(lost_parts).unionByName(lost_pages).distinct()


def read_pages(pages: DataFrame, done: DataFrame, read) -> DataFrame:
    """Documents (doc, value) of all pages: those already read stand, read() is called on the others only."""
    return done.select("doc", "value").unionByName(read(pages.join(done.select("doc").distinct(), "doc", "left_anti")).select("doc", "value"))


def sidecars(documents: DataFrame, caption_rows: DataFrame) -> DataFrame:
    """doc, json and markdown: each page with the captions in the place of its images, as it is kept beside the page.

    Captions that the policy leaves out are listed in json but not shown; pages without captions stay as they are.
    """
    said = with_policy(caption_rows).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "policy", F.coalesce(X.blank_to_null(F.col("technical_description")), F.col("short_summary")).alias("text"), "page_category"))).alias("s"))
    page = documents.join(said, "doc", "left")
    shown = F.filter(F.transform(F.filter("s", lambda x: x["policy"]["action"] != "exclude"), lambda x: x["text"]), lambda t: t != "")
    alt = corpus.with_descriptions(F.col("markdown"), F.coalesce(shown, F.array().cast("array<string>")))
    listed = F.coalesce(F.transform("s", lambda x: F.struct(x["page_category"].alias("page_category"), x["text"].alias("text"))), F.array().cast("array<struct<page_category:string,text:string>>"))
    page = page.withColumn("alt", alt).withColumn("listed", listed)
    body = F.struct(F.array(F.struct(F.lit(0).alias("index"), "markdown", F.col("alt").alias("markdown_alt"))).alias("pages"), F.col("listed").alias("image_caption_analyses"))
    return page.select("doc", F.to_json(body).alias("json"), F.concat(F.regexp_replace("alt", r"\s+$", ""), F.lit("\n")).alias("markdown"))
