"""Decision matrices: which captioner a page goes to, which profile a request runs on, and how decisions compare with labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.functions.text import word

# Routes, visual types, labels, profiles and reasons.
LIGHT, DEEP = "nano", "gpt-5.4"
LIGHT_MODEL = "gpt-5.4-nano"
EMPTY_TYPES = ("cover_page", "front_matter", "index_page", "blank_page", "separation_page")
DEEP_TYPES = ("system_architecture_diagram", "flow_diagram", "wiring_signal_bus_diagram", "fuel_oil_hydraulic_transfer_diagram", "component_hierarchy_or_exploded_view")
MODE_WORDS = r"autoland|autothrottle|thrust\s+reverser|eicas\s+flag|reverse|rev"
DEEP_LABELS = ("deep_useful_for_rag", "deep_useful_for_wiki", "deep_required")
PROFILES = [
    ("search_rewrite", "search_rewrite", "gpt-5.4-nano", "none", 400), ("draft_simple", "assistant_response", "gpt-5.4-nano", "low", 1200),
    ("draft_standard_000", "assistant_response", "gpt-5.4-nano", "low", 1800), ("analysis_standard_100", "assistant_response", "gpt-5.4", "high", 2800),
    ("analysis_deep", "assistant_response", "gpt-5.4", "xhigh", 3600),
]
WHY = {
    "empty": "non-content visual type",
    "deep": "relationship-heavy visual type: ",
    "plain": "OCR/table/photo content stays on nano unless classified as a high-value diagram",
    "hierarchy": "dense component hierarchy in labeled component view",
    "cockpit": "cockpit panel with high-value operational mode/state relationships",
    "dense": "unclear visual type but dense relationships and entities",
    "procedure": "visual procedure carries high-value power-plant relation value",
    "default": "nano sufficient by candidate matrix",
}
# End of fixed values.


def caption_route(kind: Column, hierarchy: Column, related: Column, n_entities: Column, n_relations: Column, n_terms: Column, domains: Column, terms: Column, ocr_enough: Column) -> Column:
    """(route, reason) of a page by its profile; the first rule that fits decides."""
    def out(route: str, reason) -> Column:
        return F.struct(F.lit(route).alias("route"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))

    power = F.array_contains(domains, "power_plant_oil")
    modes = F.array_contains(domains, "flight_controls") | power | terms.rlike(word(MODE_WORDS))
    return (
        F.when(kind.isin(*EMPTY_TYPES), out(LIGHT, WHY["empty"]))
        .when(kind.isin(*DEEP_TYPES), out(DEEP, F.concat(F.lit(WHY["deep"]), kind)))
        .when(kind.isin("technical_table", "technical_photo"), out(LIGHT, WHY["plain"]))
        .when((kind == "simple_labeled_component_view") & hierarchy & (n_entities >= 9) & (n_relations >= 5), out(DEEP, WHY["hierarchy"]))
        .when((kind == "cockpit_panel_or_display") & related & (n_entities >= 8) & (n_relations >= 5) & modes, out(DEEP, WHY["cockpit"]))
        .when((kind == "other") & related & (n_entities >= 6) & (n_relations >= 4), out(DEEP, WHY["dense"]))
        .when((kind == "technical_procedure") & ~ocr_enough & (n_terms >= 8) & (n_relations >= 4) & power, out(DEEP, WHY["procedure"]))
        .otherwise(out(LIGHT, WHY["default"]))
    )


def outcome(route: Column, label: Column) -> Column:
    """How a route compares with a label given by hand."""
    return (
        F.when(F.coalesce(label, F.lit("")) == "", "unlabeled")
        .when(label == "ambiguous", "ambiguous")
        .when((route == LIGHT) & label.isin(*DEEP_LABELS), "false_nano")
        .when((route == DEEP) & (label == "nano_sufficient"), "false_gpt54")
        .otherwise("match")
    )


def calibration(rows: DataFrame) -> DataFrame:
    """One row of counts over rows (route, outcome), and the decision on the matrix."""
    count = lambda c: F.count_if(c)
    m = rows.agg(
        F.count("*").alias("total_pages"), count(F.col("route") == LIGHT).alias("routed_nano"), count(F.col("route") == DEEP).alias("routed_deep"), count(F.col("outcome") == "false_nano").alias("false_nano"),
        count(F.col("outcome") == "false_gpt54").alias("false_deep"), count(F.col("outcome") == "ambiguous").alias("ambiguous"), count(F.col("outcome") == "unlabeled").alias("unlabeled"),
    )
    m = m.withColumn("deep_ratio", F.when(F.col("total_pages") == 0, 0.0).otherwise(F.col("routed_deep") / F.col("total_pages")))
    revise = (F.col("false_nano") > 0) | (F.col("false_deep") / F.greatest(F.lit(1), "routed_deep") > 0.25) | (F.col("deep_ratio") > 0.45)
    pending = (F.col("total_pages") == 0) | (F.col("unlabeled") > 0)
    return m.withColumn("decision", F.when(pending, "pending_labels").when(revise, "revise_matrix").otherwise("accept_matrix"))


def unfinished(rows: DataFrame, finished: DataFrame, key: list[str]) -> DataFrame:
    """rows whose key no finished row has: what a job that was stopped has still to do."""
    return rows.join(finished.select(*key).distinct(), key, "left_anti")


def replay(pages: DataFrame, cached: DataFrame, decide: Callable[[DataFrame], DataFrame], labels: DataFrame) -> DataFrame:
    """calibration() of pages (doc): cached decisions (doc, route) stand, decide adds the route of the others; labels (doc, label)."""
    decided = cached.select("doc", "route").join(pages.select("doc"), "doc", "left_semi").unionByName(decide(unfinished(pages, cached, ["doc"])).select("doc", "route"))
    return calibration(decided.join(labels, "doc", "left").withColumn("outcome", outcome(F.col("route"), F.col("label"))))


def benchmark_runs(sample: DataFrame, models: list[str]) -> DataFrame:
    """A row for each page of the sample and each model to be tried on it."""
    return sample.withColumn("model", F.explode(F.array(*map(F.lit, models))))


#: Values that a sketch keeps: up to so many it is exact, beyond that ranks are off by less than a thousandth.
SKETCH = 4096


def latency_sketches(runs: DataFrame, millis: str) -> DataFrame:
    """model, status, n, most and a quantile sketch of runs (model, status, millis); runs without a time are left out.

    Sketches of a bounded size, so those of many jobs may be kept as rows and merged by latency() later.
    """
    timed = runs.filter(F.col(millis).isNotNull())
    return timed.groupBy("model", "status").agg(F.count("*").alias("n"), F.max(millis).cast("double").alias("most"), F.kll_sketch_agg_double(F.col(millis).cast("double"), SKETCH).alias("sketch"))


def latency(sketches: DataFrame) -> DataFrame:
    """model, status, n, p50, p90 and most over any number of latency_sketches() rows. A quantile is a value that occurred."""
    merged = sketches.groupBy("model", "status").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch", SKETCH).alias("s"))
    return merged.select("model", "status", "n", *[F.kll_sketch_get_quantile_double("s", F.lit(p / 100)).alias(f"p{p}") for p in (50, 90)], "most")


def review_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """by, name and n: the rows of every value of each of the columns, in one pass."""
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("by"), F.col(c).cast("string").alias("name")) for c in columns]))
    return rows.select(named.alias("x")).groupBy("x.by", "x.name").agg(F.count("*").alias("n")).orderBy("by", "name")


def execution(stage: Column, role: Column, complexity: Column, confidence: Column, asked: Column, analysed: Column | None = None) -> dict[str, Column]:
    """profile, complexity, model, cost and latency class of a request. complexity: auto or a level; analysed: the level that auto stands for."""
    rewrite = stage == "search_rewrite"
    level = F.when(rewrite, "simple").when(complexity == "auto", analysed if analysed is not None else F.lit("standard")).otherwise(complexity)
    profile = (
        F.when(rewrite | (role == "query"), "search_rewrite")
        .when(role == "000", "draft_standard_000")
        .when((level == "deep") | (confidence == "low"), "analysis_deep")
        .when(level == "simple", "draft_simple")
        .otherwise("analysis_standard_100")
    )
    model = F.when(rewrite, LIGHT_MODEL).when(asked == DEEP, DEEP).otherwise(LIGHT_MODEL)
    big, deep = model == DEEP, level == "deep"
    cost = F.when(big & deep, "high").when(big | deep, "medium").otherwise("low")
    latency = F.when(big & deep, "slow").when(big | deep, "balanced").otherwise("fast")
    return {"profile": profile, "complexity": level, "model": model, "cost_class": cost, "latency_class": latency}


def with_profiles(rows: DataFrame) -> DataFrame:
    """rows (profile, model, ...) with the profile's effort and token limit; the five profiles are broadcast."""
    known = rows.sparkSession.createDataFrame(PROFILES, "profile string, stage_of string, default_model string, effort string, max_tokens int")
    effort = F.when((F.col("model") == LIGHT_MODEL) & (F.col("effort") == "xhigh"), "high").otherwise(F.col("effort"))
    return rows.join(F.broadcast(known), "profile").withColumn("effort", effort)


def complexity_level(reply: Column) -> Column:
    """The level that an analyser's reply begins with; anything else is an error."""
    first = F.lower(F.regexp_extract(reply, r"^\s*([A-Za-z]+)", 1))
    return F.when(first.isin("simple", "standard", "deep"), first).otherwise(F.raise_error(F.concat(F.lit("unknown complexity: "), F.coalesce(reply, F.lit("")))))
