"""From resources to ranked signals (C15, the pipeline): flat map, relevance filter, wide projection, projects, order.

Only clustering, merging and the final sort shuffle. The relevance filter stands before the wide projection; both are
native expressions, so rows that fail it never reach the extractors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import vocab as V
from ..functions import relevance, rules
from ..functions import text as T
from ..operators import cluster, merge, order
from ..sources import html_chunks, paged_text
from ..storage import materialize
from . import enrichment

#: Resource columns that a chunk carries on.
PROVENANCE = ("site_no", "resource_no", "url", "final_url", "local_path", "default_agency", "default_geography")


def chunks(resources: DataFrame) -> DataFrame:
    """Resources (PROVENANCE, category, html, and pages for paged documents) to chunks with chunk_no and page_number."""
    web = html_chunks.parsed(resources.where("html is not null and html <> ''").select(*PROVENANCE, "category", "html"))
    web = web.withColumns({"page_number": F.lit(""), "doc_type": F.lit("html")})
    if "pages" not in resources.columns:
        return web
    paged = paged_text.parsed(resources.where("pages is not null and (html is null or html = '')").select(*PROVENANCE, "category", "pages"))
    return web.unionByName(paged)


def signals(chunk_rows: DataFrame, packs=None, threshold: float = relevance.THRESHOLD, neighborhoods=(), enrich: Callable[[DataFrame], DataFrame] | None = None, observation: Observation | None = None) -> DataFrame:
    """Relevant chunks to signals; enrich may replace title, value, strength, fit and notes (L1).

    neighborhoods: the areas of all sites, or a dict of each site's own by site_no. observation gets R4's counts.
    """
    packs = V.SECTORS if packs is None else packs
    kept = relevance.relevant(chunk_rows, packs, threshold, observation)
    text, blank = F.col("text"), F.lit("")
    staged = kept.withColumn("__stage", rules.stage_evidence(text)).withColumns({"procurement_stage": F.col("__stage.stage"), "__evidence": F.col("__stage.evidence")}).drop("__stage")
    typed = staged.withColumns({"signal_type": rules.signal_type(text, F.coalesce("category", blank)), "raw_amounts": rules.amounts(text), "meeting_date": rules.meeting_date(text, F.coalesce("date", blank))})
    valued = typed.withColumns({"estimated_value": rules.best_amount(F.col("raw_amounts")), "lifecycle_stage": rules.lifecycle(F.col("procurement_stage"), F.col("signal_type"))})
    strong = valued.withColumn("signal_strength", rules.strength(text, F.col("procurement_stage"), F.col("estimated_value") != "", F.col("meeting_date") != ""))
    page = F.coalesce("url", blank)
    home = F.coalesce("default_geography", blank)
    by_site = isinstance(neighborhoods, dict)
    place = rules.site_geography(text, home, F.col("site_no"), neighborhoods) if by_site else rules.geography(text, home, neighborhoods)
    made = strong.select(
        "site_no", "resource_no", "chunk_no", T.prefix(F.coalesce("title", blank), 120).alias("signal_title"), rules.agency(text, F.coalesce("default_agency", blank)).alias("agency"),
        place.alias("geography"), "sector", "estimated_value", rules.timeline(text, F.col("procurement_stage")).alias("expected_timeline"),
        "meeting_date", "signal_type", "procurement_stage", "lifecycle_stage", "signal_strength", rules.fit(F.col("relevance_score"), F.col("signal_strength")).alias("strategic_fit"),
        rules.friction(text).alias("friction_level"), F.lit("Unclear").alias("momentum"), rules.trigger(text).alias("trigger_event"), blank.alias("strategic_notes"),
        F.when(F.coalesce("final_url", blank) != "", F.col("final_url")).otherwise(page).alias("source_link"), F.coalesce("local_path", blank).alias("source_file_url"), page.alias("source_page_url"),
        T.prefix(F.when(F.col("__evidence") != "", F.col("__evidence")).otherwise(T.prefix(text, 200)), 500).alias("evidence_snippet"), F.col("page_number").alias("evidence_page"),
        F.round("relevance_score", 3).alias("confidence_score"), F.lit("rule").alias("extraction_method"), "raw_amounts", page.alias("doc_url"), "doc_type", F.lit(0).alias("chunk_index"), "relevance_score", "text")
    return (enrich(made).withColumn("extraction_method", F.lit("ai")) if enrich else made).drop("text")


def offline_enrichment(rows: DataFrame) -> DataFrame:
    """L2: title and notes from templates; value, strength and fit stay. Usable as enrich."""
    return rows.withColumns({"signal_title": rules.fallback_title(F.col("text"), F.col("agency")), "strategic_notes": rules.fallback_notes(F.col("sector"), F.col("procurement_stage"))})


def numbered(rows: DataFrame) -> DataFrame:
    """Adds seq, the arrival order over (site_no, resource_no, chunk_no): ranks in range partitions plus the counts before them."""
    keys = ["site_no", "resource_no", "chunk_no"]
    parts = materialize(rows.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "arrivals")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("__part").agg(F.count("*").alias("n")).withColumn("__offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("__part", "__offset")
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    return parts.withColumn("__rank", rank).join(F.broadcast(offsets), "__part").withColumn("seq", (F.col("__rank") + F.col("__offset") - 1).cast("bigint")).drop("__part", "__rank", "__offset", *keys)


def run(resources: DataFrame, packs=None, threshold: float = relevance.THRESHOLD, merge_projects: bool = True, merge_threshold: float = cluster.THRESHOLD, neighborhoods=(), enrich=None, preflight: Callable[[], str | None] | None = None, observation: Observation | None = None) -> DataFrame:
    """Ranked signals: one row a project, or every signal with its project's momentum and friction.

    preflight (L3) returns or raises what keeps the enrichment from working; the run then ends before it is planned.
    """
    enrichment.check(preflight)
    arrived = numbered(signals(chunks(resources), packs, threshold, neighborhoods, enrich, observation))
    assigned = cluster.assign(arrived, merge_threshold)
    return order.ranked(merge.merged(assigned) if merge_projects else merge.kept_all(assigned))
