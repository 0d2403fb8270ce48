"""Projects from assigned signals: momentum, friction and merged rows.

Input are signals with seq (arrival order) and project_no. Everything is one grouped aggregation; ties go to the
earlier arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import vocab as V
from ..functions import rules
from ..functions import text as T

STAGE_RANK = {s: k for k, s in enumerate(V.STAGES)}
STAGE_NAMES = list(V.STAGES)


def stage_rank(stage: Column) -> Column:
    return T.mapped(stage, STAGE_RANK, V.NO_STAGE)


def strength_rank(level: Column, other: int = 3) -> Column:
    return T.mapped(level, V.STRENGTHS, other)


def _s(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _told(*names: str) -> Column:
    return F.concat_ws(" ", *map(_s, names))


def _first(value: Column, order: Column, where: Column) -> Column:
    """The value of the smallest order among rows that fit."""
    return F.min_by(F.when(where, value), F.when(where, order))


def momentum_of(stalled: Column, stages: Column) -> Column:
    """G1: stages is the array of all non-empty stages' ranks in arrival order."""
    distinct = F.array_distinct(stages)
    moved = F.element_at(distinct, -1) < F.get(distinct, F.lit(0))
    return T.cases([(stalled, "Stalled"), (F.size(stages) <= 1, "Unclear"), (moved, "Accelerating")], "Stable")


def profiles(signals: DataFrame) -> DataFrame:
    """One row a project with all that G1-G14 derive."""
    seq = F.col("seq")
    stage, title, geography = _s("procurement_stage"), _s("signal_title"), _s("geography")
    notes, evidence = _told("trigger_event", "evidence_snippet", "strategic_notes"), _told("evidence_snippet", "trigger_event", "strategic_notes")
    value = rules.parse_amount(_s("estimated_value"))
    trigger, date = _s("trigger_event"), _s("meeting_date")
    rows = signals.withColumns({
        "__rank": stage_rank(stage), "__value": F.when(value > 0, value), "__stalled": T.hits(notes, V.STALLED, True),
        "__high": T.hits(evidence, V.PROJECT_FRICTION_HIGH, True), "__moderate": T.hits(evidence, V.PROJECT_FRICTION_MODERATE, True)})
    in_order = F.array_sort(F.collect_list(F.when(stage != "", F.struct(seq.alias("seq"), F.col("__rank").alias("rank"), stage.alias("stage")))))
    made = rows.groupBy("project_no").agg(
        F.count("*").alias("signals"), in_order.alias("__stages"), F.bool_or("__stalled").alias("__stalled"),
        F.bool_or(_s("friction_level") == "High").alias("__is_high"), F.bool_or("__high").alias("__high"), F.bool_or(_s("friction_level") == "Moderate").alias("__is_moderate"),
        F.bool_or("__moderate").alias("__moderate"),
        F.min_by("seq", F.struct("__rank", strength_rank(_s("signal_strength")).alias("level"), (-F.coalesce("confidence_score", F.lit(0.0))).alias("confidence"), "seq")).alias("primary_seq"),
        F.min_by(F.when(F.length(title) > 10, title), F.when(F.length(title) > 10, F.struct((F.length(title) + F.when(F.contains(title, F.lit("|")), 100).otherwise(0)).alias("size"), title.alias("title")))).alias("__title"),
        F.min_by(title, seq).alias("__first_title"), _first(geography, seq, F.contains(geography, F.lit("("))).alias("__place"), _first(geography, seq, geography != "").alias("__any_place"),
        F.max_by(F.when(F.col("__value").isNotNull(), _s("estimated_value")), F.when(F.col("__value").isNotNull(), F.struct(F.col("__value").alias("value"), (-seq).alias("order")))).alias("__best_value"),
        F.min_by(_s("signal_strength"), F.struct(strength_rank(_s("signal_strength")).alias("level"), "seq")).alias("best_strength"),
        F.max_by(F.when(trigger != "", trigger), F.when(trigger != "", F.struct(F.length(trigger).alias("size"), (-seq).alias("order")))).alias("__trigger"),
        F.max(F.when(date != "", date)).alias("__last_date"), F.min(F.when(date != "", date)).alias("__first_date"),
        F.max(F.coalesce("confidence_score", F.lit(0.0))).alias("best_confidence"), F.max(F.coalesce("relevance_score", F.lit(0.0))).alias("best_relevance"))
    ranks = F.transform("__stages", lambda s: s["rank"])
    seen = F.array_distinct(F.transform("__stages", lambda s: s["stage"]))
    friction = T.cases([(F.col("__is_high") | F.col("__high"), "High"), (F.col("__is_moderate") | F.col("__moderate"), "Moderate")], "Low")
    known = F.filter(ranks, lambda r: r < V.NO_STAGE)
    latest = F.when(F.size(known) > 0, F.get(F.array(*map(F.lit, STAGE_NAMES)), F.array_min(known))).otherwise("")
    out = made.select(
        "project_no", "signals", "primary_seq", "best_strength", "best_confidence", "best_relevance", momentum_of(F.col("__stalled"), ranks).alias("momentum"), friction.alias("friction_level"),
        F.coalesce("__title", "__first_title").alias("best_title"), F.coalesce("__place", "__any_place", F.lit("")).alias("best_geography"), F.coalesce("__best_value", F.lit("")).alias("best_value"),
        F.coalesce("__trigger", F.lit("")).alias("best_trigger"), F.coalesce("__last_date", F.lit("")).alias("latest_date"), F.coalesce("__first_date", F.lit("")).alias("earliest_date"),
        latest.alias("latest_stage"), seen.alias("stages_seen"))
    return out.withColumn("notes", project_notes())


def project_notes() -> Column:
    """G14."""
    n, seen = F.size("stages_seen"), F.col("stages_seen")
    parts = [F.when(F.col("signals") > 1, F.concat(F.lit("Project appears in "), F.col("signals").cast("string"), F.lit(" sources."))),
             F.when(n > 1, F.concat(F.lit("Progressed through: "), F.array_join(seen, " → "), F.lit("."))).when(n == 1, F.concat(F.lit("Current stage: "), F.get(seen, F.lit(0)), F.lit("."))),
             F.when(F.col("momentum") != "Unclear", F.concat(F.lit("Momentum: "), F.col("momentum"), F.lit(".")))]
    return T.prefix(F.concat_ws(" ", *parts), 500)


def merged(signals: DataFrame) -> DataFrame:
    """One row a project. A single signal keeps all but momentum and friction; else the best of each column."""
    made = profiles(signals).select(*[F.col(c).alias(f"__p_{c}") for c in ("project_no", "signals", "primary_seq", "best_strength", "best_confidence", "best_relevance", "momentum", "friction_level", "best_title",
                                                                          "best_geography", "best_value", "best_trigger", "latest_date", "latest_stage", "notes")])
    primary = signals.join(made, (F.col("project_no") == F.col("__p_project_no")) & (F.col("seq") == F.col("__p_primary_seq")))
    many = F.col("__p_signals") > 1
    best = {"signal_title": "best_title", "geography": "best_geography", "estimated_value": "best_value", "signal_strength": "best_strength", "trigger_event": "best_trigger",
            "meeting_date": "latest_date", "confidence_score": "best_confidence", "relevance_score": "best_relevance", "procurement_stage": "latest_stage", "strategic_notes": "notes"}
    changes = {c: F.when(many, F.col(f"__p_{p}")).otherwise(F.col(c)) for c, p in best.items()}
    changes |= {"momentum": F.col("__p_momentum"), "friction_level": F.col("__p_friction_level")}
    if "extraction_method" in signals.columns:
        changes["extraction_method"] = F.when(many, "merged").otherwise(F.col("extraction_method"))
    if "chunk_index" in signals.columns:
        changes["chunk_index"] = F.when(many, F.lit(0)).otherwise(F.col("chunk_index")).cast(signals.schema["chunk_index"].dataType)
    return primary.withColumns(changes).select(*signals.columns)


def kept_all(signals: DataFrame) -> DataFrame:
    """Every signal with its project's momentum and friction; sort by project_no and seq for the reference order."""
    made = profiles(signals).select("project_no", F.col("momentum").alias("__m"), F.col("friction_level").alias("__f"))
    joined = signals.join(made, "project_no")
    return joined.withColumns({"momentum": F.col("__m"), "friction_level": F.col("__f")}).select(*signals.columns)


def metrics(signals: DataFrame) -> DataFrame:
    """Rows, rows of high strength, strong fits and distinct sectors."""
    return signals.agg(F.count("*").alias("signals"), F.count_if(F.col("signal_strength") == "High").alias("high"), F.count_if(F.col("strategic_fit") == "Strong Fit").alias("strong_fit"),
                       F.countDistinct("sector").alias("sectors"))
