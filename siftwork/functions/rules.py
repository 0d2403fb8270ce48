"""Row-wise classifiers and extractors (C1-C14) as native column expressions.

Each takes a text column and gives a column; nothing here shuffles or runs Python. Missing values are ''.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab as V
from . import text as T


def stage_evidence(text: Column) -> Column:
    """struct(stage, evidence).

    A stage's evidence is around the leftmost match of its first pattern that occurs, 60 characters to
    either side. The most advanced stage whose evidence isn't about the future wins, save the concept stage, which
    comes after all of these; if all are about the future the most advanced one wins.
    """
    lower = F.lower(text)
    found = []
    for rank, (stage, patterns) in enumerate(V.STAGES.items()):
        at = T.cases(((T.hits(lower, p), F.struct(F.regexp_instr(lower, F.lit(T.pattern(p))).alias("start"), F.length(F.regexp_extract(lower, T.pattern(p), 0)).alias("size"))) for p in patterns), None)
        found.append(F.struct(F.lit(rank).alias("rank"), F.lit(stage).alias("stage"), at.alias("at")))
    held = F.filter(F.array(*found), lambda s: s["at"].isNotNull())

    def evidence(s: Column) -> Column:
        start = F.greatest(s["at"]["start"] - 61, F.lit(0))
        end = s["at"]["start"] - 1 + s["at"]["size"] + 60
        around = T.strip(text.substr(start + 1, end - start))
        return F.struct(s["rank"].alias("rank"), s["stage"].alias("stage"), around.alias("evidence"))

    told = F.transform(held, evidence)
    marked = F.transform(told, lambda s: F.struct(T.hits(F.lower(s["evidence"]), V.FUTURE).cast("int").alias("future"), (s["stage"] == V.CONCEPT).cast("int").alias("concept"), s["rank"].alias("rank"), s["stage"].alias("stage"), s["evidence"].alias("evidence")))
    # present before future; of the present ones the concept stage comes last; of the future ones only the rank counts
    order = F.transform(marked, lambda s: F.struct(s["future"].alias("a"), F.when(s["future"] == 0, s["concept"]).otherwise(0).alias("b"), s["rank"].alias("c"), s["stage"].alias("stage"), s["evidence"].alias("evidence")))
    best = F.array_min(order)
    return F.struct(F.coalesce(best["stage"], F.lit("")).alias("stage"), F.coalesce(best["evidence"], F.lit("")).alias("evidence"))


def signal_type(text: Column, category: Column) -> Column:
    """By category where it is known, else by the first vocabulary that occurs."""
    lower = F.lower(text)
    meeting = T.cases([(T.hits(lower, V.MEETING_POLICY), "Policy Direction"), (T.hits(lower, V.MEETING_FUNDING), "Funding Allocation")], "Commission Agenda")
    by_words = T.cases(((T.any_of(lower, patterns), label) for label, patterns in V.SIGNAL_TYPES.items()), "")
    return T.cases([(category == "meetings", meeting), (category == "procurement", "Procurement (ITB/RFQ)"), (category.isin("budget", "cip"), "Capital Budget")], by_words)


def lifecycle(stage: Column, kind: Column) -> Column:
    """C3."""
    return T.mapped(stage, V.LIFECYCLE, T.mapped(kind, V.LIFECYCLE_OF_TYPE, ""))


def timeline(text: Column, stage: Column) -> Column:
    """C4: the first timeline phrase of the lower-cased text, else the stage's default."""
    lower = F.lower(text)
    phrases = [F.when(T.hits(lower, p), T.strip(F.format_string(form, *[F.regexp_extract(lower, T.pattern(p), g) for g in groups]))) for p, form, groups in V.TIMELINE_PHRASES]
    return T.first(*phrases, T.mapped(stage, V.TIMELINE, ""))


def parse_amount(raw: Column) -> Column:
    """Dollars as a double; null if it is no number. Units are tested in order."""
    bare = T.strip(F.regexp_replace(raw, r"[$,]", ""))
    lower = F.lower(bare)

    def number(text: Column) -> Column:
        # what the decimal notation of a number looks like; casts would take more, or throw
        return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))

    units = [(F.endswith(lower, F.lit(unit)), number(T.strip(bare.substr(F.lit(1), F.length(bare) - len(unit)))) * factor) for unit, factor in V.AMOUNT_UNITS]
    return T.cases(units, number(bare))


def amounts(text: Column) -> Column:
    """Array of struct(raw, value, context) of dollar amounts of 1000 or more, in text order."""
    raws = F.regexp_extract_all(text, F.lit(T.pattern(V.AMOUNT, True)), F.lit(0))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<raw:string,start:int>>").alias("found"))

    def step(acc: Column, raw: Column) -> Column:
        # matches do not overlap, and any text equal to a match starts a match itself, so the next one is where it first occurs
        at = F.call_function("locate", raw, text, acc["at"])
        return F.struct((at + F.length(raw)).alias("at"), F.concat(acc["found"], F.array(F.struct(raw.alias("raw"), at.alias("start")))).alias("found"))

    placed = F.aggregate(raws, start, step, lambda acc: acc["found"])

    def record(m: Column) -> Column:
        begin = F.greatest(m["start"] - 61, F.lit(0))
        end = m["start"] - 1 + F.length(m["raw"]) + 60
        return F.struct(m["raw"].alias("raw"), parse_amount(m["raw"]).alias("value"), T.strip(text.substr(begin + 1, end - begin)).alias("context"))

    return F.filter(F.transform(placed, record), lambda a: a["value"] >= 1000)


def best_amount(found: Column) -> Column:
    """The only amount; else the first in a project's context; else the first of the largest."""
    preferred = F.get(F.filter(found, lambda a: T.any_of(F.lower(a["context"]), V.AMOUNT_WORDS)), F.lit(0))
    largest = F.array_max(F.transform(found, lambda a, i: F.struct(a["value"].alias("value"), (-i).alias("order"), a["raw"].alias("raw"))))
    return F.when(F.size(found) == 0, "").when(F.size(found) == 1, F.get(found, F.lit(0))["raw"]).otherwise(F.coalesce(preferred["raw"], largest["raw"]))


def friction(text: Column) -> Column:
    """C8."""
    lower = F.lower(text)
    return T.cases([(T.any_of(lower, V.FRICTION_HIGH), "High"), (T.any_of(lower, V.FRICTION_MODERATE), "Moderate")], "Low")


def strength(text: Column, stage: Column, has_amount: Column, has_date: Column) -> Column:
    """Points for identifiers, stage, amount, date and verbs of approval."""
    points = (
        F.when(T.hits(text, V.STRENGTH_CODE, True), 3).otherwise(0) + F.when(T.hits(text, V.STRENGTH_PROJECT, True), 2).otherwise(0)
        + F.when(stage == V.CONCEPT, 1).when(stage != "", 2).otherwise(0) + F.when(has_amount, 2).otherwise(0) + F.when(has_date, 1).otherwise(0)
        + F.when(T.hits(text, V.STRENGTH_VERB, True), 1).otherwise(0))
    return T.cases([(points >= 6, "High"), (points >= 3, "Medium")], "Low")


def fit(relevance: Column, level: Column) -> Column:
    """C10."""
    return T.cases([((relevance >= 0.3) & (level == "High"), "Strong Fit"), ((relevance >= 0.15) & level.isin("High", "Medium"), "Moderate Fit"), (relevance >= 0.05, "Monitor")], "No Fit")


def trigger(text: Column) -> Column:
    """C11: the first trigger phrase of the first 2000 characters."""
    line = F.regexp_replace(T.prefix(text, 2000), r"(?U)\s+", " ")
    return T.first(*[T.prefix(T.strip(T.extract(line, p, 1, True)), 200) for p in V.TRIGGERS], F.lit(""))


def agency(text: Column, default: Column) -> Column:
    """C12."""
    start = T.prefix(text, 1000)
    return T.first(*[T.strip(T.extract(start, p, 0, True)) for p in V.AGENCIES], default)


def site_geography(text: Column, default: Column, site_no: Column, areas: dict[int, list[str]]) -> Column:
    """C13 with each site's own areas."""
    named = {k: names for k, names in areas.items() if names}
    return T.cases(((site_no == k, geography(text, default, names)) for k, names in named.items()), geography(text, default)) if named else geography(text, default)


def geography(text: Column, default: Column, neighborhoods=()) -> Column:
    """The default, with the first named area or generic place of the first 2000 characters in brackets."""
    start = T.prefix(text, 2000)
    named = [r"\b" + r"[\s\-]+".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in name.split()) + r"\b" for name in neighborhoods if name and name.split()]
    found = T.title_case(T.strip(T.first(*[T.extract(start, p, 0, True) for p in (*named, *V.PLACES)])))
    return F.when(found.isNull() | F.contains(F.lower(default), F.lower(found)), default).otherwise(F.concat(default, F.lit(" ("), found, F.lit(")")))


def meeting_date(text: Column, fallback: Column) -> Column:
    """C14."""
    start = T.prefix(text, 2000)
    return T.first(*[T.strip(T.extract(start, p, 1, True)) for p in V.MEETING_DATES], fallback)


def first_date(text: Column, size: int = 1000) -> Column:
    """The first date pattern that occurs in the first characters; '' if none."""
    start = T.prefix(text, size)
    return T.first(*[T.extract(start, p, 1, True) for p in V.DATES], F.lit(""))


def fallback_title(text: Column, agency_name: Column) -> Column:
    """L2: agency and first line."""
    line = T.prefix(F.get(F.split(T.strip(text), "\n"), F.lit(0)), 100)
    return T.prefix(F.when(agency_name != "", F.concat(agency_name, F.lit(" — "), line)).otherwise(line), 120)


def fallback_notes(sector: Column, stage: Column) -> Column:
    """L2: a template of sector and stage."""
    notes = F.concat(F.lit("Signal detected in "), sector, F.lit("-related content."), F.when(stage != "", F.concat(F.lit(" Currently at "), stage, F.lit(" stage."))).otherwise(""))
    return T.prefix(notes, 500)
