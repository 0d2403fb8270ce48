"""Pairwise similarity of signals (M1-M5) as column expressions over precomputed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from . import rules
from . import text as T

WEIGHTS = (0.40, 0.20, 0.15, 0.10, 0.15)
#: The highest composite of two signals that share no identifier, title word or evidence word.
UNRELATED = 0.40


def project_ids(text: Column) -> Column:
    """M1: distinct identifiers, white space as hyphens, in capitals."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(T.pattern(p, True)), F.lit(1)) for p in V.PROJECT_IDS]))
    return F.array_distinct(F.transform(found, lambda x: F.upper(F.regexp_replace(T.strip(x), r"(?U)\s+", "-"))))


def tokens(text: Column) -> Column:
    """M2: distinct words of a-z and 0-9 without the stop words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))), F.array(*map(F.lit, V.STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """M3: of two token sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def amount_similarity(a: Column, b: Column) -> Column:
    """M4: of two parsed amounts."""
    low, high = F.least(a, b), F.greatest(a, b)
    ratio = F.when(high > 0, low / high).otherwise(0.0)
    return F.when(a.isNull() | b.isNull(), 0.0).when((a == 0) & (b == 0), 1.0).when(ratio >= 0.8, 1.0).when(ratio >= 0.5, 0.5).otherwise(0.0)


def keyed(signals: DataFrame) -> DataFrame:
    """What a comparison needs of a signal, made once: seq, ids, title and evidence tokens, value, place, sector."""
    c = {n: F.coalesce(F.col(n), F.lit("")) for n in ("signal_title", "trigger_event", "evidence_snippet", "estimated_value", "geography", "sector")}
    evidence = F.concat_ws(" ", c["trigger_event"], c["evidence_snippet"])
    return signals.select(
        F.col("seq"), project_ids(F.concat_ws(" ", c["signal_title"], evidence)).alias("ids"), tokens(c["signal_title"]).alias("title"), tokens(evidence).alias("evidence"),
        rules.parse_amount(c["estimated_value"]).alias("value"), F.lower(c["geography"]).alias("place"), c["sector"].alias("sector"))


def composite(a: str = "a", b: str = "b") -> Column:
    """M5 of two aliased keyed() rows: 1 if they share an identifier, else the weighted sum."""
    x, y = (lambda n: F.col(f"{a}.{n}")), (lambda n: F.col(f"{b}.{n}"))
    title, evidence, amount, place, sector = WEIGHTS
    same_place = F.when((x("place") != "") & (x("place") == y("place")), 1.0).otherwise(0.3)
    same_sector = F.when(x("sector") == y("sector"), 1.0).otherwise(0.0)
    total = title * jaccard(x("title"), y("title")) + evidence * jaccard(x("evidence"), y("evidence")) + amount * amount_similarity(x("value"), y("value")) + place * same_place + sector * same_sector
    return F.when(F.arrays_overlap(x("ids"), y("ids")), 1.0).otherwise(F.round(total, 3))
