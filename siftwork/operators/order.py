"""Sorting, limits, de-duplication, filters and edits of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import vocab as V
from ..functions import text as T
from .merge import strength_rank

# The marks that the display puts before a value.
MARKS = {
    "signal_strength": {"High": "🟢", "Medium": "🟡", "Low": "🔴"},
    "strategic_fit": {"Strong Fit": "🟢", "Moderate Fit": "🟡", "Monitor": "🔵", "No Fit": "🔴"},
    "friction_level": {"Low": "🟢", "Moderate": "🟡", "High": "🔴"},
}


def ranked(signals: DataFrame) -> DataFrame:
    """O1: by strength, then relevance from the highest, then arrival."""
    return signals.orderBy(strength_rank(F.col("signal_strength")), F.desc("relevance_score"), "seq")


def top(rows: DataFrame, by, order, n: int) -> DataFrame:
    """O2: the first n rows of each group."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rank") <= n).drop("__rank")


def limited(rows: DataFrame, order, n: int) -> DataFrame:
    """O3: the first n rows of an order."""
    return rows.orderBy(*order).limit(n)


def dedupe(signals: DataFrame) -> DataFrame:
    """Of signals with the same link and first 60 title characters (any case), the one of highest confidence, the earlier on ties."""
    key = F.concat(F.coalesce("source_link", F.lit("")), F.lit("::"), F.lower(T.prefix(F.coalesce("signal_title", F.lit("")), 60)))
    return top(signals.withColumn("__key", key), ["__key"], [F.desc("confidence_score"), "seq"], 1).drop("__key")


def distinct_urls(*frames: DataFrame) -> DataFrame:
    """Distinct URLs of all frames, each with its first text (by position)."""
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    return every.groupBy("url").agg(F.min_by("text", "pos").alias("text"), F.min("pos").alias("pos"))


def appended(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, columns by name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def chosen(signals: DataFrame, strengths=tuple(V.STRENGTHS), fits=("Strong Fit", "Moderate Fit", "Monitor"), sectors=None) -> DataFrame:
    """Rows of the chosen values; No Fit is not chosen unless asked for."""
    keep = F.col("signal_strength").isin(*strengths) & F.col("strategic_fit").isin(*fits)
    return signals.where(keep if sectors is None else keep & F.col("sector").isin(*sectors))


def edited(signals: DataFrame, edits: DataFrame) -> DataFrame:
    """Display columns of edits (by seq) over those of the signals; a null edit changes nothing."""
    columns = [c for c, _, _ in V.DISPLAY if c in edits.columns and c in signals.columns]
    new = edits.select("seq", *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = signals.join(new, "seq", "left")
    return joined.withColumns({c: F.coalesce(f"__new_{c}", c) for c in columns}).select(*signals.columns)


def marked(name: str) -> Column:
    """K4: the value with its mark."""
    return T.cases(((F.col(name) == v, F.lit(f"{m} {v}")) for v, m in MARKS[name].items()), F.col(name))


def unmarked(name: str) -> Column:
    """K4: the value without a leading mark."""
    return T.strip(F.regexp_replace(name, r"^[\x{1F300}-\x{1FAD6}\x{26AA}\x{26AB}\x{1F7E0}-\x{1F7EB}]+\s*", ""))


def seed_rows(lines: Column) -> Column:
    """K5: array of struct(url, category, label) of a text of `url | category | label` lines."""
    rows = F.filter(F.transform(F.split(lines, "\n"), T.strip), lambda x: x != "")
    def cut(row: Column) -> Column:
        cells = F.transform(F.split(row, r"\|"), T.strip)
        return F.struct(F.get(cells, F.lit(0)).alias("url"), F.coalesce(F.get(cells, F.lit(1)), F.lit("")).alias("category"), F.coalesce(F.get(cells, F.lit(2)), F.lit("")).alias("label"))
    return F.transform(rows, cut)
