"""Relevance of a text to keyword packs (R1-R3): column expressions without a shuffle.

The words of a text are set apart once, so that a keyword of one word costs a search for a plain string; another is
counted by its pattern, and only in texts that contain it as a substring.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from . import text as T

TITLE_ZONE = 200
THRESHOLD = 0.05


def _escape(keyword: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", keyword)


def spaced(text: Column) -> Column:
    """The words of a text, each with a space of its own before and after, so that a word is found as a plain string."""
    return F.concat(F.lit(" "), F.regexp_replace(text, r"(?U)\W+", "  "), F.lit(" "))


def _is_word(keyword: str) -> bool:
    return re.fullmatch("[a-z0-9_]+", keyword) is not None


def _split(keywords) -> tuple[list[str], list[str]]:
    """Keywords of one word, as they stand in a spaced text, and the others."""
    folded = [k.lower() for k in keywords]
    return [f" {k} " for k in folded if _is_word(k)], [k for k in folded if not _is_word(k)]


def _words(keywords: list[str]) -> Column:
    return F.array(*map(F.lit, keywords)).cast("array<string>")


def counts(text: Column, words: Column, keywords) -> Column:
    """Occurrences of the keywords, in any order, in a lower-cased text, words being the spaced text.

    Higher-order functions keep the loops over keywords out of the generated code, which is compiled only if it is short.
    """
    single, others = _split(keywords)
    found = F.transform(_words(single), lambda k: ((F.octet_length(words) - F.octet_length(F.replace(words, k, F.lit("")))) / F.octet_length(k)).cast("int"))
    each = [F.when(F.contains(text, F.lit(k)), F.regexp_count(text, F.lit(T.pattern(rf"\b{_escape(k)}\b")))).otherwise(0) for k in others]
    return F.concat(found, F.transform(F.array(*each), lambda n: n)) if others else found


def titled(zone: Column, words: Column, keywords) -> Column:
    """How many of the keywords the first characters of a lower-cased text hold, words being these spaced."""
    single, others = _split(keywords)
    each = [F.contains(zone, F.lit(k)) & T.hits(zone, rf"\b{_escape(k)}\b") for k in others]
    found = F.size(F.filter(_words(single), lambda k: F.contains(words, k)))
    return found + F.size(F.filter(F.array(*each), lambda x: x)) if others else found


def _score(counted: Column, in_title: Column, size: Column, keywords: int) -> Column:
    """R1 of a pack's counts, the number of its keywords in the title and the words of the text."""
    n = F.aggregate(counted, F.lit(0), lambda a, x: a + x)
    unique = F.size(F.filter(counted, lambda x: x > 0))
    frequency = F.least(n / (size / F.lit(50.0)), F.lit(1.0))
    coverage = F.least(unique / F.lit(max(keywords * 0.3, 1.0)), F.lit(1.0))
    # the running sum of 0.15 passes its limit at the second keyword
    bonus = F.least(in_title * F.lit(0.15), F.lit(0.3))
    score = F.round(F.least(0.4 * frequency + 0.35 * coverage + 0.25 * bonus, F.lit(1.0)), 3)
    return F.when(n == 0, 0.0).otherwise(score)


def relevance(text: Column, keywords) -> Column:
    """0 to 1 from density, breadth and the first characters; 0 without a hit."""
    keywords = list(keywords)
    if not keywords:
        return F.lit(0.0)
    lower = F.lower(text)
    zone = T.prefix(lower, TITLE_ZONE)
    return _score(counts(lower, spaced(lower), keywords), titled(zone, spaced(zone), keywords), T.word_count(lower), len(keywords))


def best_sector(scores: dict[str, Column]) -> tuple[Column, Column]:
    """R2: the sector of the highest score, the first named of equal ones; ('', 0) if all are 0."""
    names = list(scores)
    top = F.greatest(*scores.values(), F.lit(0.0)) if len(names) > 1 else F.greatest(scores[names[0]], F.lit(0.0))
    sector = F.when(top <= 0, "")
    for name in names:
        sector = sector.when(scores[name] == top, name)
    return sector.otherwise(""), top


def scored(chunks: DataFrame, packs: dict[str, tuple[str, ...]], text: str = "text") -> DataFrame:
    """Adds sector and relevance_score for the selected packs, in their order."""
    if not packs:
        return chunks.withColumns({"sector": F.lit(""), "relevance_score": F.lit(0.0)})
    # columns of their own, so that each is evaluated once and not wherever it is used
    col = F.col
    out = chunks.withColumn("__lower", F.lower(F.coalesce(col(text), F.lit(""))))
    zone = T.prefix(col("__lower"), TITLE_ZONE)
    out = out.withColumns({"__zone": zone, "__words": spaced(col("__lower")), "__first": spaced(zone), "__size": T.word_count(col("__lower"))})
    some = {i: list(words) for i, words in enumerate(packs.values()) if words}
    out = out.withColumns({f"__n{i}": counts(col("__lower"), col("__words"), words) for i, words in some.items()} | {f"__t{i}": titled(col("__zone"), col("__first"), words) for i, words in some.items()})
    out = out.withColumns({f"__s{i}": _score(col(f"__n{i}"), col(f"__t{i}"), col("__size"), len(some[i])) if i in some else F.lit(0.0) for i in range(len(packs))})
    sector, top = best_sector({name: col(f"__s{i}") for i, name in enumerate(packs)})
    return out.withColumns({"sector": sector, "relevance_score": top}).drop("__lower", "__zone", "__words", "__first", "__size", *[f"__{c}{i}" for c in "nts" for i in range(len(packs))])


def relevant(chunks: DataFrame, packs: dict[str, tuple[str, ...]], threshold: float = THRESHOLD, observation: Observation | None = None) -> DataFrame:
    """Chunks whose rounded score reaches the threshold; a threshold of 0 or less admits all.

    R4: the counts of chunks and of those that pass are observed. The filter stays above the counts, so each score is
    computed once and not again inside a pushed-down filter.
    """
    passed = F.col("relevance_score") >= threshold
    counts = (F.count("*").alias("chunks"), F.count(F.when(passed, 1)).alias("passed"))
    return scored(chunks, packs).observe(observation or "relevance", *counts).where(passed)


def warning(counts: dict, threshold: float = THRESHOLD) -> str:
    """What to tell of a scan in which nothing passed; else ''."""
    if not counts.get("chunks") or counts.get("passed"):
        return ""
    return f"0 of {counts['chunks']} chunks passed the relevance filter (threshold {threshold}); lower it or choose other sectors"
