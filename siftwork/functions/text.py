"""Small column helpers with the string rules that all functions share.

Patterns follow the Unicode meaning of \\w, \\b, \\s and \\d, and only a line feed ends a line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)^\s+|\s+$"


def pattern(p: str, fold: bool = False) -> str:
    """A pattern under the shared rules; fold ignores case."""
    return f"(?{'iu' if fold else ''}Ud){p}"


def hits(text: Column, p: str, fold: bool = False) -> Column:
    return text.rlike(pattern(p, fold))


def any_of(text: Column, patterns, fold: bool = False) -> Column:
    """Whether any pattern occurs; order does not matter."""
    return hits(text, "|".join(f"(?:{p})" for p in patterns), fold)


def extract(text: Column, p: str, group: int = 0, fold: bool = False) -> Column:
    """The leftmost match, null if there is none."""
    return F.when(hits(text, p, fold), F.regexp_extract(text, pattern(p, fold), group))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def prefix(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def first(*columns: Column) -> Column:
    return F.coalesce(*columns)


def cases(pairs, otherwise) -> Column:
    """A chain of (condition, value) pairs, the first that holds wins."""
    pairs = list(pairs)
    chain = reduce(lambda c, p: c.when(p[0], p[1]), pairs[1:], F.when(*pairs[0]))
    return chain.otherwise(otherwise)


def mapped(key: Column, values: dict, otherwise) -> Column:
    return cases(((key == k, F.lit(v)) for k, v in values.items()), otherwise)


def title_case(text: Column) -> Column:
    """Capital letters after anything that is no letter, small ones elsewhere."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))), "")


def word_count(text: Column) -> Column:
    """Words between white space, at least 1."""
    return F.greatest(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(1))
