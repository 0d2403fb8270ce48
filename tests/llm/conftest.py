from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, rep bigint, h string, kept string, component bigint, votes int"


def prose(r: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls everywhere, empty and very long texts, repeated rows and columns with clashing names."""
    r = random.Random(1)
    long = " ".join(prose(r, 12) + ".\n" for _ in range(3000))
    rows = [(1, "A short text of a few words that ends here", "en", "s", 42), (2, None, None, None, None), (3, "", "en", "s", 0), (4, long, "en", "s", len(long)), (5, long, None, "s", len(long)),
            (6, " \n\t \n", "de", None, 6), (None, "text without an id", "en", "s", 18), (8, "same", "en", "s", 4), (8, "same", "en", "s", 4), (9, "ÄÖÜ éè 漢字 \U0001f600 <|endoftext|>", "de", "s", 5), (10, "!!! 123 ???", "en", "s", 11)]
    return spark.createDataFrame([(*x, 0.5, 7, "x", "y", 3, 1) for x in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
