"""Remote enrichment of signals (L1, L3) by a callable that the user brings; nothing is called by default."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules

# How much of a text and of an amount's context is sent, and how long an answer's fields may be.
TEXT, CONTEXT = 3000, 100
ANSWER = {"signal_title": 120, "strategic_notes": 500, "estimated_value": None, "signal_strength": None, "strategic_fit": None}


class NotReady(RuntimeError):
    """The preflight of a run failed."""


def check(preflight: Callable[[], str | None] | None) -> None:
    """L3: call the preflight; what it says or raises ends the run before anything is planned."""
    if preflight is None:
        return
    try:
        problem = preflight()
    except Exception as e:
        raise NotReady(str(e)) from e
    if problem:
        raise NotReady(problem)


def parse(raw: str) -> dict:
    """The JSON object of an answer, with or without a code fence."""
    found = json.loads(re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", raw.strip())))
    if not isinstance(found, dict):
        raise TypeError("the answer is no object")
    return found


def answered(row: dict, call: Callable[[dict], str]) -> dict:
    """L1: the fields that an answer gives; those of the rules if there is none or it cannot be read."""
    amounts = [f"{a['raw']} (context: {(a['context'] or '')[:CONTEXT]})" for a in ([] if row["raw_amounts"] is None else row["raw_amounts"])]
    request = {"text": (row["text"] or "")[:TEXT], "amounts": amounts} | {k: row[k] for k in ("agency", "sector", "procurement_stage", "signal_type", "signal_strength")}
    try:
        found = parse(call(request))
        kept = {"signal_strength": row["signal_strength"], "strategic_fit": row["strategic_fit"]}
        return {k: str(found.get(k, kept.get(k, "")))[:size] for k, size in ANSWER.items()}
    except Exception:  # whatever the remote side does, the rules' values stand
        return {k: row[f"__{k}"] if k in ("signal_title", "strategic_notes") else row[k] for k in ANSWER}


def remote(call: Callable[[dict], str]) -> Callable[[DataFrame], DataFrame]:
    """An `enrich` for the pipeline: call(request) returns the raw answer; L2's templates stand where it fails."""
    def enrich(rows: DataFrame) -> DataFrame:
        plain = rows.withColumns({"__signal_title": rules.fallback_title(F.col("text"), F.col("agency")), "__strategic_notes": rules.fallback_notes(F.col("sector"), F.col("procurement_stage"))})

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                made = [answered(r, call) for r in frame.to_dict("records")]
                yield frame.assign(**{k: [m[k] for m in made] for k in ANSWER}).drop(columns=["__signal_title", "__strategic_notes"])

        return plain.mapInPandas(run, rows.schema)

    return enrich
