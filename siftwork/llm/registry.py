"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from . import decontaminate, html_extract, langid, line_dedup, near_dedup, packing, quality_classifier, quality_rules, toxicity, warc

QUERIES = {
    "op1_html_extract": html_extract.query,
    "op2_quality_classifier": quality_classifier.query,
    "op3_quality_rules": quality_rules.query,
    "op4_decontaminate": decontaminate.query,
    "op5_langid": langid.query,
    "op6_near_dedup": near_dedup.query,
    "op7_line_dedup": line_dedup.query,
    "op8_toxicity": toxicity.query,
    "op9_warc": warc.query,
    "op10_packing": packing.query,
}

ORACLES = {
    "op4_decontaminate": decontaminate.ORACLE,
    "op9_warc": warc.ORACLE,
}
