"""Row-wise rules against values worked out by hand from their definition."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siftwork.functions import relevance, rules, similarity, urls
from siftwork.functions import text as T
from siftwork.operators import order


def values(spark, rows, make):
    frame = spark.createDataFrame([(k, *(r if isinstance(r, tuple) else (r,))) for k, r in enumerate(rows)], "k int, a string" + (", b string" if isinstance(rows[0], tuple) else ""))
    return [r[0] for r in frame.orderBy("k").select(make).collect()]


def test_stage(spark):
    texts = ["Staff to award construction contract next week", "Discussion of the plan", "We expect an RFP and later a study", "", "The extension of the lane", "Upcoming solicitation. " + "x" * 130 + " A workshop was held"]
    got = values(spark, texts, rules.stage_evidence(F.col("a"))["stage"])
    # the last: the solicitation lies in the future, so the present workshop wins
    assert got == ["Construction Authorization", "Concept/Discussion", "Prequalification (ITB/RFQ set up)", "", "Active Contract", "Concept/Discussion"]


def test_stage_evidence_window(spark):
    text = "a" * 100 + " change order " + "b" * 100
    [evidence] = values(spark, [text], rules.stage_evidence(F.col("a"))["evidence"])
    at = text.index("change order")
    assert evidence == text[at - 60 : at + 12 + 60].strip()


def test_evidence_comes_from_the_first_listed_pattern(spark):
    # "extension" stands earlier in the text, but "change order" earlier in the list
    [evidence] = values(spark, ["extension " + "z" * 150 + " change order"], rules.stage_evidence(F.col("a"))["evidence"])
    assert evidence.endswith("change order") and "extension" not in evidence


def test_signal_type(spark):
    rows = [("an ordinance", "meetings"), ("a grant award", "meetings"), ("lunch", "meetings"), ("x", "procurement"), ("x", "cip"), ("the cip list", ""), ("bond issue", ""), ("x", "")]
    got = values(spark, rows, rules.signal_type(F.col("a"), F.col("b")))
    assert got == ["Policy Direction", "Funding Allocation", "Commission Agenda", "Procurement (ITB/RFQ)", "Capital Budget", "Capital Budget", "Funding Allocation", ""]


def test_timeline(spark):
    rows = [("in the NEXT 30 days", ""), ("Responses due March 15, 2025", ""), ("will begin in Summer 2026", ""), ("Completion date: May 2027", ""), ("x", "Active Contract"), ("FY 2025 Q3", ""), ("", "")]
    got = values(spark, rows, rules.timeline(F.col("a"), F.col("b")))
    # text is lower-cased first, so the fiscal-year pattern never fires
    assert got == ["~30 days", "Due march 15, 2025", "begin in summer 2026", "Complete may 2027", "0-3 months", "", ""]


def test_amounts(spark):
    text = "Contract of $2,450,000.00 by June; $900 fee; $3.5 million and $45 million more, $1500"
    [found] = values(spark, [text], rules.amounts(F.col("a")))
    # a following b is read as billion, and an amount without commas stops after three digits
    assert [(a["raw"], a["value"]) for a in found] == [("$2,450,000.00 b", 2_450_000e9), ("$3.5 million", 3.5e6), ("$45 million", 45e6)]
    for a in found:
        at = text.index(a["raw"])
        assert a["context"] == text[max(0, at - 60) : at + len(a["raw"]) + 60].strip()


def test_repeated_amounts_keep_their_places(spark):
    text = "first $1,000 here " + "x" * 100 + " then $1,000 there"
    [found] = values(spark, [text], rules.amounts(F.col("a")))
    assert len(found) == 2 and found[0]["context"].startswith("first") and found[1]["context"].endswith("there")


@pytest.mark.parametrize(("raw", "value"), [("$1,200", 1200.0), ("$1.5 million", 1.5e6), ("2B", 2e9), ("", None), ("n/a", None), ("$", None), ("$5 m", 5e6), ("1e3", 1000.0)])
def test_parse_amount(spark, raw, value):
    assert values(spark, [raw], rules.parse_amount(F.col("a"))) == [value]


def test_best_amount(spark):
    texts = ["none", "only $1,000", "x $2,000 y " + "q" * 80 + " total $1,500", "a $2,000 z " + "q" * 130 + " c $9,000 z " + "q" * 130 + " $9,000 z"]
    assert values(spark, texts, rules.best_amount(rules.amounts(F.col("a")))) == ["", "$1,000", "$1,500", "$9,000"]


def test_friction_strength_fit(spark):
    assert values(spark, ["a lawsuit", "it depends", "fine", "deferred and permitting"], rules.friction(F.col("a"))) == ["High", "Moderate", "Low", "High"]
    got = values(spark, [("RFQ 2025 project no 5 approved", "Active Contract"), ("approved", "Concept/Discussion"), ("x", "")], rules.strength(F.col("a"), F.col("b"), F.lit(False), F.lit(True)))
    assert got == ["High", "Medium", "Low"]
    frame = spark.createDataFrame([(0.3, "High"), (0.3, "Medium"), (0.15, "Low"), (0.04, "High")], "r double, l string")
    assert [r[0] for r in frame.select(rules.fit(F.col("r"), F.col("l"))).collect()] == ["Strong Fit", "Moderate Fit", "Monitor", "No Fit"]


def test_trigger_agency_geography_date(spark):
    assert values(spark, ["The ITB 2025-01 for\n pipes. More", "x"], rules.trigger(F.col("a"))) == ["ITB 2025-01 for pipes", ""]
    assert values(spark, ["by the City of Fair View Commission", "nobody"], rules.agency(F.col("a"), F.lit("D"))) == ["City of Fair View", "D"]
    assert values(spark, ["in south-beach now", "district 4", "city-wide", "x"], rules.geography(F.col("a"), F.lit("Town"), ["South Beach"])) == ["Town (South-Beach)", "Town (District 4)", "Town (City-Wide)", "Town"]
    assert values(spark, ["in ward 2"], rules.geography(F.col("a"), F.lit("Ward 2, Town"))) == ["Ward 2, Town"]
    assert values(spark, ["Meeting of May 1, 2025", "held 3/4/2025", "x"], rules.meeting_date(F.col("a"), F.lit("?"))) == ["May 1, 2025", "3/4/2025", "?"]


def brute_relevance(text: str, words) -> float:
    import re

    low, hits, unique, bonus = text.lower(), 0, 0, 0.0
    for w in words:
        p = re.compile(r"\b" + re.escape(w.lower()) + r"\b")
        n = len(p.findall(low))
        hits, unique = hits + n, unique + (n > 0)
        bonus += 0.15 if p.search(low[:200]) else 0
    if not hits:
        return 0.0
    return round(min(0.4 * min(hits / (max(len(low.split()), 1) / 50), 1) + 0.35 * min(unique / max(0.3 * len(words), 1), 1) + 0.25 * min(bonus, 0.3), 1), 3)


def test_relevance(spark):
    words = ("sewer", "sewer line", "I&I", "force main")
    texts = ["Sewer line work on the sewer", "I&I study", "nothing", "", "the sewers", " ".join(["word"] * 300) + " force main"]
    assert values(spark, texts, relevance.relevance(F.col("a"), words)) == pytest.approx([brute_relevance(t, words) for t in texts], abs=0.0011)


def test_best_sector_ties_and_threshold(spark):
    frame = spark.createDataFrame([("water and sewer",), ("x",), (None,)], "text string")
    packs = {"sewer": ("sewer",), "water": ("water",)}
    assert [tuple(r) for r in relevance.scored(frame, packs).select("sector", F.col("relevance_score") > 0).collect()] == [("sewer", True), ("", False), ("", False)]
    assert relevance.relevant(frame, packs, 0.0).count() == 3 and relevance.relevant(frame, packs).count() == 1


def test_project_ids_and_tokens(spark):
    [ids] = values(spark, ["See ITB 2025-089 for it, project number: A-7 and Resolution No. 2024-55; CIP SW 2025 08"], similarity.project_ids(F.col("a")))
    assert "A-7" in ids and "RESOLUTION-NO.-2024-55" in ids and any(i.startswith("ITB-2025-089") for i in ids)
    assert values(spark, ["The City of Miami: Pipe, pipe 12"], similarity.tokens(F.col("a"))) == [["pipe", "12"]]


def test_urls(spark):
    u = ["https://a.gov/x/x/y//z/z?q=1#f", "http://A.GOV/B/", "not a url", ""]
    assert values(spark, u, urls.canonical(F.col("a"))) == ["https://a.gov/x/y//z?q=1#f", "http://A.GOV/B/", "not a url", ""]
    assert values(spark, u[:2], urls.normal(F.col("a"))) == ["https://a.gov/x/y//z?q=1#f", "http://a.gov/b"]
    assert values(spark, ["https://evilexample.gov/", "https://x.com/"], urls.allowed(F.col("a"), ["example.gov"])) == [True, False]
    assert values(spark, ["/bid/1", "/capital/2", "/finance/", "/agenda/", "/z"], urls.category(F.col("a"), F.lit("p"))) == ["procurement", "cip", "budget", "meetings", "p"]
    assert values(spark, ["www.key-biscayne.gov"], urls.site_name(F.col("a"))) == ["key_biscayne"]
    assert values(spark, ["City of Miami Beach Home, FL"], urls.agency_place(F.col("a"), F.lit("h"))["agency"]) == ["City of Miami Beach"]


def test_title_case_and_marks(spark):
    assert values(spark, ["city-wide zone 4b"], T.title_case(F.col("a"))) == ["City-Wide Zone 4B"]
    frame = spark.createDataFrame([("High",), ("",)], "signal_strength string")
    assert [r[0] for r in frame.select(order.marked("signal_strength")).collect()] == ["🟢 High", ""]


def test_relevance_searches_words_as_plain_strings(spark):
    words = ["pump", "pump_a", "air", "apache license", "water-main"]
    texts = ["pump pump pump_a apump pump2 \u00e9pump pump\u0301 pump", "pump", "air\u2019s PUMP-air,air apache license  apache  license", "water-main water main pump water-mains", "  ", ""]
    assert values(spark, texts, relevance.relevance(F.col("a"), words)) == pytest.approx([brute_relevance(t, words) for t in texts], abs=0.0011)
    packs = {f"p{i}": tuple(f"word{i}x{j}" for j in range(9)) for i in range(9)}
    plan = relevance.scored(spark.createDataFrame([("a",)], "text string"), packs)._jdf.queryExecution().optimizedPlan().toString()
    # one pattern for the words, one for those of the title and one that counts all, however many keywords there are
    assert plan.count("(?U") == 3
