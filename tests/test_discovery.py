"""Site discovery, remote enrichment, preflight, the relevance warning and sites with areas of their own."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from siftwork.functions import relevance
from siftwork.plans import enrichment, pipeline
from siftwork.sources import config, discovery

from .test_sources import resources

HOME = """<html><head><title>Home</title><meta name="description" content="none"></head><body><h1>Village of Oak Park, IL</h1>
<a href="/agenda/">Agendas</a><a href="/agenda/#x">again</a><a href="http://sub.oak.gov/bids">Bids</a><a href="//other.org/">o</a><a href="a.js">js</a><a href="http://[bad">b</a>
<a href="ftp://oak.gov/f">f</a><a>no</a></body></html>"""


def test_candidates():
    got = discovery.candidates(HOME, "https://www.oak.gov")
    assert got == [{"url": "https://www.oak.gov/agenda/", "text": "Agendas"}, {"url": "http://sub.oak.gov/bids", "text": "Bids"}]
    assert discovery.candidates(None, "https://www.oak.gov") == [] == discovery.candidates(HOME, "")[2:]
    assert len(discovery.candidates(f"<a href='/x'>{'y' * 500}</a>", "http://a.b")[0]["text"]) == 120


def test_discover(spark):
    rows = [("oak.gov/start", "https://www.oak.gov/", HOME), ("http://b.gov", None, "<title>Town of Elm | Home</title> via granicus.com"), ("http://c.gov", None, None)]
    homes = spark.createDataFrame([(*r, "x") for r in rows], "url string, final_url string, html string, name string")
    got = {r["base_url"]: r for r in discovery.discover(homes).collect()}
    oak, elm, none = got["https://www.oak.gov"], got["http://b.gov"], got["http://c.gov"]
    assert (oak["name"], oak["default_agency"], oak["default_geography"], oak["crawler_mode"]) == ("oak", "Village of Oak Park", "Oak Park, IL", "default")
    assert oak["allowed_domains"] == ["oak.gov", "www.oak.gov", "files.oak.gov"] and [s["url"] for s in oak["seeds"]] == ["https://www.oak.gov/agenda/", "http://sub.oak.gov/bids"]
    assert oak["notes"][0] == "Redirected to https://www.oak.gov" and oak["notes"][1] == "Discovered 2 candidate links"
    assert elm["default_agency"] == "Town of Elm" and elm["crawler_mode"] == "granicus" and any("granicus" in n for n in elm["notes"])
    assert none["seeds"] == [] and none["display_name"] == "c.gov" and none["notes"][-1].endswith("add them manually before saving")
    assert config.emitted(oak.asDict(recursive=True))["max_depth"] == 3
    assert discovery.discover(homes.limit(0)).count() == 0


def test_answers():
    row = {"text": "t" * 4000, "raw_amounts": [{"raw": "$5,000", "context": "c" * 300}], "agency": "A", "sector": "water", "procurement_stage": "", "signal_type": "", "signal_strength": "Low",
           "strategic_fit": "Monitor", "estimated_value": "$5,000", "__signal_title": "fallback", "__strategic_notes": "notes"}
    asked = []

    def call(request):
        asked.append(request)
        return "```json\n" + json.dumps({"signal_title": "x" * 200, "strategic_notes": "y" * 900, "strategic_fit": "Strong Fit"}) + "\n```"

    got = enrichment.answered(row, call)
    assert len(asked[0]["text"]) == 3000 and asked[0]["amounts"] == [f"$5,000 (context: {'c' * 100})"]
    assert got == {"signal_title": "x" * 120, "strategic_notes": "y" * 500, "estimated_value": "", "signal_strength": "Low", "strategic_fit": "Strong Fit"}
    for bad in (lambda r: "no json", lambda r: "[1]", lambda r: 1 / 0):
        assert enrichment.answered(row, bad) == {"signal_title": "fallback", "strategic_notes": "notes", "estimated_value": "$5,000", "signal_strength": "Low", "strategic_fit": "Monitor"}


def test_remote_enrichment(spark):
    def call(request):
        if "sewer" in request["text"].lower():
            raise RuntimeError("down")
        return '{"signal_title": "Told", "signal_strength": "High"}'

    rows = pipeline.run(resources(spark), merge_projects=False, enrich=enrichment.remote(call)).collect()
    titles = [r["signal_title"] for r in rows]
    assert len(rows) == 4 and "Told" in titles and any(t.startswith("City of Fair — ") for t in titles)
    assert all(r["estimated_value"] == "" and r["signal_strength"] == "High" for r in rows if r["signal_title"] == "Told")


@pytest.mark.parametrize("preflight", [lambda: "no key", lambda: 1 / 0])
def test_preflight_ends_the_run_before_it_is_planned(preflight):
    with pytest.raises(enrichment.NotReady):
        pipeline.run(None, preflight=preflight)
    enrichment.check(None)
    enrichment.check(lambda: None)


def test_relevance_warning(spark):
    chunks = pipeline.chunks(resources(spark))
    for threshold, passed in ((0.05, 4), (2.0, 0)):
        seen = Observation()
        assert relevance.relevant(chunks, {"water": ("water main", "sewer")}, threshold, seen).count() == passed
        assert seen.get == {"chunks": 4, "passed": passed} and relevance.warning(seen.get, threshold).startswith("0 of 4") == (passed == 0)
    assert relevance.warning({"chunks": 0, "passed": 0}) == ""


def test_each_site_has_its_own_areas(spark):
    one = resources(spark).where("resource_no = 0").withColumn("html", F.replace("html", F.lit("water main, ITB"), F.lit("water main in North End, ITB")))
    two = one.withColumns({"site_no": F.lit(1), "default_geography": F.lit("Elm")})
    got = {r["source_link"] + str(r["geography"]) for r in pipeline.run(one.unionByName(two), merge_projects=False, neighborhoods={0: ["North End"], 1: []}).collect()}
    assert any("Fair (North End)" in g for g in got) and not any("Elm (North End)" in g for g in got)
