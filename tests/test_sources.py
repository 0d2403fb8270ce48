"""Chunks, links, crawl, paged texts, configuration, sinks, SQL functions, stream and command line."""

from __future__ import annotations

import csv
import json
import zipfile
from xml.etree import ElementTree

import duckdb
import pytest
from pyspark.sql import functions as F

from siftwork import cli
from siftwork import vocab as V
from siftwork.functions.register import register_functions
from siftwork.plans import pipeline
from siftwork.sources import config, crawl, html_chunks, paged_text, sinks
from siftwork.streaming import incremental

AGENDA = """<html><head><title>Regular Meeting</title><meta name="last-updated" content="2025-05-01"></head><body><nav>Menu</nav>
<h2>Item 1 Water main replacement</h2><p>Award construction contract for the water main, ITB 2025-089, at $1,200,000.</p>
<h2>Item 2 Lift station</h2><p>Discussion of the sewer lift station and its force main.</p><h2>Consent Agenda</h2><footer>f</footer></body></html>"""
BIDS = """<html><title>Open bids</title><table><tr><th>Title</th><th>Due</th></tr><tr><td>Pump station repair in the north</td><td>May 3</td></tr><tr><td>x</td><td>y</td></tr></table></html>"""
CIP = """<html><title>CIP</title><p><b>Project: Water main replacement</b><br>Award construction contract ITB 2025-089 $1,250,000</p><p>More about the water main.</p>
<p><b>Project: Sewer rehabilitation</b><br>Study of sewer lift station and force main</p></html>"""


def test_agenda_items():
    got = html_chunks.chunks(AGENDA, "meetings")
    assert [c["title"] for c in got] == ["Item 1 Water main replacement", "Item 2 Lift station"]
    assert got[0]["text"].endswith("at $1,200,000.") and got[0]["date"] == "2025-05-01" and {c["chunk_type"] for c in got} == {"agenda_item"}


def test_agenda_rows_solicitations_projects():
    assert html_chunks.chunks("<title>Minutes</title><table><tr><td>A long enough row of a table</td><td>with cells</td></tr></table>", "")[0]["text"] == "A long enough row of a table | with cells"
    [bid] = html_chunks.chunks(BIDS, "")
    assert bid == {"text": "Pump station repair in the north | May 3", "title": "Pump station repair in the north | May 3", "date": "", "chunk_type": "solicitation", "category": "procurement"}
    [card] = html_chunks.chunks('<div class="BidCard open">Repair of the pump\n<p>due in the month of May</p></div>', "procurement")
    assert card["title"] == "Repair of the pump" and card["category"] == "procurement"
    got = html_chunks.chunks(CIP, "cip")
    assert [c["title"] for c in got] == ["Water main replacement", "Sewer rehabilitation"] and "More about" in got[0]["text"] and {c["chunk_type"] for c in got} == {"budget_line"}
    assert html_chunks.chunks(CIP.replace("Project: Sewer rehabilitation", "Sewers"), "cip")[0]["chunk_type"] == "section"  # one heading is too few


def test_fallback_and_empty_pages():
    assert html_chunks.chunks("", "") == [] and html_chunks.chunks("<p>short</p>", "") == []
    [got] = html_chunks.chunks(f"<title>T</title><main><p>{'word ' * 20}</p></main><p>outside of the main part</p>", "budget")
    assert got["text"] == ("word " * 20).strip() and got["chunk_type"] == "section"


def test_links_and_hash(spark):
    html = '<nav>m</nav><a href=" /a/a/b#x ">One</a><a href="mailto:x">m</a><a href="http://other.org/">o</a><a>no</a><a href="c?d=1&amp;e=2">T</a>'
    assert html_chunks.links(html, "http://x.gov/d/", ["x.gov"]) == [{"url": "http://x.gov/a/b", "text": "One"}, {"url": "http://x.gov/d/c?d=1&e=2", "text": "T"}]
    assert html_chunks.content_hash("<nav>a</nav><p>b</p>") == html_chunks.content_hash("<header>c</header><p> b </p>") != html_chunks.content_hash("<p>c</p>")
    assert html_chunks.content_hash("") == html_chunks.content_hash(None) == ""
    frame = spark.createDataFrame([("u", html, 1), ("v", None, 2)], "url string, html string, extra int")
    assert html_chunks.extracted_links(frame).count() == 3 and html_chunks.hashed(frame).where("content_hash = ''").count() == 1


def test_hash_of_references_without_semicolon(spark, tmp_path):
    from siftwork import queries

    pages = [(1, "u1", "<title>a&amp;&amp</title><p>x &lt y &#x27;&#39 &amp;lt; & z&</p>"), (2, "u2", "<p>a&amp;&amp;</p>"), (3, "u3", "<p>a&amp;&amp</p>"), (4, "u4", "")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in queries.QUERIES["content_hash_dedupe"](spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(db.execute(queries.ORACLES["content_hash_dedupe"]).fetchall()) and len(got) == 4


def test_crawl(spark):
    page = "<a href='/agenda/1'>a</a><a href='/b'>b</a><a href='/parks/x'>p</a><a href='/b/'>again</a>"
    web = [("http://x.gov/", 200, "text/html; charset=utf-8", page + "home"), ("http://x.gov/b", 200, "text/html", "<a href='/deep'>d</a> b"), ("http://x.gov/agenda/1", 200, "TEXT/HTML", "agenda"),
           ("http://x.gov/deep", 200, "text/html", "agenda"), ("http://x.gov/parks/x", 200, "text/html", "parks"), ("http://x.gov/gone", 404, "text/html", "")]
    frame = spark.createDataFrame(web, "url string, status_code int, content_type string, html string")
    seeds = spark.createDataFrame([("http://x.gov/", "", 0), ("http://x.gov/gone", "", 1)], "url string, category string, pos int")
    got = crawl.crawl(seeds, frame, ["x.gov"]).orderBy("seq").collect()
    # priority links first; the deep page repeats the agenda's text; ignored and failed ones take no place
    assert [(r["url"], r["depth"], r["category"]) for r in got] == [("http://x.gov/", 0, ""), ("http://x.gov/agenda/1", 1, "meetings"), ("http://x.gov/b", 1, "")]
    assert crawl.crawl(seeds, frame, ["x.gov"], max_pages=2).count() == 2 and crawl.crawl(seeds, frame, []).count() == 0


def test_meetings_and_sitemaps(spark, tmp_path):
    listing = [{"id": 1, "title": "M", "date": "May 1", "dateTime": "", "documentList": [{"id": 7, "compileOutputType": 3, "templateName": "a"}, {"id": 8, "compileOutputType": 3, "templateName": "b"}]},
               {"id": 2, "title": "N", "date": "", "documentList": [{"id": 9, "compileOutputType": 1}]}]
    (tmp_path / "2024.json").write_text(json.dumps(listing))
    (tmp_path / "2025.json").write_text('{"error": 1}')
    got = crawl.meetings(crawl.read_meetings(spark, f"file://{tmp_path}/*.json"), "https://fair.example.org").collect()
    assert [(r["id"], r["document_id"], r["title"], r["url"]) for r in got] == [(1, 8, "M — May 1", "https://fair.example.org/Portal/Meeting?compiledMeetingDocumentFileId=8")]
    files = spark.createDataFrame([(0, "none"), (1, "<loc> a </loc><loc>b</loc>"), (2, "<loc>c</loc>")], "pos int, body string")
    assert [r["url"] for r in crawl.sitemap_urls(files).orderBy("pos").collect()] == ["a", "b"]


def brute_pack(pages: list[tuple[int, str]]) -> list[tuple[str, str]]:
    out, buffer, first = [], "", 1
    for number, text in pages:
        if buffer and len(buffer) + len(text) > 4000:
            out.append((buffer, f"{first}-{number - 1}"))
            buffer, first = text, number
        else:
            buffer += "\n\n" + text
    if buffer.strip():
        out.append((buffer, f"{first}-{pages[-1][0] if pages else first}"))
    return out


def test_paged_text(spark):
    agenda = [(1, "Cover of the book"), (2, "Item 1 the pump house is in need of repair\nmore"), (3, "ORDINANCE on the water main and its valves\nMay 4, 2025")]
    long = [(1, "a" * 2500), (3, "b" * 2500), (4, "c" * 100)]
    budget = [(1, "The capital plan\nNORTH PUMP IMPROVEMENT will be built in the next year of the plan\nSOUTH TANK REPLACEMENT will come after that in the plan")]
    rows = [(d, n, t) for d, pages in (("a", agenda), ("l", long), ("b", budget), ("e", [(1, " ")])) for n, t in pages]
    docs = paged_text.pages_of(spark.createDataFrame(rows, "document string, page_no int, text string")).withColumn("category", F.lit(""))
    got = {}
    for r in paged_text.parsed(docs).orderBy("document", "chunk_no").collect():
        got.setdefault(r["document"], []).append((r["text"], r["page_number"], r["chunk_type"], r["category"], r["date"]))
    assert [(x[1], x[2], x[3]) for x in got["a"]] == [("1", "agenda_item", "meetings"), ("2", "agenda_item", "meetings")]  # a start on a page's last joint counts for that page
    assert got["a"][1][4] == "May 4, 2025"
    assert got["a"][0][0] == agenda[1][1]
    assert [(x[0], x[1]) for x in got["l"]] == brute_pack(long) and got["l"][0][2] == "section"
    assert [x[2] for x in got["b"]] == ["budget_line"] * 2 and "e" not in got


def resources(spark):
    rows = [(0, 0, "http://a.gov/x", "", "", "City of Fair", "Fair", "meetings", AGENDA), (0, 1, "http://a.gov/cip", "", "", "City of Fair", "Fair", "cip", CIP), (0, 2, "http://a.gov/e", "", "", "", "", "", None)]
    return spark.createDataFrame(rows, "site_no int, resource_no int, url string, final_url string, local_path string, default_agency string, default_geography string, category string, html string")


def test_pipeline_and_sinks(spark, tmp_path):
    every = pipeline.run(resources(spark), merge_projects=False).collect()
    merged = pipeline.run(resources(spark)).cache()
    rows = merged.collect()
    assert len(every) == 4 and len(rows) < 4 and rows[0]["signal_strength"] == "High" and rows[0]["sector"] == "water"
    assert [V.STRENGTHS[r["signal_strength"]] for r in rows] == sorted(V.STRENGTHS[r["signal_strength"]] for r in rows)
    with sinks.write_csv(merged, tmp_path / "o/x.csv").open(newline="", encoding="utf-8") as f:
        read = list(csv.reader(f))
    assert read[0] == [h for _, h, _ in V.DISPLAY] and [r[0] for r in read[1:]] == [r["signal_title"] for r in rows]
    with zipfile.ZipFile(sinks.write_workbook(merged, tmp_path / "x.xlsx")) as book:
        for name in book.namelist():
            ElementTree.fromstring(book.read(name))
        sheet = book.read("xl/worksheets/sheet1.xml").decode()
    assert sheet.count("<row ") == len(rows) + 1 and 'state="frozen"' in sheet and "<hyperlink " in sheet
    sinks.write_csv_parts(merged, f"file://{tmp_path}/parts")
    assert spark.read.option("header", True).option("multiLine", True).csv(f"file://{tmp_path}/parts").count() == len(rows)
    told = pipeline.run(resources(spark), enrich=pipeline.offline_enrichment, merge_projects=False).collect()
    assert all(r["signal_title"].startswith("City of Fair — ") and r["extraction_method"] == "ai" for r in told)


def test_sql_functions(spark):
    names = register_functions(spark)
    assert "page_chunks" in names
    [row] = spark.sql("select sw_friction('a lawsuit'), sw_parse_amount('$2 million'), sw_timeline('next 5 days', ''), sw_url_category('/bid/', 'x'), sw_fit(0.4, 'High')").collect()
    assert tuple(row) == ("High", 2e6, "~5 days", "procurement", "Strong Fit")
    spark.createDataFrame([(AGENDA, "meetings")], "html string, category string").createOrReplaceTempView("fetched")
    assert spark.sql("select c.title from fetched, lateral page_chunks(html, category) c").count() == 2


def test_stream(spark, tmp_path):
    frame = resources(spark)
    for k in range(2):
        frame.where(f"resource_no = {k}").write.parquet(f"file://{tmp_path}/in/{k}")
    source = f"file://{tmp_path}/in/*"
    for _ in range(2):  # a second run finds nothing new
        incremental.keep_history(spark, source, frame.schema, f"file://{tmp_path}/history", f"file://{tmp_path}/checkpoint").awaitTermination()
    history = spark.read.parquet(f"file://{tmp_path}/history")
    assert history.count() == 4
    assert incremental.projects(spark, f"file://{tmp_path}/history").count() == pipeline.run(frame).count()


def test_config_and_command_line(spark, tmp_path):
    (tmp_path / "sites").mkdir()
    (tmp_path / "sites/fair.yaml").write_text("default_agency: City of Fair\ndefault_geography: Fair\nneighborhoods: [North End]\n")
    (tmp_path / "sectors.yaml").write_text("sectors:\n  water:\n    keywords: [water main]\n  none:\n")
    assert config.sectors(config.load(tmp_path / "sectors.yaml")) == {"water": ("water main",), "none": ()}
    assert config.sector_table(spark, {"a": ("x", "y")}).count() == 2
    with pytest.raises(FileNotFoundError):
        config.load(tmp_path / "no.yaml")
    (tmp_path / "bad.yaml").write_text("a: [")
    with pytest.raises(ValueError, match="bad YAML"):
        config.load(tmp_path / "bad.yaml")
    (tmp_path / "sites/empty.yaml").write_text("")
    with pytest.raises(ValueError, match="empty"):
        config.site("empty", tmp_path)
    resources(spark).drop("site_no", "default_agency", "default_geography").withColumn("site", F.lit("fair")).write.parquet(f"file://{tmp_path}/res")
    cli.main(["-s", "fair", "-S", "water", "-c", str(tmp_path), "-r", f"file://{tmp_path}/res", "-o", str(tmp_path / "out.xlsx"), "--no-llm", "-y"], spark)
    assert (tmp_path / "out.xlsx").exists() and len(list(csv.reader((tmp_path / "out.csv").open(newline="", encoding="utf-8")))) == 2
    with pytest.raises(SystemExit):
        cli.main(["-s", "fair", "-S", "gold", "-c", str(tmp_path), "-r", f"file://{tmp_path}/res"], spark)
