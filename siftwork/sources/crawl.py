"""The crawl as tables (S4-S7, S10): a frontier loop over a table of fetched pages instead of the network.

`web` holds what a fetch would give, one row a URL: url, status_code, content_type, html. Each depth is one join of the
frontier with the web and an anti-join with what was visited; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls
from ..storage import materialize
from . import html_chunks

# Content types whose body is kept.
PAGES = ("text/html", "application/xhtml+xml")
FILES = ("application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/msword")


def classified(web: DataFrame) -> DataFrame:
    """What a fetch makes of a response: content_type in lower case without parameters, and error ('' if it is kept)."""
    kind = F.lower(F.trim(F.split(F.coalesce("content_type", F.lit("text/html")), ";")[0]))
    error = F.when(F.col("status_code") != 200, F.concat(F.lit("HTTP "), F.col("status_code").cast("string"))).when(~kind.isin(*PAGES, *FILES), F.concat(F.lit("Unsupported type: "), kind)).otherwise("")
    return web.withColumns({"content_type": kind, "error": error})


def crawl(seeds: DataFrame, web: DataFrame, domains: list[str], max_depth: int = 3, max_pages: int = 200, priority=urls.PRIORITY, ignored=urls.IGNORED) -> DataFrame:
    """seeds(url, category, pos) and the table of the web to url, category, depth, seq and the web's columns.

    Breadth first: pages by depth, then parent, then priority links before others, then link order. A URL is visited
    once (by its normal form); pages with the same visible text count once; errors take no place.
    """
    pages = classified(web).withColumn("__key", urls.normal(F.col("url")))
    # of URLs with one normal form the least URL's page, and of equal URLs the least row, whatever the task order
    columns = [c for c in pages.columns if c not in ("url", "__key")]
    pages = pages.groupBy("__key").agg(F.min_by(F.struct(*columns), F.struct("url", F.xxhash64(*columns))).alias("r")).select("__key", "r.*")
    allowed = urls.allowed(F.col("url"), domains) & ~urls.mentions(F.col("url"), ignored)
    first = seeds.where(allowed).select("url", "category", F.array(F.col("pos").cast("bigint")).alias("path"), urls.normal(F.col("url")).alias("__key"))
    frontier, visited, found = _once(first), None, None
    for depth in range(max_depth + 1):
        level = materialize(frontier.join(pages, "__key").withColumn("depth", F.lit(depth)), f"crawl{depth}")
        found = level if found is None else found.unionByName(level)
        seen = frontier.select("__key")
        visited = materialize(seen if visited is None else visited.unionByName(seen), f"visited{depth}")
        if depth == max_depth:
            break
        inner = level.where((F.col("error") == "") & F.col("content_type").isin(*PAGES)).select("url", "html", "path", "category")
        out = html_chunks.extracted_links(inner, domains)
        ranked = out.withColumn("__prior", (~urls.mentions(F.col("link"), priority)).cast("bigint"))
        children = ranked.where(urls.allowed(F.col("link"), domains) & ~urls.mentions(F.col("link"), ignored)).select(
            F.col("link").alias("url"), urls.category(F.col("link"), F.col("category")).alias("category"), F.concat("path", F.array("__prior", F.col("link_no").cast("bigint"))).alias("path"), urls.normal(F.col("link")).alias("__key"))
        frontier = materialize(_once(children).join(visited, "__key", "left_anti"), f"frontier{depth}")
        if frontier.isEmpty():
            break
    kept = html_chunks.hashed(found.where("error = ''"))
    kept = urls.keep_first_content(kept.withColumn("__order", F.struct("depth", "path")), "content_hash", "__order")
    # the page limit is a feature; the rank is taken over the limited rows only
    limited = kept.orderBy("depth", "path").limit(max_pages)
    return limited.withColumn("seq", F.row_number().over(Window.orderBy("depth", "path"))).drop("__key", "__order", "path", "content_hash")


def _once(links: DataFrame) -> DataFrame:
    """Each URL from the first place it was met."""
    return links.groupBy("__key").agg(F.min_by(F.struct("url", "category", "path"), "path").alias("r")).select("__key", "r.*")


# The JSON of a meeting listing.
MEETING = "id bigint, title string, date string, dateTime string, documentList array<struct<id:bigint,compileOutputType:int,templateName:string>>"


def meetings(listing: DataFrame, api_base: str, max_pages: int = 200) -> DataFrame:
    """Listing (MEETING columns and pos) to one row a meeting that has an agenda: the last document of output type 3."""
    each = listing.select("id", "title", "date", "pos", F.posexplode("documentList").alias("at", "document")).where("document.compileOutputType = 3")
    picked = each.groupBy("pos", "id", "title", "date").agg(F.max_by("document.id", "at").alias("document_id"))
    link = F.concat(F.lit(f"{api_base}/Portal/Meeting?compiledMeetingDocumentFileId="), F.col("document_id").cast("string"))
    return picked.orderBy("pos").limit(max_pages).select("pos", "id", "document_id", F.concat_ws(" — ", "title", "date").alias("title"), link.alias("url"), F.lit("meetings").alias("category"))


def read_meetings(spark, path: str) -> DataFrame:
    """Meeting listings, one JSON array a file (one file a year); files that are no list give no rows."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", f"array<struct<{_fields(MEETING)}>>").alias("m"))
    each = text.select("file", F.posexplode("m").alias("at", "meeting")).select("file", "at", "meeting.*")
    return each.withColumn("pos", F.struct("file", "at")).drop("file", "at")


def _fields(ddl: str) -> str:
    """Column definitions as struct fields."""
    out, depth, part = [], 0, ""
    for ch in ddl + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = part.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            part = ""
        else:
            part += ch
    return ",".join(out)


def sitemap_urls(files: DataFrame, limit: int = 300) -> DataFrame:
    """Of sitemap files (pos, body), the <loc> URLs of the first that has any, 300 at most."""
    locs = F.regexp_extract_all("body", F.lit(r"<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    first = files.withColumn("locs", locs).where("size(locs) > 0").orderBy("pos").limit(1)
    return first.select(F.posexplode(F.slice("locs", 1, limit)).alias("pos", "url"))
