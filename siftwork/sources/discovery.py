"""Site discovery (U16, U19): home pages to site configurations.

Each home page is parsed once, in Arrow batches; places, content systems, seeds and the look at the meetings page are
column expressions and joins over the table of fetched pages.
"""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from . import html_chunks

# What a candidate link is not.
STATIC = (".jpg", ".jpeg", ".png", ".gif", ".css", ".js", ".ico", ".woff", ".woff2")
SCHEMES = ("mailto:", "tel:", "javascript:", "#")
_PLACE = r"^(?:City|Village|Town|County|Borough|Municipality)\s+of\s+"


def candidates(html: str | None, base: str, root: html_chunks.Element | None = None) -> list[dict[str, str]]:
    """U16: (url, text) of a home page's http(s) links to its own host, its bare host or a subdomain, first seen first.

    Static files are dropped, fragments cut, anchors cut to 120 characters. Links that cannot be parsed are left out.
    """
    netloc = urlsplit(base or "").netloc
    bare = netloc.removeprefix("www.")
    found: dict[str, str] = {}
    for a in (root or html_chunks.tree(html or "")).all("a"):
        href = (a.attributes.get("href") or "").strip()
        if not href or href.startswith(SCHEMES):
            continue
        try:
            url = urljoin(base or "", href).partition("#")[0]
            host = urlsplit(url).hostname or ""
        except ValueError:
            continue
        own = host in (netloc, bare) or host.endswith(f".{bare}")
        if own and url.startswith(("http://", "https://")) and not url.lower().endswith(STATIC):
            found.setdefault(url, a.text()[:120])
    return [{"url": u, "text": t} for u, t in found.items()]


def _home(html: str | None, base: str) -> dict:
    root = html_chunks.tree(html or "")
    title, head = next(iter(root.all("title")), None), next(iter(root.all("h1")), None)
    told = next((m.attributes.get("content") for m in root.all("meta") if m.attributes.get("name") == "description"), None)
    return {"title": title.text() if title else "", "description": told[:300] if told else None,
            "heading": head.text()[:200] if head else None, "links": candidates(html, base, root)}


_LINK = pa.struct([("url", pa.string()), ("text", pa.string())])
_HOME = pa.struct([("title", pa.string()), ("description", pa.string()), ("heading", pa.string()), ("links", pa.list_(_LINK))])


def candidate_links(homes: DataFrame) -> DataFrame:
    """U16: homes(url, html, ...) with one row a candidate: link_no, link, anchor."""
    based = homes.withColumn("__base", F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1))
    made = html_chunks.mapped(based, candidates, "__links", pa.list_(_LINK), ("html", "__base")).drop("html", "__base")
    return made.select("*", F.posexplode("__links").alias("link_no", "__l")).select("*", F.col("__l.url").alias("link"), F.col("__l.text").alias("anchor")).drop("__links", "__l")


def discover(homes: DataFrame, sitemaps: DataFrame | None = None, web: DataFrame | None = None) -> DataFrame:
    """homes(url, html, and final_url where redirected) to one configuration a home, as config.emitted() takes it.

    sitemaps(base_url, pos, url) add candidates; web(url, status_code, html) is asked for the meetings seed of a site
    without a known content system. The best description of the place is the first of title, meta description and first
    heading that names a city, village, town, county, borough or municipality. Equal home URLs give one configuration.
    """
    asked = F.when(F.col("url").rlike("^https?://"), F.col("url")).otherwise(F.concat(F.lit("https://"), F.col("url")))
    final = F.coalesce("final_url", asked) if "final_url" in homes.columns else asked
    origin = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"
    first = homes.select(F.regexp_extract(asked, origin, 1).alias("asked"), F.regexp_extract(final, origin, 1).alias("base_url"), F.coalesce("html", F.lit("")).alias("html"))
    first = first.groupBy("base_url").agg(F.min_by(F.struct("asked", "html"), F.struct("asked", "html")).alias("r")).select("base_url", "r.*")
    read = html_chunks.mapped(first, _home, "home", _HOME, ("html", "base_url")).withColumn("netloc", urls.part(F.col("base_url"), 2))
    told = F.array("home.title", "home.description", "home.heading")
    placed = read.withColumn("places", F.transform(told, lambda t: urls.agency_place(t, F.col("netloc"))))
    named = F.filter("places", lambda p: T.hits(p["agency"], _PLACE, True))
    sites = placed.withColumns({"place": F.coalesce(F.get(named, F.lit(0)), F.get("places", F.lit(0))), "system": urls.cms(F.col("html"))}).select(
        "base_url", "asked", "netloc", "place", "system", F.col("home.links").alias("links"))

    own = sites.select("base_url", F.posexplode("links").alias("pos", "l")).select("base_url", F.lit(0).alias("from"), "pos", "l.url", "l.text")
    if sitemaps is not None:
        mapped = sitemaps.join(sites.select("base_url"), "base_url", "left_semi")
        own = own.unionByName(mapped.select("base_url", F.lit(1).alias("from"), F.col("pos").cast("int").alias("pos"), "url", F.lit("").alias("text")))
    links = own.groupBy("base_url", "url").agg(F.min_by("text", F.struct("from", "pos")).alias("text"), F.min("from").alias("from"))
    counted = links.groupBy("base_url").agg(F.count("*").alias("candidates"))
    if sitemaps is not None:
        counted = counted.join(mapped.groupBy("base_url").agg(F.count("*").alias("mapped")), "base_url", "left")
    else:
        counted = counted.withColumn("mapped", F.lit(0))
    seeds = urls.seeds(links.select("base_url", "url", "text"), ("base_url",))
    # two of each category at most
    chosen = seeds.groupBy("base_url").agg(F.array_sort(F.collect_list(F.struct("category_no", "rank", "url", "category", "label"))).alias("s"))
    chosen = chosen.withColumn("seeds", F.transform("s", lambda s: F.struct(s["url"].alias("url"), s["category"].alias("category"), s["label"].alias("label"))))
    meeting = F.get(F.filter("seeds", lambda s: s["category"] == "meetings"), F.lit(0))["url"]
    out = sites.drop("links").join(counted, "base_url", "left").join(chosen.select("base_url", "seeds", meeting.alias("meeting")), "base_url", "left")
    out = out.withColumn("peeked", F.lit(None).cast("struct<mode:string,api_base:string>"))
    if web is not None:
        pages = web.where("status_code = 200").select(F.col("url").alias("meeting"), "html")
        wanted = out.where("system.mode = 'default' and meeting is not null").select("base_url", "meeting")
        seen = wanted.join(pages, "meeting").select("base_url", urls.cms(F.coalesce("html", F.lit(""))).alias("seen")).where("seen.mode = 'primegov'")
        seen = seen.groupBy("base_url").agg(F.max("seen").alias("seen"))
        out = out.join(seen, "base_url", "left").withColumn("peeked", F.col("seen")).drop("seen")
    return out.select(*_columns())


def _columns() -> list:
    system, peeked = F.col("system"), F.col("peeked")
    used = F.coalesce(peeked, system)
    api = urls.host(used["api_base"])
    domains = urls.site_domains(F.col("netloc"))
    seeds = F.coalesce("seeds", F.array().cast("array<struct<url:string,category:string,label:string>>"))
    api_or = lambda c, other: F.when(c["api_base"] != "", c["api_base"]).otherwise(other)
    notes = [
        F.when(F.col("asked") != F.col("base_url"), F.concat(F.lit("Redirected to "), "base_url")),
        F.when(system["mode"] == "primegov", F.concat(F.lit("Detected PrimeGov CMS at "), api_or(system, "(subdomain not found)"))).when(
            system["mode"] != "default", F.concat(F.lit("Detected CMS hint: "), system["mode"], F.lit(" (using default crawler)"))),
        F.when(F.col("mapped") > 0, F.concat(F.lit("Found sitemap with "), F.col("mapped").cast("string"), F.lit(" URLs"))),
        F.concat(F.lit("Discovered "), F.coalesce("candidates", F.lit(0)).cast("string"), F.lit(" candidate links")),
        F.when(peeked.isNotNull(), F.concat(F.lit("PrimeGov detected on meetings page → "), api_or(peeked, "(subdomain not extracted)"))),
        F.when(F.size(seeds) == 0, F.lit("⚠ No seeds detected — add them manually before saving"))]
    return [
        urls.site_name(F.col("netloc")).alias("name"), F.col("place.display_name").alias("display_name"), "base_url", F.col("place.agency").alias("default_agency"),
        F.col("place.geography").alias("default_geography"), used["mode"].alias("crawler_mode"), used["api_base"].alias("primegov_api_base"),
        F.when(used["mode"].eqNullSafe("primegov") & (api != ""), F.array_union(domains, F.array(api))).otherwise(domains).alias("allowed_domains"), seeds.alias("seeds"),
        F.array(*map(F.lit, urls.PRIORITY)).alias("priority_patterns"), F.array(*map(F.lit, urls.IGNORED)).alias("ignore_patterns"),
        F.array().cast("array<string>").alias("neighborhoods"), F.array_compact(F.array(*notes)).alias("notes")]
