"""URL and link operators (U1-U18) as column expressions.

A URL is cut by one pattern (scheme, authority, path, query, fragment), so malformed URLs give empty parts and never throw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import vocab as V
from . import text as T

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query with its mark, 5 fragment with its mark."""
    return F.regexp_extract(url, _PARTS, n)


def host(url: Column) -> Column:
    """Lower-cased host without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), r"^.*@", ""), r":\d*$", ""))


def collapse_path(path: Column) -> Column:
    """Without consecutive repetitions of a non-empty segment."""
    segments = F.split(path, "/")
    kept = F.filter(segments, lambda x, i: (i == 0) | (x == "") | (x != F.get(segments, i - 1)))
    return F.array_join(kept, "/")


def canonical(url: Column) -> Column:
    """The URL with its path collapsed."""
    head = F.regexp_extract(url, r"^((?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?)", 1)
    return F.concat(head, collapse_path(part(url, 3)), part(url, 4), part(url, 5))


def normal(url: Column) -> Column:
    """Canonical, without trailing slashes, in lower case."""
    return F.lower(F.regexp_replace(canonical(url), "/+$", ""))


def allowed(url: Column, domains) -> Column:
    """U4: whether the host ends with a domain; none allows nothing."""
    return F.exists(F.array(*map(F.lit, domains)), lambda d: F.endswith(host(url), d)) if domains else F.lit(False)


def mentions(url: Column, patterns) -> Column:
    """Whether any pattern is a substring, without regard to case."""
    lower = F.lower(url)
    out = F.lit(False)
    for p in patterns:
        out = out | F.contains(lower, F.lit(p.lower()))
    return out


def category(url: Column, parent: Column) -> Column:
    """The first category whose mark is in the URL, else the parent's."""
    return T.cases(((mentions(url, marks), F.lit(name)) for name, marks in V.CATEGORY_URLS), parent)


def keep_first_content(pages: DataFrame, content_hash: str, order: str) -> DataFrame:
    """The first page of each content hash; pages with an empty hash all stay."""
    rank = F.row_number().over(Window.partitionBy(content_hash).orderBy(order))
    # an empty hash is no group: these rows skip the window, so that they do not meet in one task
    empty = pages.where(F.coalesce(F.col(content_hash), F.lit("")) == "")
    return pages.where(F.col(content_hash) != "").withColumn("__rank", rank).where("__rank = 1").drop("__rank").unionByName(empty)


def extension(content_type: Column) -> Column:
    """U10."""
    return T.mapped(content_type, V.EXTENSIONS, ".bin")


def safe_name(url: Column, ext: Column) -> Column:
    """Hash prefix and the path's last part if it has a dot, else the extension."""
    tail = F.element_at(F.split(part(url, 3), "/"), -1)
    short = F.substring(F.md5(url.cast("binary")), 1, 10)
    return F.when(F.contains(tail, F.lit(".")), F.concat(short, F.lit("_"), tail)).otherwise(F.concat(short, ext))


def site_name(authority: Column) -> Column:
    """First label of the host without www, hyphens as one underscore."""
    bare = F.regexp_replace(F.lower(authority), r"^www\.", "")
    return F.regexp_replace(F.get(F.split(bare, r"\."), F.lit(0)), "-+", "_")


def site_domains(authority: Column) -> Column:
    """U13."""
    bare = F.regexp_replace(F.lower(authority), r"^www\.", "")
    return F.array_distinct(F.array(bare, F.concat(F.lit("www."), bare), F.concat(F.lit("files."), bare)))


_KINDS = "(?:City|Village|Town|County|Borough|Municipality)"
_AGENCY = rf"({_KINDS}\s+of\s+(?:[A-Z][\w\.]*\s+){{0,3}}[A-Z][\w\.]*)(?:,\s*([A-Z]{{2}}))?"


def agency_place(title: Column, authority: Column) -> Column:
    """struct(display_name, agency, geography) of a page title."""
    named = T.strip(F.regexp_extract(title, T.pattern(_AGENCY), 1))
    state = T.strip(F.regexp_extract(title, T.pattern(_AGENCY), 2))
    agency = T.strip(F.regexp_replace(named, T.pattern(r"\s+(?:Home|Welcome|Site|Government|Official|Main|Page)$", True), ""))
    place = T.strip(F.regexp_replace(agency, T.pattern(rf"^{_KINDS}\s+of\s+", True), ""))
    located = F.when(state != "", F.regexp_replace(F.concat(place, F.lit(", "), state), "^[, ]+|[, ]+$", "")).otherwise(place)
    plain = T.strip(F.get(F.split(title, r"[|·\-–]"), F.lit(0)))

    def made(name: Column, geography: Column) -> Column:
        return F.struct(name.alias("display_name"), name.alias("agency"), geography.alias("geography"))

    blank = F.coalesce(title, F.lit("")) == ""
    return F.when(blank, made(authority, F.lit(""))).when(T.hits(title, _AGENCY), made(agency, located)).otherwise(made(plain, F.lit("")))


def cms(html: Column) -> Column:
    """struct(mode, api_base)."""
    lower = F.lower(html)
    api = F.regexp_extract(html, r"(?i)https?://([\w-]+\.primegov\.com)", 1)

    def made(mode, base) -> Column:
        return F.struct(F.lit(mode).alias("mode"), base.alias("api_base"))

    others = [(mentions(lower, marks), made(name, F.lit(""))) for name, marks in V.CMS]
    return T.cases([(F.contains(lower, F.lit("primegov.com")), made("primegov", F.when(api != "", F.concat(F.lit("https://"), F.lower(api))).otherwise(""))), *others], made("default", F.lit("")))


def seeds(links: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """For every group of links(url, text), the best two of each category, by score, then URL, then text.

    A URL that an earlier category has already taken is dropped without a replacement. Returns category, category_no, rank, final,
    url, text and label beside the group's columns.
    """
    url, text = F.lower("url"), F.lower(F.coalesce("text", F.lit("")))
    path = part(F.col("url"), 3)
    depth = F.greatest(F.length(path) - F.length(F.replace(path, F.lit("/"))) - 1, F.lit(0))
    landing = F.when(path.rlike(r"(/|/index\.(php|html|aspx))$"), 2).otherwise(0)

    def score(words) -> Column:
        points = F.lit(0)
        for w in words:
            points = points + F.when(F.contains(url, F.lit(w)), 2).otherwise(0) + F.when(F.contains(text, F.lit(w)), 1).otherwise(0)
        return points

    scored = F.array(*[F.struct(F.lit(k).alias("category_no"), F.lit(name).alias("category"), score(words).alias("points")) for k, (name, words) in enumerate(V.SEEDS.items())])
    each = links.select(*by, "url", F.coalesce("text", F.lit("")).alias("text"), F.explode(F.filter(scored, lambda s: s["points"] > 0)).alias("s"), depth.alias("depth"), landing.alias("landing"))
    each = each.select(*by, "url", "text", "s.category_no", "s.category", (F.col("s.points") * 10 - F.col("depth") + F.col("landing")).cast("double").alias("final"))
    best = Window.partitionBy(*by, "category").orderBy(F.desc("final"), F.desc("url"), F.desc("text"))
    top = each.withColumn("rank", F.row_number().over(best)).where("rank <= 2")
    taken = F.row_number().over(Window.partitionBy(*by, "url").orderBy("category_no", "rank"))
    label = T.prefix(F.when(F.col("text") != "", F.col("text")).otherwise(F.initcap("category")), 80)
    return top.withColumn("__turn", taken).where("__turn = 1").drop("__turn").withColumn("label", label)


# Patterns that put a link first, and patterns that drop it.
PRIORITY = ("/agenda", "/meeting", "/minute", "/clerk", "/procurement", "/bid", "/rfp", "/rfq", "/cip", "/capital", "/public_works", "/public-works", "/budget", "/finance", "primegov.com")
IGNORED = (
    "/parks", "/recreation", "/library/", "/jobs", "/careers", "/employment", "/hr/", "/news/", "/events/", "/calendar.php", "/visitors", "/tourism", "/police", "/fire-rescue", "/ems",
    ".jpg", ".jpeg", ".png", ".gif", ".css", ".js", ".ico", ".woff")
