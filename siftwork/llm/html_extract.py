"""Main-text extraction with a site style tree.

All pages of a host are merged into one tree of styles: a style node is the path of (tag, class and id words)
from the root. For every style node of a host the number m of pages that show it is counted, and

* its content importance, 1 - mean over its block texts of log(k) / log(m), k being the pages that have the text:
  0 for what every page repeats, 1 for what each page has alone;
* its presentation importance, the entropy to base m of the child tag sequences that pages show under it.

A branch of a page is removed if every text block in it has a content importance under CONTENT and the branch's
own presentation importance is under PRESENTATION. Hosts of fewer than MIN_PAGES pages give no evidence. Inside a
page's article (or main), low branches go only if some other text of it is important, so a host whose pages
are copies of one article keeps it.

Importance cannot judge what is noise on the first sight of a host, so elements whose tag, role or class says menu,
header, footer, sidebar, notice, advert, form or comment are removed by name, and if a page has an article (or
main) only its articles are text. Outside articles one such word in a class or id is enough. Inside an article a
whole class name has to say it ("share-buttons", but not "share-price"); of the rest, importance decides.

Counts are two pre-aggregated sums over narrow hashes; the pages themselves are not shuffled while the
model of low branches is at most SMALL_MODEL entries (then it is broadcast, once a task). A larger model meets salted
hosts in a join.

Null or empty html gives an empty text. A null url counts as a host of its own name. Repeated page_ids are
pages of their own. Comments, doctypes and text in scripts and styles are never text, nor what stands in for an
embedded object or for scripts (object, noscript). Unclosed elements end with their parents; stray end tags are
skipped; nesting may be of any depth.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

CONTENT = 0.2
PRESENTATION = 0.3
MIN_PAGES = 4
SMALL_MODEL = 1_000_000
SALTS = 16

# The elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg object audio video canvas xmp noframes".split())
BLOCK = frozenset(
    "html body head address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol p pre search section summary table caption tbody thead tfoot tr td th ul option select button".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
          "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody", "thead")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
# Tags, roles and class words that are never main text.
NOISE_TAGS = frozenset("head nav footer aside form menu dialog button select search fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "cookie cookies consent gdpr notice notices disclaimer newsletter subscribe subscription signup login comment comments commentlist respond reply replies discussion disqus "
    "share sharing social related recommended popup modal overlay toolbar pagination pager".split())
#: An article of one of these is no article of the page.
ARTICLE_NOISE = frozenset("comment comments reply replies ad advert advertisement sponsored promo".split())
# Words that say nothing by themselves beside a noise word of a class name.
FILLER_WORDS = frozenset(
    "area bar block bottom box btn button buttons col column container content count cta element entry field fixed footer form global group header icon icons inner item items left "
    "link links list main media message module page panel plugin post posts reader right row section site slot small sticky text thread title top unit user users widget wrap wrapper".split())
#: These name noise only outside an article.
OUTER_WORDS = frozenset("header footer masthead topbar copyright".split())
ROOTS = frozenset(("article", "main"))

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>|<[!?/][^>]*+>?|<[A-Za-z][^>]*+\Z""", re.S)
_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])[^>]*+>?", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_WORDS = re.compile(r"[A-Za-z]+")
_CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SEED = 0x5EED


class Node:
    """An element: its style path, the block it stands in (or is), and its children and block texts in page order."""

    __slots__ = ("block", "children", "noise", "parent", "path", "root", "tag")

    def __init__(self, tag: str, path: int, parent: Node | None, noise: bool, root: bool):
        self.tag, self.path, self.parent, self.noise, self.root = tag, path, parent, noise, root
        self.block: Node = self if parent is None or tag in BLOCK else parent.block
        self.children: list[Node | str] = []


def _hash(text: str, seed: int = _SEED) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed) >> 1


def parse(html: str) -> Node:
    """The element tree of a page; children are elements and finished block texts in page order."""
    top = current = Node("#page", 0, None, False, False)
    at, buffer = 0, []
    opened: dict[str, int] = {}

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            current.block.children.append(text)

    def leave(holder: Node) -> None:
        """Close elements up to and with the holder."""
        nonlocal current
        stop = holder.parent
        while current is not stop:
            opened[current.tag] -= 1
            current = current.parent

    end = len(html)
    while at < end:
        found = _TOKEN.search(html, at)
        stop = found.start() if found else end
        # an inline element is noise by itself, inside a block that is not
        if stop > at and (current.block.noise or not current.noise):
            buffer.append(entities.unescape(html[at:stop]))
        if found is None:
            break
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            if opened.get(tag):
                holder = current
                while holder.tag != tag:
                    holder = holder.parent
                if tag in BLOCK or any(n.tag in BLOCK for n in _between(current, holder)):
                    flush()
                leave(holder)
            elif tag == "p":
                flush()
            continue
        if tag in RAW:
            close = _RAW_END[tag].search(html, at)
            at = close.end() if close else end
            continue
        if tag == "br":
            buffer.append("\n")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in BLOCK:
            flush()
            if current.block.tag == "p":  # a block ends an open paragraph
                leave(current.block)
            if any(opened.get(t) for t in CLOSES.get(tag, ())):
                holder, last = current, None
                while holder is not top and holder.tag not in SCOPE[tag]:
                    if holder.tag in CLOSES[tag]:
                        last = holder
                    holder = holder.parent
                if last is not None:
                    leave(last)
        current = _element(tag, found[3], current)
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return top


def _between(low: Node, high: Node) -> Iterator[Node]:
    while low is not high:
        yield low
        low = low.parent


def _element(tag: str, attributes: str, parent: Node) -> Node:
    names: list[list[str]] = []
    role = ""
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            if m[1].lower() == "role":
                role = value.strip().lower()
            else:
                names += [[w.lower() for w in _WORDS.findall(_CASE.sub(" ", name))] for name in value.split()]
    words = {w for name in names for w in name}
    style = f"{tag} {' '.join(sorted(words))}"
    inside = parent.root or tag in ROOTS or role == "main"
    noise = parent.noise or tag in NOISE_TAGS or role in NOISE_ROLES
    if tag == "article":
        noise = noise or not words.isdisjoint(ARTICLE_NOISE)
    elif tag not in ("html", "body", "main"):
        noise = noise or (any(map(_says_noise, names)) if parent.root else not words.isdisjoint(NOISE_WORDS))
    if not inside:
        noise = noise or tag == "header" or (tag not in ("html", "body") and not words.isdisjoint(OUTER_WORDS))
    path = _hash(f"{parent.path} {style}") if tag in BLOCK else parent.path
    node = Node(tag, path, parent, noise, inside and not noise)
    parent.children.append(node)
    return node


def _says_noise(name: list[str]) -> bool:
    """A class name of noise words and fillers only."""
    return any(w in NOISE_WORDS for w in name) and all(w in NOISE_WORDS or w in FILLER_WORDS for w in name)


def features(top: Node) -> set[tuple[int, int, bool]]:
    """What a page adds to its host's style tree: (path, feature, of content), each once; feature 0 counts the page."""
    out: set[tuple[int, int, bool]] = set()
    stack = [top]
    while stack:
        node = stack.pop()
        tags = []
        for child in node.children:
            if isinstance(child, str):
                out.add((node.path, 0, True))
                out.add((node.path, _hash(child) | 1, True))
            else:
                stack.append(child)
                if not tags or tags[-1] != child.tag:
                    tags.append(child.tag)
        out.add((node.path, 0, False))
        out.add((node.path, _hash(" ".join(tags)) | 1, False))
    return out


def style_counts(pages: DataFrame) -> DataFrame:
    """Pages by (host, path, kind, feature), counted inside each task's slices."""
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
    names = ["host", "path", "content", "feature", "k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_slices(batch, 1):
                counts: dict[tuple[int, int, bool, int], int] = {}
                for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for path, feature, content in features(parse(html)):
                        key = (host, path, content, feature)
                        counts[key] = counts.get(key, 0) + 1
                rows = [(*key, k) for key, k in counts.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    counted = pages.where("html is not null and html <> ''").select(_host("url").alias("host"), "html").mapInArrow(run, "host bigint, path bigint, content boolean, feature bigint, k bigint")
    return counted.groupBy("host", "path", "content", "feature").agg(F.sum("k").alias("k"))


def low_branches(pages: DataFrame) -> DataFrame:
    """The style paths of low importance: host, path, content (else of presentation)."""
    k = F.col("k").cast("double")
    is_page = F.col("feature") == 0
    node = style_counts(pages).groupBy("host", "path", "content").agg(
        F.sum(F.when(is_page, F.col("k"))).alias("m"), F.sum(F.when(~is_page, F.log(k))).alias("logs"),
        F.count(F.when(~is_page, 1)).alias("n"), F.sum(F.when(~is_page, k)).alias("shown"),
        F.sum(F.when(~is_page, k * F.log(k))).alias("klogk"))
    node = node.where(F.col("m") >= MIN_PAGES).withColumn("base", F.log(F.col("m").cast("double")))
    content = 1 - F.col("logs") / F.col("n") / F.col("base")
    presentation = (F.log("shown") - F.col("klogk") / F.col("shown")) / F.col("base")
    low = F.when(F.col("content"), content < CONTENT).otherwise(presentation < PRESENTATION)
    return node.where(low).select("host", "path", "content")


def _low(top: Node, low: set[int], flat: set[int]) -> set[Node]:
    """Branches to remove: of low presentation, and all they hold is of low content, noise or such a branch."""
    order = [top]
    for node in order:
        order += [c for c in node.children if not isinstance(c, str)]
    found: set[Node] = set()
    for node in reversed(order):
        if node.path in flat and all(node.path in low if isinstance(c, str) else c.noise or c in found for c in node.children):
            found.add(node)
    return found


def _texts(start: Node, removed: set[Node], low: set[int]) -> list[str]:
    """The block texts under an element in page order, without noise, removed branches and texts of low content."""
    out: list[str] = []
    stack: list[Iterator] = [iter(start.children if not start.noise else ())]
    holders = [start]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            holders.pop()
        elif isinstance(child, str):
            if holders[-1].path not in low:
                out.append(child)
        elif not child.noise and child not in removed:
            stack.append(iter(child.children))
            holders.append(child)
    return out


def _roots(top: Node) -> list[Node]:
    """The outermost articles or mains that are not noise, in page order."""
    found, stack = [], [top]
    while stack:
        node = stack.pop()
        if node.noise:
            continue
        if node.tag in ROOTS or (node.root and not (node.parent and node.parent.root)):
            found.append(node)
        else:
            stack += [c for c in reversed(node.children) if not isinstance(c, str)]
    return found


def main_text(html: str | None, low_content: set[int] = frozenset(), low_presentation: set[int] = frozenset()) -> str:
    """The main text of a page under its host's low branches."""
    if not html:
        return ""
    top = parse(html)
    roots = _roots(top)
    removed = _low(top, low_content, low_presentation) if low_presentation else set()
    out: list[str] = []
    for root in roots or [top]:
        # an article of low importance is still the article; a page without one may be low as a whole
        kept = [] if not roots and root in removed else _texts(root, removed, low_content)
        out += kept or (_texts(root, set(), set()) if roots else [])
    if not roots and not out:
        out = _texts(top, set(), set())
    return " ".join(out)


def _sets(paths, content) -> tuple[set[int], set[int]]:
    """Low paths of a host: of content, of presentation."""
    each = list(zip(np.asarray(paths, np.int64).tolist(), content, strict=True))
    return {p for p, c in each if c}, {p for p, c in each if not c}


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text and n_chars."""
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    model = common.materialize(low_branches(pages), "style-trees")
    small = model.count() <= SMALL_MODEL
    sent = spark.sparkContext.broadcast(_by_host(model) if small else None)
    rows = pages.select("page_id", "url", "html", _host("url").alias("__host"))
    if not small:
        rows = _joined(rows, model)
    names = ["page_id", "url", "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: dict[int, tuple[set[int], set[int]]] = {}
        for batch in batches:
            for part in common.text_slices(batch, 2):
                if not small:
                    models.clear()
                texts = []
                for i, (html, host) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    if host not in models:
                        low = sent.value.get(host, ((), ())) if small else (part.column(4)[i].as_py() or (), part.column(5)[i].as_py() or ())
                        models[host] = _sets(*low)
                    texts.append(main_text(html, *models[host]))
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), sizes], names=names)

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


def _by_host(model: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A small model as (paths, content) by host."""
    found = model.toArrow()
    host, path, content = (found.column(c).to_numpy() for c in ("host", "path", "content"))
    order = np.argsort(host, kind="stable")
    keys, starts = np.unique(host[order], return_index=True)
    parts = zip(np.split(path[order], starts[1:]), np.split(content[order], starts[1:]), strict=True)
    return dict(zip(keys.tolist(), parts, strict=True)) if len(keys) else {}


def _joined(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Pages with their host's low paths and kinds as arrays; hosts are salted."""
    each = model.groupBy("host").agg(F.collect_list(F.struct("path", "content")).alias("low"))
    salted = each.select(F.col("host").alias("__host"), F.col("low.path").alias("__paths"), F.col("low.content").alias("__content"),
                         F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["__host", "__salt"], "left").select("page_id", "url", "html", "__host", "__paths", "__content")


def _host(url: str) -> Column:
    """Hash of a URL's lower-cased host."""
    rest = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    return F.xxhash64(F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0)))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
