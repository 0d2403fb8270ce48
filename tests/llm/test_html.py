from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict

from siftwork.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>t &amp</title><style>p{}</style><script>var a="</p>";</script></head><body class="single ad-free"><header>Site</header>
<nav><ul><li><a href="/">Home<li>b</ul></nav><div class="ad">Buy</div><article><h1>T &amp;  T</h1><p><b>One&nbsp;two<br><p>four<i>five</i> <span class="share">tweet</span>six
<table><tr><td>a<td>b<tr><td>c</table><aside>see also</aside><div class="comments"><p>nice</p></div><ul><li>x<li>y</ul></article>
<section id=comments><article class=comment>bad</article></section><div class="cookie-notice">ok?</div><footer>&copy;</footer><form>search</form></body></html>"""


def test_page():
    assert H.main_text(PAGE) == "T & T One two fourfive six a b c x y"


def test_fragments():
    assert H.main_text("<p>a < b <b>c</b>d<p>e <a href='x") == "a < b cd e"
    assert H.main_text(None) == H.main_text("") == H.main_text("<script>x") == H.main_text("<!-- x") == ""
    assert H.main_text("plain &lt;x&gt; &am") == "plain <x> &am"
    assert H.main_text("<article></article><p>outside</p>") == ""
    assert H.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_site_style_tree(spark):
    # unnamed blocks: only repetition tells the template from the text; one host repeats a single article everywhere
    rows = [(k, f"http://a.example/{k}", f"<div class=x1>Welcome to our site</div><div class=x2><p>Own text {k} of this page</p><p>more {k}</p></div><div class=x3>All rights</div>") for k in range(8)]
    rows += [(20 + k, f"http://b.example/{k}", "<div class=x1>t</div><article><p>The same article</p></article>") for k in range(6)]
    rows += [(30, None, None), (31, "http://c.example/", "<div>first</div><div>second</div>"), (None, "http://c.example/", "<p>no id</p>"), (33, "x", "")]
    frame = spark.createDataFrame([(*x, "extra", 1) for x in rows], "page_id bigint, url string, html string, text string, host int")
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in H.extract(frame).collect()}
    assert all(got[k, f"http://a.example/{k}"][0] == f"Own text {k} of this page more {k}" for k in range(8))
    assert all(got[20 + k, f"http://b.example/{k}"][0] == "The same article" for k in range(6))
    assert got[30, None] == ("", 0) and got[31, "http://c.example/"] == ("first second", 12) and got[None, "http://c.example/"][0] == "no id" and got[33, "x"] == ("", 0)
    assert len(got) == len(rows) and H.extract(frame.limit(0)).count() == 0


def test_given_pages_keep_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    raw = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in H.extract(pages).collect():
        inner = re.search(r"<article>(.*)</article>", raw[r["page_id"]], re.S)[1]
        assert r["text"] == " ".join(entities.unescape(re.sub("<[^>]*>", "", re.sub("</?(p|h1|br)>", " \n ", inner))).split()) and r["n_chars"] == len(r["text"])


def test_nesting_of_any_depth_changes_nothing():
    for depth in (10, 199, 20_000):
        page = "<div>" * depth + "start <nav>MENU</nav><div class=ad>AD</div> x" + "</div>" * depth + "tail"
        assert H.main_text(page) == "start x tail"
    assert H.main_text("<div>" * 50_000 + "</p>" * 10 + "</span>" * 50_000 + "<b>" * 50_000 + "y") == "y"


def test_class_names_inside_an_article():
    kept = ("related-work", "social-science", "share-price", "menuOfTheDay", "notice-period")
    gone = ("share-buttons", "socialLinks", "related-posts", "ad ad-slot-3", "comments", "reader-comments", "cookie-banner", "x sidebar")
    assert H.main_text("<article>" + "".join(f"<div class='{c}'>{c}</div>" for c in kept + gone) + "</article>") == " ".join(kept)
    assert H.main_text("<article>a <math><mi>x</mi><mo>=</mo></math> b<object>o</object><noscript>n</noscript></article>") == "a x= b"


def brute_low(pages: list[str]) -> tuple[set[int], set[int]]:
    """Low paths of one host's pages by the definition, page by page."""
    texts, shapes = defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set))
    for n, page in enumerate(pages):
        todo = [H.parse(page)]
        while todo:
            node = todo.pop()
            inner = [c for c in node.children if not isinstance(c, str)]
            todo += inner
            for c in node.children:
                if isinstance(c, str):
                    texts[node.path][c].add(n)
            runs = [t.tag for i, t in enumerate(inner) if not i or inner[i - 1].tag != t.tag]
            shapes[node.path][tuple(runs)].add(n)
    content, presentation = set(), set()
    for path, seen in texts.items():
        m = len(set().union(*seen.values()))
        if m >= H.MIN_PAGES and 1 - sum(math.log(len(x)) for x in seen.values()) / len(seen) / math.log(m) < H.CONTENT:
            content.add(path)
    for path, seen in shapes.items():
        m = len(set().union(*seen.values()))
        share = [len(x) / sum(map(len, seen.values())) for x in seen.values()]
        if m >= H.MIN_PAGES and -sum(x * math.log(x) for x in share) / math.log(m) < H.PRESENTATION:
            presentation.add(path)
    return content, presentation


def test_importance_against_brute_force(spark):
    def page(host: int, k: int) -> str:
        extra = "".join(f"<p>item {j} of {k}</p><b>x</b>" for j in range(k % (host + 1)))
        return (f"<div class=top>Portal {host}</div><div class=x>{extra}<p>body {host} {k // 2}</p></div>"
                f"<div class=y><p>Seen on {k % 3}</p><div class=z>same {k % (host + 1)}</div></div>")

    rows = [(100 * h + k, f"https://h{h}.example/{k}", page(h, k)) for h in range(5) for k in range(3 + 3 * h)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    by_host = defaultdict(list)
    for _, url, text in rows:
        by_host[url.split("/")[2]].append(text)
    low = {h: brute_low(p) for h, p in by_host.items()}
    assert low["h0.example"] == (set(), set()) and all(all(x) for h, x in low.items() if h != "h0.example")
    want = {i: H.main_text(text, *low[url.split("/")[2]]) for i, url, text in rows}
    assert {r["page_id"]: r["text"] for r in H.extract(frame).collect()} == want
    assert len(Counter(want.values())) > 5 and "Portal" not in want[401] and "Portal" in want[1]
    model = H.low_branches(frame).collect()
    assert Counter((r["path"], r["content"]) for r in model) == Counter((p, c) for x in low.values() for c, own in ((True, x[0]), (False, x[1])) for p in own)


def test_large_models_give_the_same(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    small = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    monkeypatch.setattr(H, "SMALL_MODEL", 0)
    assert {r["page_id"]: r["text"] for r in H.extract(pages).collect()} == small
