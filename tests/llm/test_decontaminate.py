from __future__ import annotations

import hashlib
import random
import re

import numpy as np

from siftwork.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs: dict, items: dict) -> dict:
    windows: dict[tuple, set] = {}
    for item, text in items.items():
        w = words(text)
        for at in range(max(1, len(w) - 7) if w else 0):
            windows.setdefault(tuple(w[at : at + 8]), set()).add(item)
    sizes = {len(x) for x in windows}
    out = {}
    for doc, text in docs.items():
        w = words(text)
        hit, met = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    met |= own
                    hit |= set(range(i, i + n))
        out[doc] = (len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(map(str, met))).encode()).hexdigest(), len(met) >= 2)
    return out


def cases(seed: int):
    r = random.Random(seed)
    some = lambda n: " ".join(r.choice("abcdefg") * r.randrange(1, 3) for _ in range(n))
    items = {k: some(r.choice([0, 1, 3, 8, 9, 20])) for k in range(12)} | {50: "One, TWO three", 51: "É漢 x", 52: None}
    docs = {k: some(r.randrange(0, 80)) for k in range(40)}
    docs |= {100 + k: f"{some(5)} {(items[k] or '').upper()}. {some(3)}" for k in items} | {200: "one two three one two three", 201: "é漢 x É漢 X", 202: None, 203: "", 204: "... \x00"}
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), spark.createDataFrame([*items.items(), (None, "a b c d"), (3, items[3])], "item_id bigint, text string"))


def test_against_brute_force(spark):
    docs, items = cases(1)
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in D.report(*frames(spark, docs, items)).collect()}
    assert got == brute(docs, items)


def test_blocks_of_a_large_benchmark(spark):
    docs, items = cases(2)
    docs_frame, items_frame = frames(spark, docs, items)
    whole = {r["doc_id"]: (r["n_hit"], sorted(r["items"]), r["spans"]) for r in D.find(docs_frame, items_frame).collect()}
    cut = {r["doc_id"]: (r["n_hit"], sorted(r["items"])) for r in D.find(docs_frame, items_frame, block_words=10).collect()}
    assert cut == {k: v[:2] for k, v in whole.items()}
    for k, (_, _, spans) in whole.items():
        for a, b in spans:
            assert WORD.fullmatch(docs[k][a].lower()) and WORD.fullmatch(docs[k][b - 1].lower())


def test_index_counts_and_locates():
    r = np.random.default_rng(1)
    symbols = r.integers(1, 4, 300)
    symbols[[50, 120, 299]] = 0
    index = D.FMIndex(symbols)
    for _ in range(60):
        phrase = r.integers(1, 4, r.integers(1, 6))
        low, high = index.search(phrase[None, :])
        places = [i for i in range(300 - len(phrase) + 1) if (symbols[i : i + len(phrase)] == phrase).all()]
        assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == places


def test_removal(spark, awkward, nothing):
    item = "the quick brown fox jumps over the lazy dog again"
    rows = [(1, f"Start. The Quick, brown fox jumps over the lazy dog again! End.", 5, "x"), (2, "nothing here", 12, "x"), (3, None, None, None), (None, "so the quick brown fox jumps over the lazy dog", 4, "y"), (2, "the quick brown fox jumps over the lazy dog", 4, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars int, spans string")
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    every = D.remove(docs, bench).collect()
    assert len(every) == 5 and {r["spans"]: r["text"] for r in every}["y"] == "so  " and {r["spans"]: r["text"] for r in every}["z"] == " "
    got = {r["doc_id"]: r for r in every if r["spans"] not in ("y", "z")}
    assert got[1]["text"] == "Start.  ! End." and got[1]["n_chars"] == len(got[1]["text"]) and got[2]["text"] == "nothing here" and got[3]["text"] is None and got[1]["spans"] == "x"
    same = D.remove(awkward, bench)
    assert same.columns == awkward.columns and sorted(map(repr, same.collect())) == sorted(map(repr, awkward.collect()))
    assert D.remove(nothing, bench).count() == 0 and D.remove(awkward, bench.limit(0)).count() == 11 and D.report(awkward, bench).count() == 11
