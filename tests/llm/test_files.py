from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from siftwork.llm import packing, warc

from .conftest import prose


def test_archive_round_trip(spark):
    r = random.Random(8)
    shared = "é" + "x" * 1200
    rows = [(k, f"http://Host{k % 3}.Example.org/p{k}?q", prose(r, r.randrange(400))) for k in range(60)]
    rows += [(100 + k, "http://same.example/", shared) for k in range(40)] + [(200, "http://a\tb\\c\nd/", "small"), (201, None, "small"), (202, "x", None), (203, "y", ""), (None, "z", "no id"), (204, "w", "a" * 999), (205, "w", "a" * 999), (60 - 1, "http://again/", "x")]
    frame = spark.createDataFrame([(*x, "k") for x in rows], "page_id bigint, url string, html string, key string")
    got = warc.archive(frame).collect()
    assert len(got) == len(rows)
    want = []
    last: dict = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= warc.MIN_REVISIT and page is not None:
            last[data] = max(last.get(data, page), page)
    for page, url, html in rows:
        data = (html or "").encode()
        first = last.get(data, page)
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "response" if first == page else "revisit", None if first == page else first))
    assert sorted(map(repr, want)) == sorted(repr((x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"])) for x in got)
    assert warc.archive(frame.limit(0)).count() == 0


def test_lookup_of_one_key(spark):
    from siftwork.llm import common

    frame = spark.createDataFrame([(k, f"http://b.a.org/{k // 2}", f"page {k}") for k in range(30)], "page_id bigint, url string, html string")
    base = common.work_path(spark, "warc")
    captures = warc.write_archive(warc.decided(frame), f"{base}/records")
    ranges = [(bytes(r["first"]), r["file"]) for r in warc.write_index(captures, f"{base}/index").collect()]
    index = warc.CaptureIndex(f"{base}/index", f"{base}/records", ranges)
    assert sorted(x["payload"] for x in index.lookup("org,a,b)/7")) == [b"page 14", b"page 15"]
    assert index.lookup("org,a,b)/99") == [] and index.lookup("") == [] and index.lookup("zzz") == []
    index.close()


def test_packing_round_trip(spark, awkward):
    r = random.Random(9)
    texts = [prose(r, r.randrange(0, 900)) for _ in range(120)] + [prose(r, 9000), "<|endoftext|> x", "a<|endoftext|><|endoftext|>\n b <|endoftext", None, "", "漢字 \u3000 é\U0001f600  don't  \n\n 12 345'll"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got: dict = {}
    for x in packing.pack(frame, part_rows=7).collect():
        got.setdefault(x["doc_id"], []).append(x)
    places: dict = {}
    for k, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for x in sorted(got[k], key=lambda x: x["piece"]):
            assert x["start"] == at and x["ids_crc32"] == zlib.crc32(np.array(ids[at : at + x["length"]], "<u4").tobytes())
            assert x["length"] == 2048 or x["piece"] == 0
            at += x["length"]
            places.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
        assert at == len(ids)
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    histogram: dict = {}
    for own in places.values():
        for _, length in own:
            histogram[length] = histogram.get(length, 0) + 1
    assert len(places) <= packing.best_fit(histogram, 2048).sequences
    assert packing.pack(awkward).select("doc_id").distinct().count() == 10 and packing.pack(frame.limit(0)).count() == 0


def test_plan_against_optimum():
    # 3 of 700, 3 of 600, 3 of 700: only mixed configurations fill 2000 exactly
    plan = packing.solve({700: 6, 600: 3}, 2000)
    assert plan.sequences == plan.bound == 3
    for seed in range(5):
        r = random.Random(seed)
        histogram: dict = {}
        for _ in range(300):
            k = r.randrange(200, 1500)
            histogram[k] = histogram.get(k, 0) + 1
        plan = packing.solve(histogram)
        held: dict = {}
        for items, n in plan.configurations:
            assert sum(k * a for k, a in items) <= packing.CAPACITY
            for k, a in items:
                held[k] = held.get(k, 0) + a * n
        assert held == histogram and plan.bound <= plan.sequences <= 1.02 * plan.bound + 1 and plan.sequences <= packing.best_fit(histogram, packing.CAPACITY).sequences
