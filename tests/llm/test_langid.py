from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

from siftwork.llm import common, langid

SMALL = "/root/testdata/sf0.01"


def brute_bits(texts: list[bytes], data: bytes, order: int) -> float:
    """Code length of data under PPM with method D escapes and frozen counts, byte by byte."""
    counts: list[dict] = [{} for _ in range(order + 1)]
    for t in texts:
        s = b"\n" * order + t
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen = counts[k].setdefault(s[i - k : i], {})
                seen[s[i]] = seen.get(s[i], 0) + 1
    bits, s = 0.0, b"\n" * order + data
    for i in range(order, len(s)):
        for k in range(order, -1, -1):
            seen = counts[k].get(s[i - k : i])
            if seen is None:
                continue
            total = sum(seen.values())
            if s[i] in seen:
                bits -= math.log2((2 * seen[s[i]] - 1) / (2 * total))
                break
            bits -= math.log2(len(seen) / (2 * total))
        else:
            bits += 8
    return bits


def test_exact_code_lengths():
    samples = {"a": [b"the cat sat on the mat", b"a hat"], "b": ["été à la plage".encode(), b"le chat"]}
    model = langid.Model(samples)
    texts = [b"the chat", "à la".encode(), b"zzz", b"", b"the cat sat on the mat" * 3]
    got = model.code_lengths(texts)
    for j, lang in enumerate(sorted(samples)):
        assert got[:, j] == pytest.approx([brute_bits(samples[lang], t, langid.ORDER) for t in texts], rel=1e-12)


def test_samples_are_whole_texts(spark):
    rows = [(k, "a", f"{k} " + "x" * 50) for k in range(30)] + [(50, "a", "y" * 900), (60, "b", "z" * 900), (61, "b", "z" * 2000)]
    got = langid.sample(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"), 200)
    whole = {text.encode() for _, _, text in rows}
    assert all(t in whole for own in got.values() for t in own)
    assert 200 <= sum(map(len, got["a"])) < 200 + 60 and len(got["b"]) == 1


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.query(spark, SMALL).collect()}
    rows = docs.where("text is not null and lang is not null and length(text) > 40").collect()
    hits = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean(hits) > 0.97 and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())


def test_awkward(spark, awkward, nothing):
    samples = langid.sample(awkward.where(~common.held_out()))
    got = {r["doc_id"]: r for r in langid.identify(awkward, samples).collect()}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == got[6]["lang_pred"] == got[10]["lang_pred"] == "und" and got[2]["score"] == 0 and got[4]["lang_pred"] != "und"
    assert langid.identify(awkward, {}).where("lang_pred <> 'und'").count() == 0 and langid.sample(nothing) == {} and langid.identify(nothing, samples).count() == 0
