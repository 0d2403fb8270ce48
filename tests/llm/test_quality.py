from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from siftwork.llm import linear, quality_classifier, quality_rules, toxicity

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_rules(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_rules_against_brute_force(spark, awkward, nothing):
    r = random.Random(2)
    texts = [prose(r, r.randrange(0, 60), 6) + ("\n" + prose(r, 9, 5)) * r.randrange(0, 4) for _ in range(60)] + ["a" * 5000, "x y " * 3000, "\xa0 é#é \x1c b", "".join(chr(r.randrange(33, 0x2000)) for _ in range(9000)), prose(r, 2000, 3000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").unionByName(awkward.select("doc_id", "text"))
    rows = quality_rules.score(frame).collect()
    by_id = {r["doc_id"]: r for r in rows}
    for r in frame.collect():
        got = by_id[r["doc_id"]] if r["doc_id"] is not None and r["doc_id"] > 10 else None
        if got:
            assert tuple(got[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute_rules(r["text"])
    assert not by_id[61]["kept"] and not by_id[63]["kept"] and by_id[64]["kept"]  # repetition, noise, prose
    assert len(rows) == frame.count() and quality_rules.score(awkward).count() == 11 and quality_rules.score(nothing).count() == 0
    compress = zstandard.ZstdCompressor(level=quality_rules.LEVEL).compress
    assert by_id[64]["ratio"] == pytest.approx(len(compress(texts[64].encode())) / len(texts[64].encode()))


def graded(seed: int, n: int):
    r = random.Random(seed)
    return [(k, prose(r, 30) + " " + " ".join([f"grade{k % 3}x{r.randrange(9)}"] * 3), k % 3) for k in range(n)]


def test_ordinal_regression(spark, awkward, nothing):
    rows = graded(3, 240)
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id bigint, text string")
    rated = spark.createDataFrame([(x[0], x[2]) for x in rows[:160]], "doc_id bigint, grade int")
    model = quality_classifier.learn(docs, rated)
    assert model.grades == [0, 1, 2] and (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in quality_classifier.grade(docs, model).collect()}
    assert np.mean([round(got[k]["expected_grade"]) == g for k, _, g in rows[160:]]) > 0.9
    assert all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got.values())
    assert quality_classifier.grade(awkward, model).count() == 11 and quality_classifier.grade(nothing, model).count() == 0
    empty = quality_classifier.learn(docs, rated.limit(0))
    assert quality_classifier.grade(docs, empty).count() == 240
    one = quality_classifier.learn(docs, rated.where("grade = 2"))
    assert {r["tail_probability"] for r in quality_classifier.grade(docs, one).collect()} == {1.0}


def test_gradient_of_the_ordinal_model():
    r = np.random.default_rng(1)
    starts = np.arange(0, 41, 2)
    matrix = linear.Sparse(starts, np.arange(6), r.integers(0, 6, 40), r.random(40))
    seen = []
    original = linear.minimise
    linear.minimise = lambda f, x, *a: (seen.append((f, x)), x)[1]
    try:
        quality_classifier.fit(matrix, r.integers(0, 4, 20), np.ones(20))
    finally:
        linear.minimise = original
    f, x = seen[0]
    x = x + r.normal(size=len(x)) * 0.3
    _, g = f(x)
    for k in range(len(x)):
        step = np.zeros(len(x))
        step[k] = 1e-6
        assert g[k] == pytest.approx((f(x + step)[0] - f(x - step)[0]) / 2e-6, rel=1e-3, abs=1e-6)


def test_vectors_hold_the_frequent_slots(spark):
    texts = ["one two two", "two three", "three two four", None, "", "four\xa0one"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    matrix, y = linear.vectors(linear.sampled(docs, [(k, 7 + k) for k in range(6)]), True, 2)
    made = linear.Featurizer()
    sets = {7 + k: made.present(t) for k, t in enumerate(texts) if t is not None}
    every = [s for x in sets.values() for s in x]
    frequent = sorted({s for s in every if every.count(s) >= 2})
    assert matrix.columns.tolist() == frequent
    for k, which in enumerate(y.tolist()):
        assert matrix.columns[matrix.row(k)].tolist() == sorted(sets[which] & set(frequent))
    shares, which = linear.vectors(linear.sampled(docs, [(k, k) for k in range(6)]), False, 1)
    for k, doc in enumerate(which.tolist()):
        assert dict(zip(shares.columns[shares.row(k)].tolist(), shares.values[shares.starts[k] : shares.starts[k + 1]].tolist(), strict=True)) == pytest.approx(made.counts(texts[doc]))


def test_long_runs_are_read_to_their_end():
    far = "漢字文" * 2000 + "悪口言" + "漢字文" * 2000
    assert linear.words(far) >= {"悪口言".encode()} and linear.words("x/" * 100 + "idiot" + "/x" * 100) == {b"x", b"idiot"}
    assert linear.words("You\xa0Idiot\u3000now") == {b"you", b"idiot", b"now"} and linear.words("a" * 64) == {b"a" * 64}
    weights = dict.fromkeys(linear.word_slots("悪口言".encode()), 1.0)
    assert linear.Scorer(weights).of_present(far) > 1 and linear.Scorer(weights).of_counts(far) > 0


@pytest.mark.parametrize("text", ["A" * 10**6, "*" * 10**6, "AAA 1 " * 200_000 + "a", "AAA" + "." * 10**6, "A*" * 500_000])
def test_patterns_take_linear_time(text):
    began = time.process_time()
    toxicity.Votes([]).of(text)
    assert time.process_time() - began < 5


def test_patterns():
    hits = lambda t: [p.search(t) is not None for p in toxicity.PATTERNS]
    assert hits(b"xABC, DEF! GHIJ") == [True, False] and hits(b"ABC DEF gHI") == [False, False] and hits(b"a***b *c") == [False, True] and hits(b"ABC def GHI JKL") == [False, False]


def toxic_rows(seed: int, n: int):
    r = random.Random(seed)
    out = []
    for k in range(n):
        bad = k % 5 == 0
        words = prose(r, 60).split()
        if bad:
            stem = "zorgo" if k % 2 else "idiot"
            for _ in range(3):
                words.insert(r.randrange(len(words)), stem + (r.choice("abcdefgh") * 2 if k % 2 else ""))
        out.append((k, " ".join(words), int(bad)))
    return out


def test_toxicity(spark, awkward, nothing):
    rows = toxic_rows(4, 500)
    docs = spark.createDataFrame([(*x[:2], "keep") for x in rows], "doc_id bigint, text string, votes string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows[:300]], "doc_id bigint, toxic int")
    model = toxicity.learn(docs, labels, F.col("doc_id") < 300)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[k] >= toxicity.THRESHOLD) == bool(y) for k, _, y in rows[300:])
    left = toxicity.without_toxic(docs, model)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {k for k, _, y in rows if not y}
    mixed = awkward.drop("score")
    assert toxicity.score(mixed, model).count() == 11 and toxicity.score(nothing.drop("score"), model).count() == 0
    flat = toxicity.learn(docs, labels.where("toxic = 0"), F.col("doc_id") < 300)
    assert toxicity.without_toxic(docs, flat).count() == 500


def test_label_model_finds_accuracies():
    r = np.random.default_rng(3)
    n, rates = 6000, [(0.8, 0.02), (0.6, 0.05), (0.5, 0.5)]
    y = r.random(n) < 0.2
    votes = np.stack([np.where(y, r.random(n) < a, r.random(n) < b) for a, b in rates], 1)
    masks = votes @ (1 << np.arange(3))
    patterns = dict(zip(*map(np.ndarray.tolist, np.unique(masks, return_counts=True)), strict=True))
    labelled: dict = {}
    for m, t in zip(masks[:600].tolist(), y[:600].astype(int).tolist(), strict=True):
        labelled[m, t] = labelled.get((m, t), 0) + 1
    model = toxicity.fit_labels(patterns, labelled, 3)
    for mask in range(8):
        rows = masks == mask
        if rows.sum() > 50:
            assert model.posterior[mask] == pytest.approx(y[rows].mean(), abs=0.12)
    assert model.accuracies[0] > model.accuracies[2]
