"""Pairs, the greedy fold and merged projects against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siftwork.functions import similarity
from siftwork.operators import blocks, cluster, merge
from siftwork.operators.graph import components

WORDS = ["pump", "canal", "pipe", "road", "tank", "weir", "lift", "north"]


def signals(n: int, seed: int):
    r = random.Random(seed)
    rows = []
    for seq in range(n):
        rows.append((seq, " ".join(r.sample(WORDS, r.randint(0, 4))), " ".join(r.sample(WORDS, 2)), r.choice(["", "", "RFP 2025-100", "RFP 2025-200"]),
                     r.choice(["", "$1,000", "$1,100", "$9,000", "$0"]), r.choice(["", "A", "B"]), r.choice(["water", "sewer"])))
    return rows


SCHEMA = "seq bigint, signal_title string, trigger_event string, evidence_snippet string, estimated_value string, geography string, sector string"


@pytest.mark.parametrize("threshold", [0.45, 0.6, 0.3])
def test_blocked_pairs_equal_all_pairs(spark, threshold):
    keyed = similarity.keyed(spark.createDataFrame(signals(60, 3), SCHEMA)).cache()
    both = keyed.alias("a").join(keyed.alias("b"), F.col("a.seq") < F.col("b.seq")).select(F.col("a.seq").alias("a"), F.col("b.seq").alias("b"), similarity.composite().alias("score"))
    want = {tuple(r) for r in both.where(F.col("score") >= threshold).collect()}
    got = {(r["a"], r["b"], r["score"]) for r in cluster.pairs(keyed, threshold).collect()}
    assert got == want and want


@pytest.mark.parametrize(("block", "dense"), [(7, 2), (25, 256)])
def test_pairs_of_common_words_are_compared_in_blocks(spark, monkeypatch, block, dense):
    monkeypatch.setattr(cluster, "PER_SIGNAL", 1)
    monkeypatch.setattr(blocks, "BLOCK", block)
    monkeypatch.setattr(blocks, "DENSE", dense)
    monkeypatch.setattr(blocks, "CELLS", 64)
    rows = [*signals(45, 8), (100, None, None, None, None, None, None), (101, "pump", "pump", "", "NaN", "A", ""), (102, "pump", "pump", "", "$5", "a", ""), (102, "pump", "canal", "", "$7", "a", "")]
    keyed = similarity.keyed(spark.createDataFrame(rows, SCHEMA)).cache()
    both = keyed.alias("a").join(keyed.alias("b"), F.col("a.seq") < F.col("b.seq")).select(F.col("a.seq").alias("a"), F.col("b.seq").alias("b"), similarity.composite().alias("score"), F.arrays_overlap("a.ids", "b.ids").alias("id_hit"))
    want = sorted(tuple(r) for r in both.where("score >= 0.45").collect())
    found = cluster.pairs(keyed)
    assert sorted(tuple(r) for r in found.collect()) == want and want
    # no pair is shuffled: the last exchange deals out signals
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def greedy(n: int, score: dict, ids: dict, threshold: float) -> dict[int, int]:
    """Signal by signal over projects in the order of their creation, as the definition says."""
    projects: list[dict] = []
    out = {}
    for i in range(n):
        best, top = None, 0.0
        for k, p in enumerate(projects):
            if ids[i] & p["ids"]:
                best, top = k, 1.0
                break
            s = max(score[m, i] for m in p["members"])
            if s > top:
                best, top = k, s
        if best is None or top < threshold:
            projects.append({"members": [], "ids": set()})
            best = len(projects) - 1
        projects[best]["members"].append(i)
        projects[best]["ids"] |= ids[i]
        out[i] = best + 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_projects_equal_greedy_fold(spark, seed):
    n = 50
    frame = spark.createDataFrame(signals(n, seed), SCHEMA)
    keyed = similarity.keyed(frame).cache()
    both = keyed.alias("a").join(keyed.alias("b"), F.col("a.seq") < F.col("b.seq")).select(F.col("a.seq").alias("a"), F.col("b.seq").alias("b"), similarity.composite().alias("score"))
    score = {(r["a"], r["b"]): r["score"] for r in both.collect()}
    ids = {r["seq"]: set(r["ids"]) for r in keyed.collect()}
    got = {r["seq"]: r["project_no"] for r in cluster.assign(frame).collect()}
    assert got == greedy(n, score, ids, 0.45)


@pytest.mark.parametrize("per_signal", [1, 1000])
def test_fold_needs_few_pairs(spark, monkeypatch, per_signal):
    monkeypatch.setattr(cluster, "PER_SIGNAL", per_signal)
    monkeypatch.setattr(blocks, "BLOCK", 16)
    n = 60
    frame = spark.createDataFrame(signals(n, 9), SCHEMA)
    keyed = similarity.keyed(frame).cache()
    every = [tuple(r) for r in keyed.alias("a").join(keyed.alias("b"), F.col("a.seq") < F.col("b.seq")).select("a.seq", "b.seq", similarity.composite(), F.arrays_overlap("a.ids", "b.ids")).collect()]
    linked = [e for e in every if e[2] >= 0.45]
    needed = [tuple(r) for r in cluster.edges(keyed).collect()]
    assert set(needed) <= set(linked) and len(needed) < len(linked) / 2
    assert cluster.fold(needed, list(range(n))) == cluster.fold(linked, list(range(n)))


def test_no_merging_over_one(spark):
    got = cluster.assign(spark.createDataFrame(signals(20, 5), SCHEMA), 1.1).orderBy("seq").collect()
    assert [r["project_no"] for r in got] == list(range(1, 21)) and got[0]["project_id"] == "P-0001"


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(200, 200 + k) for k in range(1, 40)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_merged_project(spark):
    columns = "seq bigint, project_no bigint, signal_title string, agency string, geography string, sector string, estimated_value string, expected_timeline string, meeting_date string, signal_type string, procurement_stage string, lifecycle_stage string, signal_strength string, strategic_fit string, friction_level string, momentum string, trigger_event string, strategic_notes string, source_link string, evidence_snippet string, confidence_score double, relevance_score double, extraction_method string, chunk_index int"
    rows = [(1, 1, "Short", "A1", "Town", "water", "$5,000", "", "2025-01-02", "", "Committee Referral", "", "Low", "Monitor", "Low", "Unclear", "abc", "", "l1", "e", 0.2, 0.2, "rule", 0),
            (2, 1, "A longer title here", "A2", "Town (Zone 1)", "sewer", "$1 million", "", "2025-03-02", "", "Active Contract", "", "High", "Monitor", "Low", "Unclear", "abcd", "", "l2", "it was deferred", 0.1, 0.4, "rule", 3),
            (3, 2, "Alone", "A3", "", "", "", "", "", "", "", "", "", "", "Low", "Unclear", "", "note", "l3", "", 0.0, 0.0, "rule", 0)]
    got = {r["project_no"]: r for r in merge.merged(spark.createDataFrame(rows, columns)).collect()}
    one, two = got[1], got[2]
    assert (one["signal_title"], one["agency"], one["geography"], one["estimated_value"], one["meeting_date"], one["procurement_stage"], one["signal_strength"]) == ("A longer title here", "A2", "Town (Zone 1)", "$1 million", "2025-03-02", "Active Contract", "High")
    assert (one["momentum"], one["friction_level"], one["trigger_event"], one["confidence_score"], one["relevance_score"], one["extraction_method"], one["chunk_index"]) == ("Stalled", "High", "abcd", 0.2, 0.4, "merged", 0)
    assert one["strategic_notes"] == "Project appears in 2 sources. Progressed through: Committee Referral → Active Contract. Momentum: Stalled."
    assert (two["strategic_notes"], two["momentum"], two["extraction_method"]) == ("note", "Unclear", "rule")


def test_momentum_by_last_new_stage(spark):
    frame = spark.createDataFrame([([3, 2, 3], False), ([2, 3], False), ([4], False), ([4, 4], False), ([4, 1], True), ([], False)], "ranks array<int>, stalled boolean")
    got = [r[0] for r in frame.select(merge.momentum_of(F.col("stalled"), F.col("ranks"))).collect()]
    assert got == ["Accelerating", "Stable", "Unclear", "Stable", "Stalled", "Unclear"]
