"""Similar signals and greedy projects.

Pairs. Of the composite, .40 J(title) + .20 J(evidence) + at most .40 for amount, place and sector, a pair over the threshold
needs J(title) or J(evidence) over a bound, or a shared identifier. The bound is high for pairs whose amounts differ, and
low for pairs whose amounts are within a factor of two; the latter also share an amount bucket. Candidates are therefore hash joins on
identifiers, on the rarest words of each signal (prefix filter), and on rare words with an amount bucket, instead of a
cross product; nothing over the threshold is lost. Where words are so common that the joins would make over PER_SIGNAL candidates
for each signal, and for thresholds up to similarity.UNRELATED, all pairs are compared in blocks instead, which shuffles no pair.

Projects. A signal joins the project of an earlier signal that shares an identifier (the earliest such project), else the
project of its most similar earlier signal (the earliest on ties), else it opens one. So the fold needs few pairs: of the signals
of an identifier, each with the one before (its project is the earliest of all those before it), and of a signal that shares none
with an earlier one, those of its highest score. Each connected component of these pairs is folded by itself, in parallel; project numbers
follow the arrival of the signals that opened them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import similarity
from ..storage import drop_table, materialize
from . import blocks
from .graph import components

THRESHOLD = 0.45


#: Candidates for each signal over which all pairs are compared in blocks.
PER_SIGNAL = 64


def pairs(keyed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, score, id_hit) of signals a < b (by seq) whose composite similarity reaches the threshold; keyed is written."""
    met = _candidates(keyed, threshold)
    return blocks.pairs(keyed, threshold) if met is None else _scored(met, keyed, threshold)


def _candidates(keyed: DataFrame, threshold: float) -> DataFrame | None:
    """Pairs (sa, sb) that share a key; none if these are too many to be shuffled."""
    if threshold <= similarity.UNRELATED:
        return None
    narrow = materialize(candidate_keys(keyed, threshold), "candidate-keys", True)
    met = narrow.groupBy("key").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
    if (met or 0) > PER_SIGNAL * keyed.count():
        drop_table(narrow)
        return None
    both = narrow.alias("x").join(narrow.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.seq") < F.col("y.seq")))
    return both.select(F.col("x.seq").alias("sa"), F.col("y.seq").alias("sb")).distinct()


def _scored(met: DataFrame, keyed: DataFrame, threshold: float) -> DataFrame:
    both = met.join(keyed.alias("a"), F.col("sa") == F.col("a.seq")).join(keyed.alias("b"), F.col("sb") == F.col("b.seq"))
    scored = both.select(F.col("a.seq").alias("a"), F.col("b.seq").alias("b"), similarity.composite().alias("score"), F.arrays_overlap("a.ids", "b.ids").alias("id_hit"))
    return scored.where(F.col("score") >= threshold)


def edges(keyed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b, score, id_hit) that the fold needs, written; keyed is written."""
    with_id = keyed.select("seq", F.explode("ids").alias("id")).distinct()
    before = F.lag("seq").over(Window.partitionBy("id").orderBy("seq"))
    chained = with_id.select(before.alias("a"), F.col("seq").alias("b")).where("a is not null").distinct()
    chained = materialize(chained.select("a", "b", F.lit(1.0).alias("score"), F.lit(True).alias("id_hit")), "id-pairs")
    later = keyed.join(chained.select(F.col("b").alias("seq")).distinct(), "seq", "left_anti")
    met = _candidates(keyed, threshold)
    if met is None:
        found = blocks.pairs(keyed, threshold, later)
    else:
        found = _scored(met.join(later.select(F.col("seq").alias("sb")).distinct(), "sb", "left_semi"), keyed, threshold)
    found = materialize(found, "signal-pairs", True)
    top = found.groupBy("b").agg(F.max("score").alias("top"))
    highest = found.join(top, "b").where("score = top").select("a", "b", "score", "id_hit")
    return materialize(chained.unionByName(highest), "fold-pairs", True)


def candidate_keys(keyed: DataFrame, threshold: float) -> DataFrame:
    """(seq, key): pairs that can reach the threshold share a key."""
    title, evidence, amount, place, sector = similarity.WEIGHTS
    slack = threshold - 0.0006 - place - sector  # a score is rounded to three places

    words = keyed.select("seq", "value", F.explode(F.concat(F.transform("title", lambda x: F.struct(F.lit("t").alias("side"), x.alias("word"), F.size("title").alias("size"))),
                                                            F.transform("evidence", lambda x: F.struct(F.lit("e").alias("side"), x.alias("word"), F.size("evidence").alias("size"))))).alias("w"))
    words = words.select("seq", "value", "w.side", "w.size", F.xxhash64("w.side", "w.word").alias("word"))
    seen = words.groupBy("word").agg(F.count("*").alias("seen"))
    placed = words.join(seen, "word").withColumn("rank", F.row_number().over(Window.partitionBy("seq", "side").orderBy("seen", "word")))
    weight = F.when(F.col("side") == "t", title).otherwise(evidence)

    def prefix(over: float):
        """A word is among the rarest that a partner must share one of, if this much has to come from title and evidence."""
        return F.col("rank") <= F.col("size") - F.ceil(over / (2 * weight) * F.col("size") - 1e-9) + 1

    apart = placed.where(prefix(slack)).select("seq", "word")
    power = F.when(F.col("value") > 0, F.floor(F.log2("value"))).when(F.col("value") == 0, -9999)
    near = placed.where(F.col("value") >= 0).where(prefix(slack - amount)).select("seq", "word", F.explode(F.array(power, power + 1)).alias("power"))
    ids = keyed.select("seq", F.explode("ids").alias("id"))
    return apart.select("seq", F.xxhash64("word").alias("key")).unionByName(near.select("seq", F.xxhash64("word", "power").alias("key"))).unionByName(ids.select("seq", F.xxhash64(F.lit("i"), "id").alias("key")))


def fold(edges: list[tuple[int, int, float, bool]], members: list[int]) -> dict[int, int]:
    """The greedy fold of one component: the founder of each member's project. Edges are (earlier, later, score, id_hit)."""
    before: dict[int, list[tuple[int, float, bool]]] = {}
    for a, b, score, id_hit in edges:
        before.setdefault(b, []).append((a, score, id_hit))
    founder: dict[int, int] = {}
    for s in sorted(members):
        met = before.get(s, ())
        by_id = [founder[a] for a, _, id_hit in met if id_hit]
        # projects are as old as their founders
        founder[s] = min(by_id) if by_id else min((-score, founder[a]) for a, score, _ in met)[1] if met else s
    return founder


def assign(signals: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The signals with founder (seq of the signal that opened their project), project_no (from 1) and project_id."""
    if threshold > 1:
        founded = signals.withColumn("founder", F.col("seq"))
    else:
        keyed = materialize(similarity.keyed(signals), "keyed-signals")
        needed = edges(keyed, threshold)
        named = components(needed, "a", "b")
        grouped = needed.join(named, F.col("a") == F.col("node")).select("component", "a", "b", "score", "id_hit")

        def run(group: pd.DataFrame) -> pd.DataFrame:
            rows = list(group[["a", "b", "score", "id_hit"]].itertuples(index=False, name=None))
            found = fold(rows, list({x for r in rows for x in r[:2]}))
            return pd.DataFrame({"seq": list(found), "founder": list(found.values())}, dtype="int64")

        folded = grouped.groupBy("component").applyInPandas(run, "seq bigint, founder bigint")
        founded = signals.join(folded, "seq", "left").withColumn("founder", F.coalesce("founder", "seq"))
    founded = materialize(founded, "founded-signals")
    return numbered(founded)


def numbered(founded: DataFrame) -> DataFrame:
    """project_no by the founders' order: counts of range partitions first, then ranks inside each, so no task ranks all."""
    founders = founded.select("founder").distinct()
    parts = materialize(founders.repartitionByRange("founder").select("founder", F.spark_partition_id().alias("part")), "founders")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition
    offsets = parts.groupBy("part").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "offset")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("founder"))
    numbers = parts.withColumn("rank", rank).join(F.broadcast(offsets), "part").select("founder", (F.col("rank") + F.col("offset")).cast("bigint").alias("project_no"))
    return founded.join(numbers, "founder").withColumn("project_id", F.format_string("P-%04d", "project_no"))
