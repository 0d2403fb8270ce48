"""Toxicity by weak supervision.

Voters. Lexicon voters hold words and word beginnings: one fixed list of common insults, and LEXICONS lists induced from
labelled documents (greedily, the entry that covers most toxic documents not yet covered at a precision of PRECISION or
more; entries are dealt to the lists in turn). Pattern voters look for direct address, shouting and masked words. A voter
says hit or nothing.

Label model. The joint distribution of the votes and the hidden label is log-linear: a class balance, each voter's
propensity and accuracy, and a correlation for each of the CORRELATIONS voter pairs that depend most on each other given
the label. It is fitted to the counts of vote patterns of all documents (at most 2^voters numbers) by marginal likelihood,
and to the labels of labelled documents given their patterns; the partition function is summed exactly.

Classifier. Documents of a bounded sample get the label model's posterior as soft labels, and a linear (logistic)
classifier with an L1 penalty is trained on the presence of their hashed words and word beginnings. Only this
classifier scores texts.

Labels come from rows that the caller passes; the sample holds at most linear.SAMPLE_ROWS documents of each class. Null
text is an empty text, which has no evidence and the classifier's base score. Without any label of both classes the score
is the share of toxic labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, linear

LEXICONS = 5
#: Parameter of the model: entries of all induced lexicons together.
ENTRIES = 400
PRECISION = 0.9
COVER = 3
CORRELATIONS = 6
THRESHOLD = 0.3
PENALTY = 0.00003

# Common insults in four languages.
INSULTS = frozenset(w.encode() for w in (
    "idiot idiots moron morons stupid dumb loser losers pathetic scum trash garbage worthless disgusting clown imbecile jerk bastard "
    "dummkopf idioten arschloch abschaum schwachkopf widerlich estúpido estupido imbécil idiota basura asqueroso payaso crétin débile ordure minable").split())
#: Three words in capitals in a row; a letter after masking signs. Neither looks at a sign more than a few times.
PATTERNS = (re.compile(rb"(?<![A-Z])[A-Z]{3,}+[^A-Za-z]++[A-Z]{3,}+[^A-Za-z]++[A-Z]{3}"), re.compile(rb"[*@#$%]{2}[a-z]"))
#: Direct address.
ADDRESS = tuple(x.encode() for x in ("you are", "you're", "du bist", "ihr seid", "tú eres", "eres un", "tu es", "vous êtes"))


def voters() -> int:
    return 2 + LEXICONS + len(PATTERNS)


def induce(matrix: linear.Sparse, toxic: np.ndarray, ratio: float) -> list[int]:
    """Lexicon slots, best first; ratio is how many clean documents of the corpus a sampled one stands for, against a toxic one."""
    clean_rows = matrix.back((~toxic).astype(float)) * ratio
    toxic_rows = matrix.back(toxic.astype(float))
    fine = toxic_rows >= PRECISION * (toxic_rows + clean_rows)
    uncovered = toxic.copy()
    left = toxic_rows.copy()  # of each column, the toxic rows that no entry covers yet
    out: list[int] = []
    while len(out) < ENTRIES:
        gain = left * fine
        best = gain.max(initial=0)
        if best < COVER:
            break
        # of equal gains the widest entry, then the smallest slot
        tied = np.flatnonzero(gain == best)
        pick = int(tied[np.argmax(toxic_rows[tied])])
        out.append(int(matrix.columns[pick]))
        fine[pick] = False
        for k in matrix.rows_with(pick):
            if uncovered[k]:
                uncovered[k] = False
                left[matrix.row(k)] -= 1
    return out


class Votes:
    """Bit mask of the voters that a text makes hit."""

    def __init__(self, lexicon: list[int], keep: int = 300_000):
        self.masks = {slot: 2 << (k % LEXICONS) for k, slot in enumerate(lexicon)}
        self.known: dict[bytes, int] = {}
        self.keep = keep

    def _word(self, word: bytes) -> int:
        if len(self.known) >= self.keep:
            self.known.clear()
        mask = int(word in INSULTS)
        for slot in linear.word_slots(word):
            mask |= self.masks.get(slot, 0)
        self.known[word] = mask
        return mask

    def of(self, text: str) -> int:
        mask, known = 0, self.known
        for word in linear.words(text):
            found = known.get(word)
            mask |= self._word(word) if found is None else found
        raw, lower = (t.encode("utf-8", "surrogatepass") for t in (text, text.lower()))
        hits = [any(a in lower for a in ADDRESS), *[p.search(raw) is not None for p in PATTERNS]]
        for k, hit in enumerate(hits):
            mask |= hit << (1 + LEXICONS + k)
        return mask


@dataclass
class LabelModel:
    """Posterior of the toxic label for every vote pattern, with what was estimated."""

    posterior: np.ndarray
    accuracies: np.ndarray
    correlations: dict[tuple[int, int], float]


def fit_labels(patterns: dict[int, int], labelled: dict[tuple[int, int], int], count: int | None = None) -> LabelModel:
    """The label model of pattern counts and labelled (pattern, label) counts."""
    j = count or voters()
    masks = np.arange(1 << j)
    bits = ((masks[:, None] >> np.arange(j)) & 1).astype(float)
    seen = np.array([patterns.get(int(m), 0) for m in masks], float)
    known = np.array([[labelled.get((int(m), y), 0) for y in (0, 1)] for m in masks], float)
    per_class = known.sum(axis=0)
    # dependence of pairs given the label, on the labelled documents
    strength: dict[tuple[int, int], float] = {}
    for a, b in combinations(range(j), 2):
        dependence = 0.0
        for y in (0, 1):
            n = max(per_class[y], 1)
            pa_, pb, pab = (known[:, y] @ v / n for v in (bits[:, a], bits[:, b], bits[:, a] * bits[:, b]))
            spread = np.sqrt(max(pa_ * (1 - pa_) * pb * (1 - pb), 1e-9))
            dependence += per_class[y] * abs(pab - pa_ * pb) / spread * (spread > 1e-4)
        strength[a, b] = dependence
    pairs = sorted((p for p in strength if strength[p] > 0), key=lambda p: (-strength[p], p))[:CORRELATIONS]
    cross = np.stack([bits[:, a] * bits[:, b] for a, b in pairs], 1) if pairs else np.zeros((len(masks), 0))
    features = np.stack([np.concatenate((np.full((len(masks), 1), y), bits, y * bits, cross), 1) for y in (-1.0, 1.0)], 1)
    seen = (seen + known.sum(axis=1) * (seen.sum() == 0)) / max(seen.sum() or known.sum(), 1)
    told = known / max(known.sum(), 1)
    either_told = told.sum(axis=1)

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        """Minus the mean log-likelihood of all patterns and that of the labels given their patterns."""
        energy = features @ x
        top = energy.max()
        p = np.exp(energy - top)
        z = p.sum()
        each = energy - top - np.log(z)
        either = np.logaddexp(each[:, 0], each[:, 1])
        share = np.exp(each - either[:, None])
        loss = -(seen @ either) - (told * (each - either[:, None])).sum() + 1e-5 * (x @ x)
        met = (seen - either_told)[:, None] * share + told - p / z
        return float(loss), 2e-5 * x - np.tensordot(met, features, ((0, 1), (0, 1)))

    start = np.zeros(features.shape[2])
    start[0] = 0.5 * np.log(max(per_class[1], 0.5) / max(per_class[0], 0.5))
    for k in range(j):
        hit = [(known[:, y] @ bits[:, k] + 0.5) / (per_class[y] + 1) for y in (0, 1)]
        odds = [np.log(h / (1 - h)) for h in hit]
        start[1 + k], start[1 + j + k] = (odds[0] + odds[1]) / 2, (odds[1] - odds[0]) / 2
    x = linear.minimise(value, start, 200)
    energy = features @ x
    posterior = 1 / (1 + np.exp(np.clip(energy[:, 0] - energy[:, 1], -40, 40)))
    return LabelModel(posterior, x[1 + j : 1 + 2 * j], {p: float(v) for p, v in zip(pairs, x[1 + 2 * j :], strict=True)})


@dataclass
class Model:
    weights: dict[int, float]
    base: float


def fit_linear(matrix: linear.Sparse, target: np.ndarray, share: np.ndarray, rounds: int = 200) -> Model:
    """L1-penalised logistic regression on soft labels, by accelerated proximal gradient steps."""
    share = share / share.sum()
    # columns that tell nothing by themselves are left out
    mass, hits = matrix.back(share), matrix.back(share * target)
    rate = float(share @ target)
    noise = np.sqrt(mass * rate * (1 - rate) / len(target))
    telling = np.abs(hits - rate * mass) > 3 * noise
    if not telling.any():
        return Model({}, float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))))
    part = matrix.only(telling)
    w, base = np.zeros(len(part.columns)), float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)))
    v, v_base, momentum, step = w.copy(), base, 1.0, 4.0

    def loss_of(x: np.ndarray, b: float) -> tuple[float, np.ndarray]:
        score = part.times(x) + b
        return float(share @ (np.logaddexp(0, score) - target * score)), score

    for _ in range(rounds):
        f, score = loss_of(v, v_base)
        r = share * (1 / (1 + np.exp(-np.clip(score, -40, 40))) - target)
        g, g_base = part.back(r), float(r.sum())
        while True:
            new = v - step * g
            new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
            new_base = v_base - step * g_base
            d, d_base = new - v, new_base - v_base
            if loss_of(new, new_base)[0] <= f + g @ d + g_base * d_base + (d @ d + d_base**2) / (2 * step) + 1e-12 or step < 1e-6:
                break
            step /= 2
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, v_base = new + (momentum - 1) / after * (new - w), new_base + (momentum - 1) / after * (new_base - base)
        moved = float(np.abs(new - w).max(initial=0))
        w, base, momentum, step = new, new_base, after, step * 1.2
        if moved < 1e-4:
            break
    return Model(linear.named(part.columns, w), base)


def vote(documents: DataFrame, lexicon: list[int]) -> DataFrame:
    """doc_id and votes (bit mask) of every document."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = Votes(sent.value)
        for batch in batches:
            for part in common.text_slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([votes.of(t or "") for t in part.column(1).to_pylist()], pa.int32())], names=["doc_id", "votes"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, votes int")


def learn(documents: DataFrame, labels: DataFrame, learners, rows: int = linear.SAMPLE_ROWS) -> Model:
    """Fit on labels(doc_id, toxic) of documents; learners is the column condition of documents that may be learned from."""
    spark = documents.sparkSession
    ids, totals = linear.sample_ids(labels.where(F.col("toxic").isin(0, 1)), "toxic", rows)
    share = totals.get(1, 0) / max(sum(totals.values()), 1)
    flat = Model({}, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    if len(totals) < 2:
        return flat
    matrix, y = linear.vectors(linear.sampled(documents, ids), True, COVER)
    toxic = y == 1
    if not toxic.any() or toxic.all():
        return flat
    ratio = (totals[0] / (~toxic).sum()) / (totals[1] / toxic.sum())
    lexicon = induce(matrix, toxic, ratio)
    del matrix
    # the vote patterns of every document; narrow, and counted before they leave their task
    voted = common.materialize(vote(documents, lexicon), "votes")
    patterns = {r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    own = spark.createDataFrame(ids, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, y int")
    met = voted.join(F.broadcast(own), "doc_id").groupBy("votes", "y").agg(F.count("*").alias("n")).collect()
    labelled = {(r["votes"], r["y"]): r["n"] for r in met}
    model = fit_labels(patterns, labelled)
    # soft labels of a sample of each side
    likely = {int(m) for m in np.flatnonzero(model.posterior >= 0.5)}
    side = F.col("votes").isin(*likely) if likely else F.lit(False)
    pool = voted.where("doc_id is not null").where(learners).withColumn("side", side)
    sizes = {r["side"]: r["n"] for r in pool.groupBy("side").agg(F.count("*").alias("n")).collect()}
    chosen: dict[int, int] = {}
    for which in (False, True):
        top = pool.where(F.col("side") == which).orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(1)), "doc_id").limit(rows)
        for r in top.collect():
            chosen.setdefault(r["doc_id"], r["votes"])
    if len(sizes) < 2:
        return flat
    common.drop_table(voted)
    matrix, votes = linear.vectors(linear.sampled(documents, sorted(chosen.items())), True, COVER)
    target = model.posterior[votes]
    sides = np.isin(votes, sorted(likely))
    weight = np.where(sides, sizes[True] / max(sides.sum(), 1), sizes[False] / max((~sides).sum(), 1))
    return fit_linear(matrix, target, weight)


def score(documents: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """The documents, all columns as they are, with their score; rows of the same id are scored each by its own text."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        scorer = linear.Scorer(own.weights)
        for batch in batches:
            for part in common.text_slices(batch, at):
                found = np.array([scorer.of_present(t or "") for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(found + own.base, -40, 40))), pa.float64())], names=[*part.schema.names, column])

    schema = type(documents.schema)([*documents.schema.fields])
    return documents.mapInArrow(run, schema.add(column, "double"))


def without_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """The documents whose score is under THRESHOLD, with the columns they had."""
    name = "__toxicity"
    return score(documents, model, name).where(F.col(name) < THRESHOLD).drop(name)


def query(spark, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").where(~common.held_out()).select("doc_id", "toxic")
    out = score(documents, learn(documents, labels, ~common.held_out()))
    return out.select("doc_id", common.held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
