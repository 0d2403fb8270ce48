"""Hashed text features and linear models on them, shared by the quality and toxicity classifiers.

A text is its distinct tokens (runs of anything but white space). A token's features are its folded word, the word's
prefixes, and the token's shape; a text has a few features of its own (length, variety, repeated lines). A run of more
than LONG bytes without punctuation (a script without spaces, joined words) is taken apart at every sign that is
no letter or digit, and what is still longer counts as all of its runs of GRAM characters.
All are hashed to 32 bits, enough that words of a corpus do not meet a model's weights by chance; a model keeps the
weights of the slots it met. Since a model is linear, a token's score is the sum of its features' weights, made
once for each distinct token of a batch. Whole texts are read, whatever their tokens' lengths.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PREFIXES = (3, 4, 5, 6)
#: Bounds of the sample that a model is fitted on: labelled rows of each class, in the order of a hash of their id.
SAMPLE_ROWS = 3000
_ASCII = range(33, 127)
_PUNCTUATION = bytes(c for c in _ASCII if not chr(c).isalnum())
_OUTLINE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 else 48 if 48 <= c <= 57 else c for c in range(256))
_BEYOND = bytes(range(128, 256))
_RUNS = re.compile(rb"(.)\1+", re.S)
#: Bytes of a word that stands for itself; longer runs are taken apart.
LONG = 64
GRAM = 3
_SIGNS = re.compile(r"[\W_]+")
#: UTF-8 of white space outside ASCII: no-break, ideographic and zero-width space.
_WIDE_SPACE = (b"\xc2\xa0", b"\xe3\x80\x80", b"\xe2\x80\x8b")
#: First values of the checksums, one for each kind of feature.
_WORD, _PREFIX, _SHAPE, _TEXT = 1, 2, 3, 4


def word_slots(word: bytes) -> tuple[int, ...]:
    """Hashed features of a folded word: itself and its beginnings (of 3 to 6 bytes)."""
    return (crc32(word, _WORD), *[crc32(word[:n], _PREFIX) for n in PREFIXES if len(word) > n])


def parts(token: bytes) -> set[bytes]:
    """The words of a long folded token: its runs of letters and digits, and all GRAM characters in a row of those still too long."""
    out: set[bytes] = set()
    for run in _SIGNS.split(token.decode("utf-8", "surrogatepass")):
        raw = run.encode("utf-8", "surrogatepass")
        if len(raw) <= LONG:
            out.add(raw)
        else:
            out.update(run[i : i + GRAM].encode("utf-8", "surrogatepass") for i in range(len(run) - GRAM + 1))
    return out - {b""}


def split(text: bytes) -> list[bytes]:
    """Tokens of a UTF-8 text: runs of anything but white space."""
    for space in _WIDE_SPACE:
        text = text.replace(space, b" ")
    return text.split()


def words(text: str) -> set[bytes]:
    """Distinct folded words: lower case, without ASCII punctuation."""
    raw = text.lower().encode("utf-8", "surrogatepass")
    found = set(split(raw.translate(None, _PUNCTUATION)))
    if max(map(len, found), default=0) > LONG:
        found = {w for w in found if len(w) <= LONG}
        for token in set(split(raw)):
            if len(token) > LONG and len(token.translate(None, _PUNCTUATION)) > LONG:
                found |= parts(token)
    return found


def shape(token: bytes) -> bytes:
    """A token's outline: ASCII letters by case, digits, and punctuation as it is, runs collapsed; other letters left out."""
    return _RUNS.sub(rb"\1", token.translate(_OUTLINE, _BEYOND))


def text_slots(tokens: list[bytes], distinct: int, text: bytes) -> list[int]:
    """Hashed features of the text as a whole: length, variety, repeated lines, mean length of tokens."""
    n = len(tokens)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 1 - len(set(lines)) / len(lines) if lines else 0.0
    size = n.bit_length()
    return [crc32(f"{kind} {value}".encode(), _TEXT) for kind, value in (
        ("length", size), ("variety", f"{round(10 * distinct / max(n, 1))} {min(size, 9)}"), ("lines", round(10 * repeated)), ("token", min(len(text) // max(n, 1), 24)))]


class Tokens:
    """Slots of raw tokens, word and shape; those seen before are kept, up to a bound."""

    def __init__(self, keep: int = 200_000):
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.keep = keep

    def slots(self, token: bytes) -> tuple[int, ...]:
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= self.keep:
                self.known.clear()
            folded = token.lower()
            word = folded.translate(None, _PUNCTUATION)
            own = {word} - {b""} if len(word) <= LONG else parts(folded)
            found = self.known[token] = (crc32(shape(token), _SHAPE), *[s for w in sorted(own) for s in word_slots(w)])
        return found


def tokens_of(text: str) -> tuple[bytes, list[bytes], dict[bytes, int]]:
    raw = text.encode("utf-8", "surrogatepass")
    tokens = split(raw)
    return raw, tokens, Counter(tokens)


class Featurizer:
    """Feature vectors of texts."""

    def __init__(self):
        self.tokens = Tokens()

    def counts(self, text: str) -> dict[int, float]:
        """Sparse vector of a text: each slot's share of tokens (the text's own slots count 1)."""
        raw, tokens, times = tokens_of(text)
        out: dict[int, float] = {}
        for t, k in times.items():
            for s in self.tokens.slots(t):
                out[s] = out.get(s, 0.0) + k
        n = max(len(tokens), 1)
        out = {s: v / n for s, v in out.items()}
        for s in text_slots(tokens, len(times), raw):
            out[s] = out.get(s, 0.0) + 1.0
        return out

    def present(self, text: str) -> set[int]:
        """Distinct slots of a text's words."""
        out: set[int] = set()
        for w in words(text):
            out.update(word_slots(w))
        return out


class Scorer:
    """Linear scores of texts; what is known of tokens seen before is kept, up to a bound."""

    def __init__(self, weights: dict[int, float], keep: int = 300_000):
        self.weights, self.keep = weights, keep
        self.tokens = Tokens(1)
        self.known: dict[bytes, float] = {}
        self.sets: dict[bytes, tuple[int, ...]] = {}

    def _token(self, token: bytes) -> float:
        if len(self.known) >= self.keep:
            self.known.clear()
        get = self.weights.get
        score = self.known[token] = sum([get(s, 0.0) for s in self.tokens.slots(token)])
        return score

    def of_counts(self, text: str) -> float:
        """Score of Featurizer.counts."""
        raw, tokens, times = tokens_of(text)
        known, total = self.known, 0.0
        for t, k in times.items():
            score = known.get(t)
            total += k * (self._token(t) if score is None else score)
        return total / max(len(tokens), 1) + sum([self.weights.get(s, 0.0) for s in text_slots(tokens, len(times), raw)])

    def of_present(self, text: str) -> float:
        """Score of Featurizer.present."""
        found: set[int] = set()
        sets, weights = self.sets, self.weights
        for w in words(text):
            own = sets.get(w)
            if own is None:
                if len(sets) >= self.keep:
                    sets.clear()
                own = sets[w] = tuple([s for s in word_slots(w) if s in weights])
            if own:
                found.update(own)
        return sum([weights[s] for s in sorted(found)])


def sample_ids(labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """At most `rows` labelled ids of each class, (doc_id, class), in the order of a hash; and how many rows each class has.

    Classes are non-null integers. A doc_id with several labels counts as its smallest.
    """
    named = labels.where(f"doc_id is not null and {label} is not null").groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    totals = {r["y"]: r["n"] for r in named.groupBy("y").agg(F.count("*").alias("n")).collect()}
    out = []
    for y in sorted(totals):
        top = named.where(F.col("y") == y).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(rows)
        out += [(r["doc_id"], y) for r in top.collect()]
    return out, totals


def sampled(documents: DataFrame, ids: list[tuple[int, int]]) -> DataFrame:
    """The sampled documents (doc_id, text, y), written; the id list is bounded by the sample."""
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    frame = spark.createDataFrame(ids, f"doc_id {kind}, y int")
    return common.materialize(documents.select("doc_id", "text").where("text is not null").join(F.broadcast(frame), "doc_id"), "sampled")


def vectors(rows: DataFrame, present: bool, least: int) -> tuple[Sparse, np.ndarray]:
    """Sparse training matrix of written (doc_id, text, y), which are deleted, and its y; only slots that `least` rows have.

    Slots are counted on the executors first, so the driver gets the frequent ones only. Rows that share a doc_id come
    in no special order.
    """
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]]]:
        made = Featurizer()
        for batch in batches:
            for part in common.text_slices(batch, 1):
                found = []
                for text in part.column(1).to_pylist():
                    if present:
                        found.append((np.sort(np.fromiter(made.present(text), np.int64)), np.zeros(0, np.float32)))
                    else:
                        got = sorted(made.counts(text).items())
                        found.append((np.array([a for a, _ in got], np.int64), np.array([b for _, b in got], np.float32)))
                yield part, found

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in features(batches):
            slots, n = np.unique(np.concatenate([s for s, _ in found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(n, pa.int64())], names=["slot", "n"])

    rows = rows.select("doc_id", "text", "y")
    spark = rows.sparkSession
    counted = rows.mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    columns = np.sort(counted.select("slot").toArrow().column(0).to_numpy())
    sent = spark.sparkContext.broadcast(columns)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for part, found in features(batches):
            at, values = [], []
            for s, v in found:
                place = np.searchsorted(known, s)
                met = place < len(known)
                met[met] = known[place[met]] == s[met]
                at.append(place[met].astype(np.int32).tobytes())
                values.append(v[met].tobytes() if len(v) else b"")
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(2), pa.array(at, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "y", "at", "vals"])

    got = rows.mapInArrow(index, "doc_id string, y int, at binary, vals binary").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("at", "ascending"), ("y", "ascending")])
    y = got.column("y").to_numpy().astype(np.int64)
    at = [np.frombuffer(x.as_buffer(), np.int32) for x in got.column("at")]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in at]))).astype(np.int64)
    flat = np.concatenate(at) if at else np.zeros(0, np.int32)
    values = None if present or not at else np.concatenate([np.frombuffer(x.as_buffer(), np.float32) for x in got.column("vals")])
    del got, at
    sent.destroy()
    common.drop_table(rows)
    return Sparse(starts, columns, flat, values), y


def minimise(value_and_gradient: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 100, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking."""
    f, g = value_and_gradient(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.abs(g).max() < 1e-5:
            break
        q, alphas = g.copy(), []
        for s, y, rho in reversed(steps):
            a = rho * (s @ q)
            alphas.append(a)
            q -= a * y
        q *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, float(np.linalg.norm(g)))
        for (s, y, rho), a in zip(steps, reversed(alphas), strict=True):
            q += s * (a - rho * (y @ q))
        slope, rate = -float(q @ g), 1.0
        if slope >= 0:
            steps.clear()
            q, slope = g, -float(g @ g)
        while True:
            new = x - rate * q
            f2, g2 = value_and_gradient(new)
            if f2 <= f + 1e-4 * rate * slope or rate < 1e-8:
                break
            rate /= 2
        s, y = new - x, g2 - g
        if (sy := float(s @ y)) > 1e-12:
            steps.append((s, y, 1 / sy))
            del steps[:-memory]
        done = f - f2 < 1e-7 * max(1.0, abs(f))
        x, f, g = new, f2, g2
        if done:
            break
    return x


class Sparse:
    """A row-compressed matrix: columns names the slot of each column, at holds the column of each entry; values of None are ones."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, at: np.ndarray, values: np.ndarray | None = None):
        self.starts, self.columns, self.at, self.values = starts, columns, at, values
        self.rows = len(starts) - 1
        self.doc = np.repeat(np.arange(self.rows, dtype=np.int32), np.diff(starts))

    def times(self, w: np.ndarray) -> np.ndarray:
        each = w[self.at]
        return np.bincount(self.doc, weights=each if self.values is None else each * self.values, minlength=self.rows)

    def back(self, r: np.ndarray) -> np.ndarray:
        each = r[self.doc]
        return np.bincount(self.at, weights=each if self.values is None else each * self.values, minlength=len(self.columns))

    def row(self, k: int) -> np.ndarray:
        return self.at[self.starts[k] : self.starts[k + 1]]

    def rows_with(self, column: int) -> np.ndarray:
        return self.doc[self.at == column]

    def only(self, kept: np.ndarray) -> Sparse:
        """The matrix of the kept columns (a mask)."""
        entries = kept[self.at]
        number = np.cumsum(kept, dtype=np.int32) - 1
        starts = np.concatenate(([0], np.cumsum(np.bincount(self.doc[entries], minlength=self.rows)))).astype(np.int64)
        return Sparse(starts, self.columns[kept], number[self.at[entries]], None if self.values is None else self.values[entries])


def named(columns: np.ndarray, w: np.ndarray, least: float = 1e-4) -> dict[int, float]:
    """Weights by slot, without negligible ones."""
    return {int(c): float(x) for c, x in zip(columns, w, strict=True) if abs(x) >= least}
