"""All pairs of signals compared in blocks, as matrices.

Signals are cut into ranges of seq of about BLOCK each; every pair of ranges is one piece of work that a Python worker
compares part by part. Only signals are shuffled, once for each range, and never a pair. Scores are those of
similarity.composite, to the bit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity

BLOCK = 4096
#: Pairs compared at once in a worker.
CELLS = 1 << 20
#: A word of so many signals of a block is counted by a matrix product, a rarer one by its places.
DENSE = 256
#: Pieces of work that have a task of their own; of more, some share one.
TASKS = 10_000
PAIRS = "a bigint, b bigint, score double, id_hit boolean"
COLUMNS = ("seq", "ids", "title", "evidence", "value", "place", "sector")


class Shared:
    """How many words rows of y share with each row of x."""

    def __init__(self, x: pa.Table, y: pa.Table, name: str):
        lists = [t.column(name).combine_chunks() for t in (x, y)]
        flat = pc.dictionary_encode(pa.concat_arrays([v.flatten() for v in lists]))
        word = flat.indices.to_numpy(zero_copy_only=False)
        self.sizes = [np.asarray(pc.fill_null(pc.list_value_length(v), 0), dtype=np.int64) for v in lists]
        row_x, row_y = (np.repeat(np.arange(len(s)), s) for s in self.sizes)
        word_x, self.word = word[: len(row_x)], word[len(row_x) :]
        self.ends = np.concatenate([[0], np.cumsum(self.sizes[1])])
        self.row = row_y
        seen = np.bincount(word_x, minlength=len(flat.dictionary))
        self.some = bool(len(self.word)) and bool((seen[self.word] > 0).any())
        self.slot = np.full(len(seen), -1)
        dense = np.flatnonzero(seen >= DENSE)
        self.slot[dense] = np.arange(len(dense))
        self.product = np.zeros((len(dense), len(lists[0])), dtype=np.float32)
        often = self.slot[word_x] >= 0
        self.product[self.slot[word_x[often]], row_x[often]] = 1
        # rows of x by word, of the other words
        order = np.argsort(word_x[~often], kind="stable")
        self.by_word = row_x[~often][order]
        self.n = np.where(self.slot >= 0, 0, seen)
        self.start = np.cumsum(self.n) - self.n

    def counts(self, lo: int, hi: int) -> np.ndarray:
        """Of rows lo to hi of y."""
        m, width = hi - lo, self.product.shape[1]
        word, row = self.word[self.ends[lo] : self.ends[hi]], self.row[self.ends[lo] : self.ends[hi]] - lo
        often = self.slot[word] >= 0
        y = np.zeros((m, self.product.shape[0]), dtype=np.float32)
        y[row[often], self.slot[word[often]]] = 1
        out = (y @ self.product).astype(np.float64)
        n = self.n[word]
        if n.any():
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            col = self.by_word[np.repeat(self.start[word], n) + inside]
            out += np.bincount(np.repeat(row, n) * width + col, minlength=m * width).reshape(m, width)
        return out

    def jaccard(self, lo: int, hi: int) -> np.ndarray:
        both = self.counts(lo, hi)
        return both / np.maximum(self.sizes[1][lo:hi, None] + self.sizes[0][None, :] - both, 1)


def rounded(total: np.ndarray) -> np.ndarray:
    """Three places, halves of the decimal form up, as Spark rounds."""
    scaled = total * 1000
    down = np.floor(scaled)
    out = np.floor(scaled + 0.5) / 1000
    close = np.abs(scaled - down - 0.5) < 1e-6
    if close.any():
        values, at = np.unique(total[close], return_inverse=True)
        out[close] = np.array([float(Decimal(repr(float(v))).quantize(Decimal("0.001"), ROUND_HALF_UP)) for v in values])[at]
    return out


def _amounts(x: np.ndarray, y: np.ndarray, null_x: np.ndarray, null_y: np.ndarray) -> np.ndarray:
    """similarity.amount_similarity; as in SQL, NaN is over every number."""
    low, high = np.fmin(x, y), np.maximum(x, y)
    with np.errstate(all="ignore"):
        ratio = np.where((high > 0) | np.isnan(high), low / high, 0.0)
    out = np.where((ratio >= 0.8) | np.isnan(ratio), 1.0, np.where(ratio >= 0.5, 0.5, 0.0))
    out[(x == 0) & (y == 0)] = 1.0
    out[null_x | null_y] = 0.0
    return out


def compared(x: pa.Table, y: pa.Table, threshold: float, best: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of a row of x and a later one of y that reach the threshold; best: of each row of y those of its highest score."""
    seq_x, seq_y = (t.column("seq").to_numpy() for t in (x, y))
    if not len(seq_x) or not len(seq_y):
        return
    title, evidence, ids = (Shared(x, y, n) for n in ("title", "evidence", "ids"))
    null_x, null_y = (np.asarray(t.column("value").is_null()) for t in (x, y))
    value_x, value_y = (np.asarray(pc.fill_null(t.column("value"), 0.0)) for t in (x, y))
    code = {}
    for n in ("place", "sector"):
        each = pc.dictionary_encode(pa.concat_arrays([t.column(n).combine_chunks() for t in (x, y)])).indices.to_numpy(zero_copy_only=False)
        code[n] = each[: len(seq_x)], each[len(seq_x) :]
    placed = np.asarray(pc.not_equal(y.column("place"), ""))
    w_title, w_evidence, w_amount, w_place, w_sector = similarity.WEIGHTS
    apart = seq_x.max() < seq_y.min()
    step = max(1, CELLS // len(seq_x))
    for lo in range(0, len(seq_y), step):
        hi = min(lo + step, len(seq_y))
        total = w_title * title.jaccard(lo, hi)
        total += w_evidence * evidence.jaccard(lo, hi)
        total += w_amount * _amounts(value_x[None, :], value_y[lo:hi, None], null_x[None, :], null_y[lo:hi, None])
        total += np.where((code["place"][0][None, :] == code["place"][1][lo:hi, None]) & placed[lo:hi, None], w_place * 1.0, w_place * 0.3)
        total += np.where(code["sector"][0][None, :] == code["sector"][1][lo:hi, None], w_sector, 0.0)
        score = rounded(total)
        hit = ids.counts(lo, hi) > 0 if ids.some else None
        if hit is not None:
            score[hit] = 1.0
        good = score >= threshold
        if not apart:
            good &= seq_x[None, :] < seq_y[lo:hi, None]
        if best:
            good &= score == np.where(good, score, -1.0).max(axis=1)[:, None]
        row, col = np.nonzero(good)
        if len(row):
            made = (seq_x[col], seq_y[lo:hi][row], score[row, col], hit[row, col] if hit is not None else np.zeros(len(row), dtype=bool))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in made], names=["a", "b", "score", "id_hit"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of equal piece of batches that are in its order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        piece = batch.column("piece").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), len(piece)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if held and held[0].column("piece")[0].as_py() != piece[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def pairs(keyed: DataFrame, threshold: float, later: DataFrame | None = None) -> DataFrame:
    """(a, b, score, id_hit) of signals a < b that reach the threshold, keyed being written.

    later: keyed signals too; of each of them only the partners of its highest score in every block.
    """
    best, later = later is not None, keyed if later is None else later
    blocks = max(1, math.ceil(keyed.count() / BLOCK))
    bounds = keyed.approxQuantile("seq", [k / blocks for k in range(1, blocks)], 1 / (8 * blocks)) if blocks > 1 else []
    own = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda at: at <= F.col("seq").cast("double")))

    def dealt(rows: DataFrame, side: int, others) -> DataFrame:
        placed = rows.where("seq is not null").select(own.alias("own"), *COLUMNS)
        return placed.select(F.explode(others).alias("other"), "own", F.lit(side).alias("side"), *COLUMNS)

    first = dealt(keyed, 0, F.sequence("own", F.lit(blocks - 1))).withColumns({"i": F.col("own"), "j": F.col("other")})
    second = dealt(later, 1, F.sequence(F.lit(0), "own")).withColumns({"i": F.col("other"), "j": F.col("own")})
    rows = first.unionByName(second).select(F.expr("j * (j + 1L) div 2 + i").alias("piece"), "side", *COLUMNS)
    tasks = min(TASKS, blocks * (blocks + 1) // 2)
    rows = rows.repartitionById(tasks, (F.col("piece") % tasks).cast("int")).sortWithinPartitions("piece", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _pieces(batches):
            yield from compared(t.filter(pc.equal(t.column("side"), 0)), t.filter(pc.equal(t.column("side"), 1)), threshold, best)

    return rows.mapInArrow(run, PAIRS)
