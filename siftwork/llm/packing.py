"""Best-fit packing by a configuration linear program over the length histogram.

The demand is a histogram of piece lengths, at most `capacity` numbers whatever the size of the corpus.
A covering linear program over configurations (multisets of lengths that fit one sequence) is solved
by multiplicative weights: each round prices the best configuration by a knapsack dynamic program under
the current weights, takes a step of it, and lowers the weights of what it covers. The weights of every round
also give a lower bound of the program. The solution is rounded down to whole configurations at several scales (the
smallest being none of it); what is left over is packed best fit, on the histogram, and the rounding of fewest sequences
is the plan. Pieces are then dealt to the slots of their length by rank; a length is ranked in as many parts as keep each
part within PART_ROWS or so, so no task sees more than its share.

A null text is empty: one piece of one token, the end-of-text id 0. Rows may repeat or lack an id.
"""

from __future__ import annotations

import base64
import functools
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from . import common

CAPACITY = 2048
ROUNDS = 300
#: Rounds between two roundings.
LOOK = 50
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Text that the vocabulary has as one token, and its id.
SPECIAL = {"<|endoftext|>": 50256}
#: Pieces of one length that are ranked in one part, on average.
PART_ROWS = 400_000

_encoders: dict[str, object] = {}


def encoder(vocabulary: str):
    """The byte-level encoder of a vocabulary file, loaded once a worker.

    It gives the ids that `tokenizers` gives with byte_bpe_50k.json and add_special_tokens=False, at a fifth of its CPU time
    (a test compares the two): SPECIAL in a text is its one token.
    """
    if vocabulary not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[vocabulary] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _encoders[vocabulary]


def pieces(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32."""
    id_type = documents.schema["doc_id"].dataType
    arrow = pa.schema([("doc_id", to_arrow_type(id_type)), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        plain, special = own.encode_ordinary, functools.partial(own.encode, allowed_special="all")
        marks = tuple(SPECIAL)
        for batch in batches:
            for part in common.text_slices(batch, 1):
                rows: list[tuple] = []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = (special if any(m in text for m in marks) else plain)(text) if text else []
                    ids.append(0)
                    raw = np.array(ids, "<u4")
                    start, end, k = 0, len(ids) % capacity or min(capacity, len(ids)), 0
                    while start < len(ids):
                        rows.append((key, k, start, end - start, zlib.crc32(raw[start:end])))
                        start, end, k = end, end + capacity, k + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


class Plan:
    """Configurations with multiplicities: each is a list of (length, copies), used `times` times."""

    def __init__(self):
        self.configurations: list[tuple[tuple[tuple[int, int], ...], int]] = []
        #: No packing has fewer sequences.
        self.bound = 0

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.configurations)

    def add(self, items, times: int) -> None:
        if times:
            self.configurations.append((tuple(items), int(times)))


def price(lengths: np.ndarray, weights: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration of largest weight: unbounded knapsack by dynamic programming over capacity."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if upto[c]:
            gain = best[c - lengths[: upto[c]]] + weights[: upto[c]]
            k = int(gain.argmax())
            if gain[k] > best[c]:
                best[c], took[c] = gain[k], k
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        k = took[c]
        if k < 0:
            c -= 1
        else:
            out[int(k)] = out.get(int(k), 0) + 1
            c -= int(lengths[k])
    return out


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit decreasing over a histogram; equal bins are kept as one entry with a count."""
    open_bins: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(room: int, items: tuple, n: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        open_bins[room].append([items, n])

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                items, m = open_bins[room][-1]
                fit = min(room // length, n)
                bins = min(m, n // fit)
                if bins == m:
                    open_bins[room].pop()
                    if not open_bins[room]:
                        del open_bins[room], rooms[at]
                else:
                    open_bins[room][-1][1] = m - bins
            else:
                room, items = capacity, ()
                fit = min(room // length, n)
                bins = n // fit
            put(room - fit * length, (*items, (length, fit)), bins)
            n -= fit * bins
    plan = Plan()
    for groups in open_bins.values():
        for items, n in groups:
            plan.add(items, n)
    return plan


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Plan:
    """Configurations that hold exactly the histogram's pieces, in as few sequences as found."""
    if not histogram:
        return Plan()
    lengths = np.array(sorted(histogram))
    demand = np.array([histogram[int(x)] for x in lengths], float)
    covered = np.zeros(len(lengths))
    used: dict[tuple, float] = {}
    bound = float(demand @ lengths) / capacity
    # multiplicative weights: the log of a weight falls with the covered share of its demand
    rate = np.log(max(2, len(lengths))) * 2
    plan = None
    for k in range(1, rounds + 1):
        share = covered / demand
        weights = np.exp(-rate * (share - share.min())) * lengths
        chosen = price(lengths, weights, capacity)
        rows, copies = np.array(list(chosen)), np.array(list(chosen.values()), float)
        bound = max(bound, float(demand @ weights) / float(weights[rows] @ copies))  # weights scaled to 1 a configuration
        step = float((demand[rows] / copies).min()) * 0.25
        key = tuple(sorted(chosen.items()))
        used[key] = used.get(key, 0.0) + step
        covered[rows] += step * copies
        if k % LOOK == 0 or k == rounds:
            scales = [*(1 / max(float(q), 1e-9) for q in np.quantile(covered / demand, (0.0, 0.25, 0.5, 1.0))), 0.0]
            plan = min([*([plan] if plan else []), *(rounded(used, x, lengths, demand, capacity) for x in scales)], key=lambda p: p.sequences)
            plan.bound = int(np.ceil(bound - 1e-6))
            if plan.sequences == plan.bound:  # no more rounds can do better
                break
    return plan


def rounded(used: dict[tuple, float], scale: float, lengths: np.ndarray, demand: np.ndarray, capacity: int) -> Plan:
    """Whole configurations of a scaled solution, never beyond the demand; the rest is packed best fit."""
    left = demand.astype(np.int64)
    plan = Plan()
    for key, x in sorted(used.items(), key=lambda kv: (-kv[1], kv[0])):
        times = min(int(x * scale), *(int(left[k]) // a for k, a in key))
        if times > 0:
            for k, a in key:
                left[k] -= a * times
            plan.add([(int(lengths[k]), a) for k, a in key], times)
    rest = best_fit({int(k): int(v) for k, v in zip(lengths, left, strict=True) if v}, capacity)
    plan.configurations += rest.configurations
    return plan


def slots(plan: Plan) -> tuple[np.ndarray, ...]:
    """The plan as sorted arrays: key (length, first rank), copies, first sequence, offset, length."""
    filled: dict[int, int] = {}
    rows, base = [], 0
    for items, times in plan.configurations:
        offset = 0
        for length, copies in items:
            first = filled.get(length, 0)
            rows.append((length, first, copies, base, offset))
            filled[length] = first + copies * times
            offset += length * copies
        base += times
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 5)
    return (a[:, 0] << 44) + a[:, 1], a[:, 2], a[:, 3], a[:, 4], a[:, 1]


def pack(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, part_rows: int = PART_ROWS) -> DataFrame:
    """Pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = documents.sparkSession
    cut = common.materialize(pieces(documents, capacity, vocabulary), "pieces")
    # at most `capacity` rows
    sizes = cut.groupBy("length").agg((F.count("*") / part_rows).cast("bigint").alias("__parts"))
    salted = cut.join(F.broadcast(sizes), "length").withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("__parts") + 1)).drop("__parts")
    counts = salted.groupBy("length", "__salt").agg(F.count("*").alias("n"))
    # at most `capacity` rows and one for each part_rows pieces
    cells = sorted((r["length"], r["__salt"], r["n"]) for r in counts.collect())
    histogram: dict[int, int] = {}
    before = []
    for length, _, n in cells:
        before.append(histogram.get(length, 0))
        histogram[length] = histogram.get(length, 0) + n
    named = np.array([(length << 32) + salt for length, salt, _ in cells], np.int64)
    sent = spark.sparkContext.broadcast((slots(solve(histogram, capacity)), named, np.array(before, np.int64)))
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "start")).cast("bigint") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, copies, bases, offsets, firsts), cell, before = sent.value
        for batch in batches:
            length, salt, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__salt", "__rank"))
            rank = rank + before[np.searchsorted(cell, (length << 32) + salt)]
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            j = rank - firsts[at]
            out = [batch.column(k) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(bases[at] + j // copies[at]), pa.array(offsets[at] + j % copies[at] * length)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = cut.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "__salt", "__rank").mapInArrow(
        place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
