"""Benchmark decontamination with one FM-index per training shard.

A shard is a bounded run of whole documents inside one Spark partition. Its words are mapped to the
benchmark's vocabulary; every maximal stretch of benchmark words that is long enough to hold a phrase
goes into the index (a phrase lies wholly inside one stretch, so nothing that can match is left out).
The index is a suffix array's Burrows-Wheeler transform under a wavelet matrix. All test phrases are
searched backwards at once, their occurrences are located by walking to sampled suffix positions, and
overlapping occurrences merge into removal spans.

Null or empty texts have no words and are returned with zero counts; rows may repeat or lack an id. Benchmark rows with a null id or
without words are ignored; a repeated item counts once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from . import common

WINDOW = 8
#: Words that the benchmark holds in memory at once; a larger benchmark is searched block by block.
BLOCK_WORDS = 4_000_000
#: Bytes of text and indexed words at which a shard is closed.
SHARD_BYTES = 96 << 20
SHARD_WORDS = 1_500_000
SAMPLE = 8

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a UTF-8 text."""
    return text.translate(_TO_WORDS).split()


class WaveletMatrix:
    """Ranks of symbols in a sequence of small integers, one bit level at a time."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bits = (symbols >> level) & 1
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bits, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate((symbols[bits == 0], symbols[bits == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c[k] before position i[k]."""
        start, end = np.zeros_like(i), i.copy()
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((c >> level) & 1).astype(bool)
            s, e = self.ones[k][start], self.ones[k][end]
            start = np.where(one, self.zeros[k] + s, start - s)
            end = np.where(one, self.zeros[k] + e, end - e)
        return end - start


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; symbol 0 separates stretches and every separator is distinct."""
    n = len(symbols)
    gaps = symbols == 0
    rank = np.where(gaps, np.cumsum(gaps) - 1, symbols + np.count_nonzero(gaps)).astype(np.int64)
    width = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - width] = rank[width:]
        key = rank * (n + int(rank.max()) + 2) + after + 1
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, np.int64)
        sorted_key = key[order]
        fresh[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        if fresh[order[-1]] == n - 1:
            return order
        rank, width = fresh, width * 2


class FMIndex:
    """Counts and locates word phrases in a sequence of symbols whose stretches end in 0."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        symbols = symbols.astype(np.int32)
        self.n = len(symbols)
        order = suffix_array(symbols)
        self.bwt = symbols[order - 1]
        self.tree = WaveletMatrix(self.bwt)
        counts = np.bincount(symbols, minlength=int(symbols.max(initial=0)) + 2)
        self.below = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
        # every sample-th position, and every first position of a stretch, so no walk meets a separator
        first = np.ones(self.n, bool)
        first[1:] = symbols[:-1] == 0
        marked = (first | (np.arange(self.n) % sample == 0))[order]
        self.marked = marked
        self.before = np.concatenate(([0], np.cumsum(marked)))
        self.samples = order[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of phrases, a matrix with one phrase a row."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            known = c < len(self.below)
            high[live[~known]] = low[live[~known]]
            live, c = live[known], c[known]
            low[live] = self.below[c] + self.tree.rank(c, low[live])
            high[live] = self.below[c] + self.tree.rank(c, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.marked[rows])
        while len(walking):
            c = self.bwt[rows[walking]]
            rows[walking] = self.below[c] + self.tree.rank(c, rows[walking])
            steps[walking] += 1
            walking = walking[~self.marked[rows[walking]]]
        return self.samples[self.before[rows]] + steps


class Phrases:
    """The distinct windows of benchmark items, grouped by length, and the items each belongs to."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        self.ids = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.ids)}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[at : at + window]), set()).add(number[item])
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for phrase in found:
            by_length.setdefault(len(phrase), []).append(phrase)
        self.groups = []
        for length, phrases in sorted(by_length.items()):
            owners = [np.fromiter(found[p], np.int64) for p in phrases]
            starts = np.concatenate(([0], np.cumsum([len(o) for o in owners])))
            self.groups.append((np.array(phrases, np.int64).reshape(-1, length), np.concatenate(owners), starts))
        self.shortest = min(by_length, default=0)


def expand(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of ranges [start, end), with the number of the range of each."""
    sizes = ends - starts
    which = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[which], which


def search_shard(ids: np.ndarray, doc: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Search a shard's word ids (0: not a benchmark word). Returns hit flags and (document, item) pairs."""
    hit = np.zeros(len(ids), bool)
    none = np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], ids > 0, [0])).astype(np.int8)) | np.concatenate(([0], (np.diff(doc) > 0) & (ids[1:] > 0) & (ids[:-1] > 0), [0])) if len(ids) else none)
    if not len(edge):
        return hit, none, none
    starts, ends = edge[:-1], edge[1:]
    keep = (ids[starts] > 0) & (ends - starts >= phrases.shortest)
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return hit, none, none
    place, stretch = expand(starts, ends)
    # the stretch's number is also how many separators stand before it; one separator ends each stretch
    at = np.arange(len(place)) + stretch
    symbols = np.zeros(len(place) + len(starts), np.int32)
    symbols[at] = ids[place]
    back = np.zeros(len(symbols), np.int64)
    back[at] = place
    index = FMIndex(symbols)
    change = np.zeros(len(ids) + 1, np.int32)
    docs, items = [], []
    for matrix, owners, owner_starts in phrases.groups:
        low, high = index.search(matrix)
        met = np.flatnonzero(high > low)
        if not len(met):
            continue
        rows, which = expand(low[met], high[met])
        where = back[index.locate(rows)]
        np.add.at(change, where, 1)
        np.add.at(change, where + matrix.shape[1], -1)
        phrase = met[which]
        own, k = expand(owner_starts[phrase], owner_starts[phrase + 1])
        docs.append(doc[where[k]])
        items.append(owners[own])
    hit = np.cumsum(change[:-1]) > 0
    if not docs:
        return hit, none, none
    pairs = np.unique(np.stack((np.concatenate(docs), np.concatenate(items)), 1), axis=0)
    return hit, pairs[:, 0], pairs[:, 1]


def _byte_spans(text: bytes, flags: np.ndarray) -> list[list[int]]:
    """Character spans [start, end) of maximal runs of hit words."""
    spans: list[list[int]] = []
    last = -2
    places = [m.span() for m in _WORD.finditer(text)]
    for k in np.flatnonzero(flags):
        if k == last + 1:
            spans[-1][1] = places[k][1]
        else:
            spans.append(list(places[k]))
        last = k
    out, at, chars = [], 0, 0
    for a, b in spans:
        start = chars + len(text[at:a].decode())
        chars = start + len(text[a:b].decode())
        at = b
        out.append([start, chars])
    return out


#: What a scan adds to a row.
SCAN = (("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.list_(pa.int64()))), ("hits", pa.list_(pa.list_(pa.int64()))))


def scan(documents: DataFrame, phrases_of, with_spans: bool, prefix: str = "", text_col: str = "text") -> DataFrame:
    """The documents with n_words, n_hit, items and, if asked for, spans (character ranges) and hits (word ranges), under a prefix.

    Rows pass through with all their columns, so no id is needed to bring results and texts together.
    """
    at = documents.columns.index(text_col)
    schema = StructType([*documents.schema.fields, *(StructField(prefix + name, from_arrow_type(kind)) for name, kind in SCAN)])

    def shard(rows: list[pa.RecordBatch], texts: list, ids: list[np.ndarray], phrases: Phrases) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(x) for x in ids], np.int64)
        doc = np.repeat(np.arange(len(ids)), sizes)
        hit, pair_doc, pair_item = search_shard(np.concatenate(ids), doc, phrases)
        n_hit = np.bincount(doc[hit], minlength=len(ids))
        items: list[list[str]] = [[] for _ in ids]
        for d, i in zip(pair_doc.tolist(), pair_item.tolist(), strict=True):
            items[d].append(phrases.ids[i])
        spans: list = [[] for _ in ids]
        hits: list = [[] for _ in ids]
        if with_spans:
            ends = np.cumsum(sizes)
            for d in np.flatnonzero(n_hit):
                flags = hit[ends[d] - sizes[d] : ends[d]]
                hits[d] = np.flatnonzero(np.diff(np.concatenate(([0], flags, [0])).astype(np.int8))).reshape(-1, 2).tolist()
                spans[d] = _byte_spans(texts[d], flags)
        made, start = [sizes, n_hit, items, spans, hits], 0
        for part in rows:
            end = start + part.num_rows
            own = [pa.array(m[start:end], kind) for m, (_, kind) in zip(made, SCAN, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *own], names=[*part.schema.names, *(prefix + name for name, _ in SCAN)])
            start = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = phrases_of()
        look = phrases.vocabulary.get
        rows, texts, ids, held, kept = [], [], [], 0, 0
        for batch in batches:
            for part in common.text_slices(batch, at):
                rows.append(part)
                for text in common.as_bytes(part.column(at)):
                    own = [look(w, 0) for w in words_of(text or b"")]
                    ids.append(np.array(own, np.int32))
                    texts.append(text if with_spans else None)
                    held += len(text or b"")
                    kept += np.count_nonzero(ids[-1])
                if held >= SHARD_BYTES or kept >= SHARD_WORDS:
                    yield from shard(rows, texts, ids, phrases)
                    rows, texts, ids, held, kept = [], [], [], 0, 0
        if rows:
            yield from shard(rows, texts, ids, phrases)

    return documents.mapInArrow(run, schema)


def find(documents: DataFrame, benchmark: DataFrame, with_spans: bool = True, window: int = WINDOW, block_words: int = BLOCK_WORDS, prefix: str = "") -> DataFrame:
    """The documents with the hits of every benchmark window: n_words, n_hit, items, spans, under a prefix.

    The benchmark's size is measured; up to block_words words it is sent to the executors at once. A larger one is
    searched in blocks of items, one after the other over the same rows, and the blocks' ranges are united.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("text")).where("item is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(size) // (6 * block_words)))
    found = documents
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k) if blocks > 1 else items
        sent = spark.sparkContext.broadcast([(r["item"], r["text"].encode()) for r in own.toLocalIterator()])

        def phrases_of(sent=sent):
            return Phrases(sent.value, window)

        found = scan(found, phrases_of, with_spans or blocks > 1, prefix if blocks == 1 else f"{prefix}__{k}_")
    if blocks == 1:
        return found.drop(f"{prefix}hits")
    gathered = {n: F.flatten(F.array(*[F.col(f"{prefix}__{k}_{n}") for k in range(blocks)])) for n in ("items", "hits", "spans")}
    out = found.select(*documents.columns, F.col(f"{prefix}__0_n_words").alias(f"{prefix}n_words"), *[c.alias(f"{prefix}__{n}") for n, c in gathered.items()])
    return out.select(*documents.columns, f"{prefix}n_words", _covered(f"{prefix}__hits").alias(f"{prefix}n_hit"), F.array_distinct(f"{prefix}__items").alias(f"{prefix}items"), _merged(f"{prefix}__spans").alias(f"{prefix}spans"))


def _merged(col: str):
    """Union of ranges [a, b) as sorted, disjoint ranges."""
    return F.aggregate(F.array_sort(F.col(col)), F.array().cast("array<array<bigint>>"), lambda acc, r: F.when(
        (F.size(acc) > 0) & (r[0] <= F.element_at(F.element_at(acc, -1), 2)),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.array(F.element_at(F.element_at(acc, -1), 1), F.greatest(F.element_at(F.element_at(acc, -1), 2), r[1])))),
    ).otherwise(F.concat(acc, F.array(r))))


def _covered(col: str):
    return F.aggregate(_merged(col), F.lit(0).cast("bigint"), lambda n, r: n + r[1] - r[0])


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (two items or more)."""
    found = find(documents.select("doc_id", "text"), benchmark, with_spans=False)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"))


def remove(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents with every removal span cut out of the text; all other columns stay as they are.

    A span becomes one space. Documents without a hit are untouched; n_chars, if present, is renewed
    where the text changed. Rows need no id.
    """
    found = find(documents, benchmark, prefix="__d_").withColumnRenamed("__d_spans", "__spans")
    pieces = F.aggregate("__spans", F.struct(F.lit("").alias("s"), F.lit(0).cast("bigint").alias("at")), lambda acc, r: F.struct(
        F.concat(acc["s"], F.col("text").substr((acc["at"] + 1).cast("int"), (r[0] - acc["at"]).cast("int")), F.lit(" ")).alias("s"), r[1].alias("at")))
    cut = F.concat(pieces["s"], F.col("text").substr((pieces["at"] + 1).cast("int"), F.length("text")))
    changed = F.size("__spans") > 0
    out = found.withColumn("__text", F.when(changed, cut).otherwise(F.col("text")))
    cols = [F.col("__text").alias("text") if c == "text" else F.when(changed, F.length("__text").cast(t)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c, t in documents.dtypes]
    return out.select(*cols)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS win, least(len(w), 8) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
