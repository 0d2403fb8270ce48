"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order context tree over lower-cased UTF-8 bytes: counts of every byte after
each context of up to ORDER bytes. A byte's probability follows method D escapes: an unseen byte pays the
context's escape probability and falls back to the next shorter context, down to a uniform byte. Once
learned the statistics are frozen, so the code length of a text is the exact sum of its bytes' code lengths
under each language, and the language of the shortest code wins.

As the statistics are frozen, the code length of a byte depends on its last ORDER+1 bytes only. The trees
of all languages are therefore compiled into one hash table for each order: a context that some language
has seen with this byte gives the full code length for every language; else each language pays its escape
(nothing where it has not met the context) and the next shorter context is asked.

Learning takes whole texts of each language until they are SAMPLE_BYTES: those of at most SAMPLE_BYTES first, in the
order of a hash of their id, and a longer one only if these do not suffice, so the sample is bounded by SAMPLE_BYTES
and one text. Rows of null text or language are not learned from. A null text, or one without letters, is `und` with
score 0. The score is the winner's posterior under equal priors, with code lengths per byte scaled to at
most CONFIDENT bytes, so that it does not saturate at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

ORDER = 4
SAMPLE_BYTES = 400_000
CONFIDENT = 200
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_PREFIX = b"\n" * ORDER


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """Key of the last order+1 bytes at each position of data that has them (big-endian integers)."""
    n = len(data) - order
    key = np.zeros(max(n, 0), np.uint64)
    for j in range(order + 1):
        key = (key << np.uint64(8)) | data[j : j + n].astype(np.uint64)
    return key


class HashTable:
    """Open addressing from integer keys to their row number, looked up by whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys))
        at = self._home(keys)
        while len(left):
            free = self.rows[at] < 0
            # of those that want the same free slot, the last written has it
            self.rows[at[free]] = left[free]
            won = self.rows[at] == left
            self.keys[at[won]] = keys[left[won]]
            left, at = left[~won], (at[~won] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        row = self.rows[at]
        bad = np.flatnonzero((row >= 0) & (self.keys[at] != keys))
        while len(bad):
            at[bad] = (at[bad] + 1) & self.mask
            row[bad] = self.rows[at[bad]]
            bad = bad[(row[bad] >= 0) & (self.keys[at[bad]] != keys[bad])]
        return row


class Model:
    """Frozen PPM statistics of several languages."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER):
        self.languages = sorted(samples)
        self.order = order
        count = len(self.languages)
        self.tables, self.codes, self.context_tables, self.escapes = [], [], [], []
        streams = [[np.frombuffer(_PREFIX[:order] + t, np.uint8) for t in samples[x]] for x in self.languages]
        shorter: list[tuple] = []
        for k in range(order + 1):
            # from order - k on, so that each context has the same events whatever its length
            seen = [np.unique(np.concatenate([grams(s[order - k :], k) for s in own]) if own else np.zeros(0, np.uint64), return_counts=True) for own in streams]
            keys = np.unique(np.concatenate([x for x, _ in seen]))
            contexts = np.unique(keys >> np.uint64(8))
            event = np.zeros((len(keys), count))
            for c, (x, n) in enumerate(seen):
                event[np.searchsorted(keys, x), c] = n
            parent = np.searchsorted(contexts, keys >> np.uint64(8))
            total, kinds = np.zeros((len(contexts), count)), np.zeros((len(contexts), count))
            np.add.at(total, parent, event)
            np.add.at(kinds, parent, event > 0)
            # method D: half a count of each kind goes to the escape
            escape = np.where(total > 0, -np.log2(np.maximum(kinds, 1) / np.maximum(2 * total, 2)), 0.0)
            direct = -np.log2(np.maximum(2 * event - 1, 1) / np.maximum(2 * total[parent], 1))
            if k:
                below = self._code(shorter, keys & np.uint64((1 << (8 * k)) - 1), k - 1)
            else:
                below = np.full((len(keys), count), 8.0)
            code = np.where(event > 0, direct, escape[parent] + below)
            self.tables.append(HashTable(keys))
            self.context_tables.append(HashTable(contexts))
            self.codes.append(code)
            self.escapes.append(escape)
            shorter = list(zip(self.tables, self.codes, self.context_tables, self.escapes, strict=True))

    @staticmethod
    def _code(levels: list[tuple], keys: np.ndarray, k: int) -> np.ndarray:
        """Code lengths in bits of the byte that ends each key, after a context of k bytes."""
        table, codes, contexts, escapes = levels[k]
        row = table.find(keys)
        out = codes[np.maximum(row, 0)] if len(codes) else np.zeros((len(keys), codes.shape[1]), codes.dtype)
        missed = np.flatnonzero(row < 0)
        if len(missed):
            key = keys[missed]
            below = Model._code(levels, key & np.uint64((1 << (8 * k)) - 1), k - 1) if k else np.full((len(key), codes.shape[1]), 8.0)
            context = contexts.find(key >> np.uint64(8))
            out[missed] = below + np.where(context[:, None] >= 0, escapes[np.maximum(context, 0)] if len(escapes) else 0.0, 0.0)
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        levels = list(zip(self.tables, self.codes, self.context_tables, self.escapes, strict=True))
        prefix = _PREFIX[: self.order]
        joined = np.frombuffer(b"".join(prefix + t for t in texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes + self.order)[:-1]))
        step = 1 << 20
        keys_all = len(joined) - self.order
        for a in range(0, max(keys_all, 0), step):
            b = min(a + step, keys_all)
            bits = self._code(levels, grams(joined[a : b + self.order], self.order), self.order)
            # keys that begin in a text's own part; the last `order` keys of a text run into the next one's prefix
            first = np.searchsorted(starts, a, side="right") - 1
            last = np.searchsorted(starts, b, side="left")
            running = np.concatenate((np.zeros((1, bits.shape[1])), np.cumsum(bits, axis=0, dtype=np.float64)))
            lo = np.clip(starts[first:last], a, b) - a
            hi = np.clip(starts[first:last] + sizes[first:last], a, b) - a
            out[first:last] += running[hi] - running[lo]
        return out


def sample(documents: DataFrame, limit: int = SAMPLE_BYTES) -> dict[str, list[bytes]]:
    """Bounded training texts for each language: whole rows, no longer than the limit first, then in the order of a
    hash, until `limit` bytes are met.

    A whole language is never gathered: rows are first thinned by hash to a few times the limit, from
    byte totals counted over all rows; only then is the running total taken.
    """
    rows = documents.where("text is not null and lang is not null and length(text) > 0").select(
        "lang", "text", F.xxhash64(F.col("doc_id").cast("string")).alias("h"), F.least(F.octet_length("text"), F.lit(limit)).alias("n"), (F.octet_length("text") > limit).alias("long"))
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return {}
    part = 1 << 20
    share = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, min(part, int(part * 4 * limit / max(n, 1)) + part // 1000))])
    thin = rows.where(F.pmod(F.col("h"), F.lit(part)) < share[F.col("lang")])
    running = F.sum("n").over(Window.partitionBy("lang").orderBy("long", "h", "n").rowsBetween(Window.unboundedPreceding, -1))
    kept = thin.withColumn("before", F.coalesce(running, F.lit(0))).where(F.col("before") < limit).select("lang", "text")
    out: dict[str, list[bytes]] = {x: [] for x in totals}
    for r in kept.toLocalIterator():
        out[r["lang"]].append(r["text"].lower().encode())
    return {k: v for k, v in out.items() if v}


def identify(documents: DataFrame, samples: dict[str, list[bytes]]) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, bits (of the winner, per byte)."""
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    sent = spark.sparkContext.broadcast(samples)
    names = ["doc_id", "held_out", "lang_pred", "score", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(sent.value) if sent.value else None
        for batch in batches:
            for part in common.text_slices(batch, 1, 4 << 20):
                texts = part.column(1).to_pylist()
                known = [t is not None and model is not None and _LETTER.search(t) is not None for t in texts]
                data = [t.lower().encode() for t, k in zip(texts, known, strict=True) if k]
                lang, score, bits = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
                if data:
                    code = model.code_lengths(data)
                    sizes = np.array([len(t) for t in data])
                    scaled = code / sizes[:, None] * np.minimum(sizes, CONFIDENT)[:, None]
                    odds = np.exp2(scaled.min(axis=1, keepdims=True) - scaled)
                    best = code.argmin(axis=1)
                    at = np.flatnonzero(known)
                    score[at] = odds[np.arange(len(at)), best] / odds.sum(axis=1)
                    bits[at] = code.min(axis=1) / sizes
                    for i, b in zip(at, best, strict=True):
                        lang[i] = model.languages[b]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(lang), pa.array(score), pa.array(bits)], names=names)

    return documents.select("doc_id", "text", common.held_out().alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, bits double")


def query(spark, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    return identify(documents, sample(documents.where(~common.held_out())))
