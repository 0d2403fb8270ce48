"""Compression-band quality rules beside basic counts.

Each text is compressed with zstandard, whole and in fixed chunks. A ratio (compressed by raw bytes)
under a lower limit marks repetition, one above an upper limit marks incompressible text; the limits
depend on the length, since short texts compress worse. A document is kept if it passes the base rules
and every ratio lies in its band.

A null text counts as empty. Empty texts have no words, fail the base rules and have null ratios.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import common

LEVEL = 3
CHUNK = 4096
#: (texts of fewer bytes than this, lowest ratio, highest ratio); the frame's header weighs on short texts. The highest
#: ratios lie between those measured of clean documents and of random letters and digits (and, from 2 KiB, of random letters).
#: Under 96 bytes clean text is as incompressible as noise (1.14 at 64 bytes, both), so there is no upper limit.
BANDS = ((96, 0.45, float("inf")), (112, 0.45, 1.025), (120, 0.45, 1.00), (128, 0.45, 0.96), (160, 0.40, 0.947), (192, 0.40, 0.90), (256, 0.40, 0.85), (384, 0.40, 0.83), (512, 0.40, 0.79), (1024, 0.38, 0.73), (2048, 0.36, 0.65), (4096, 0.34, 0.57), (8192, 0.31, 0.55), (65536, 0.27, 0.54), (float("inf"), 0.22, 0.54))
#: Limits of a chunk. A last chunk has the upper limit of its own length's band, and no lower one if under half a chunk.
CHUNK_BAND = (0.30, 0.55)

_SPACE = b" \t\n\r\x0b\x0c"
_NOT_WORD_CHARS = _SPACE + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
WINDOW = 8


def band(size: int) -> tuple[float, float]:
    return next((low, high) for limit, low, high in BANDS if size < limit)


def ratios(text: bytes, compress) -> tuple[float, float, float, bool]:
    """Ratio of the whole text, the lowest and highest of its chunks of half a chunk or more (the whole's if it has one), and whether all lie in their bands."""
    whole = len(compress(text)) / len(text)
    low, high = band(len(text))
    fine = low <= whole <= high
    if len(text) <= CHUNK:
        return whole, whole, whole, fine
    parts = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
    each = [len(compress(p)) / len(p) for p in parts]
    highest = [CHUNK_BAND[1] if len(p) == CHUNK else band(len(p))[1] for p in parts]
    full = each if len(parts[-1]) >= CHUNK // 2 else each[:-1]
    return whole, min(full), max(full), fine and CHUNK_BAND[0] <= min(full) and all(x <= h for x, h in zip(each, highest, strict=True))


def repeated_words(counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For texts of counts[k] word ids each: words in 8-word windows that the text has twice or more."""
    n = len(ids)
    if n < WINDOW:
        return np.zeros(len(counts), np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    base = common.mix64(ids.astype(np.uint64) + np.uint64(1))
    window = common.mix64(doc[: n - WINDOW + 1].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for j in range(WINDOW):
        window = window * np.uint64(0x2545F4914F6CDD1D) + base[j : n - WINDOW + 1 + j]
    at = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :])
    window = common.mix64(window[at])
    order = np.sort(window)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    found = at[np.isin(window, twice)] if len(twice) else at[:0]
    change = np.zeros(n + 1, np.int32)
    change[found] += 1
    np.add.at(change, found + WINDOW, -1)
    covered = np.cumsum(change[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(counts))


def score(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, counts, base_failed, kept, and the three ratios."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    key = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "chunk_low", "chunk_high"]
    types = [key, *[pa.int64()] * 5, pa.bool_(), pa.bool_(), *[pa.float64()] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            for part in common.text_slices(batch, 1):
                texts = [t or b"" for t in common.as_bytes(part.column(1))]
                numbers: dict[bytes, int] = {}
                number = numbers.setdefault
                counts, ids = [], []
                for t in texts:
                    words = t.split()
                    counts.append(len(words))
                    ids.append(np.fromiter((number(w, len(numbers)) for w in words), np.int64, len(words)))
                n_words = np.array(counts, np.int64)
                repeat = repeated_words(n_words, np.concatenate(ids))
                chars = [len(t.translate(None, _NOT_WORD_CHARS)) for t in texts]
                symbols = [len(t) - len(t.translate(None, _SYMBOLS)) for t in texts]
                lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
                dups = [len(x) - len(set(x)) for x in lines]
                failed = (n_words < 20) | (100 * repeat > 30 * n_words)
                found = [ratios(t, compress) if t else None for t in texts]
                kept = [not f and r is not None and r[3] for f, r in zip(failed, found, strict=True)]
                each = [[r and r[k] for r in found] for k in range(3)]
                columns = [part.column(0), n_words, chars, symbols, dups, repeat, failed, kept, *each]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return documents.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, ratio double, chunk_low double, chunk_high double")


def query(spark, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))
