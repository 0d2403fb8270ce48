from __future__ import annotations

from math import comb

import numpy as np
import pytest

from siftwork.llm import near_dedup


@pytest.mark.parametrize("percent", [near_dedup.PERCENT, near_dedup.KEEP_PERCENT])
def test_margin_keeps_pairs_at_the_limit(percent):
    n, p = near_dedup.TREES * near_dedup.DEPTH, percent / 100
    agree = next(k for k in range(n) if sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) > 1e-7)
    sig = np.zeros((2, n), np.uint16)
    sig[1, agree:] = 1
    ids, one = np.array([1, 2]), np.array([100, 100])
    odd = np.zeros((2, near_dedup.PARITY // 64), np.uint64)
    a, b = near_dedup._pairs_of(np.array([5, 5]), ids, ids, one, sig, odd, percent)
    assert (a.tolist(), b.tolist()) == ([1], [2])


@pytest.mark.parametrize("percent", [near_dedup.PERCENT, near_dedup.KEEP_PERCENT])
def test_parity_drops_no_link(percent):
    """Of sets around the limit, from a few shingles to many times PARITY, the sketches drop only pairs under it, and most of those far under."""
    r = np.random.default_rng(3)
    far = dropped = 0
    for size in (1, 2, 7, 60, 300, 5000, 40000):
        for share in (1.0, 0.95, 0.9, 0.85, 0.8, 0.7, 0.4):
            a = r.integers(0, 1 << 63, size).astype(np.uint64)
            b = np.concatenate((a[: max(1, round(size * share))], r.integers(0, 1 << 63, round(size * (1 - share))).astype(np.uint64)))
            both, sizes = np.intersect1d(a, b).size, np.array([a.size, b.size])
            odd = np.frombuffer(b"".join(near_dedup.parities(np.concatenate((np.sort(a), np.sort(b))), sizes)), np.uint64).reshape(2, -1)
            sig = np.zeros((2, near_dedup.TREES * near_dedup.DEPTH), np.uint16)
            kept = len(near_dedup._similar(np.array([0]), np.array([1]), sizes, sig, odd, percent)[0]) == 1
            link = 100 * both >= percent * (a.size + b.size - both)
            assert kept or not link
            if share <= 0.7 and 60 <= size <= 300:
                far, dropped = far + 1, dropped + (not kept)
    assert dropped == far


def test_parities_of_many_sets():
    """Each set has its own sketch, empty sets have none, and the batches in which they are made do not show."""
    r = np.random.default_rng(4)
    sizes = r.integers(0, 6, 3000)
    sets = r.integers(0, 1 << 63, sizes.sum()).astype(np.uint64)
    ends = np.cumsum(sizes)
    alone = [near_dedup.parities(sets[e - n : e], np.array([n]))[0] for e, n in zip(ends, sizes, strict=True) if n]
    assert near_dedup.parities(sets, sizes) == alone
