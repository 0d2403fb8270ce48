from __future__ import annotations

import random
import string

import pytest
import zstandard

from siftwork.llm import quality_rules

from .conftest import prose

COMPRESS = zstandard.ZstdCompressor(level=quality_rules.LEVEL).compress


def noise(r: random.Random, size: int, letters: str) -> bytes:
    return " ".join("".join(r.choices(letters, k=r.randrange(3, 10))) for _ in range(size // 4 + 9))[:size].encode()


@pytest.mark.parametrize("size", [100, 120, 130, 191, 192, 255, 256, 511, 512, 1023, 1024, 2047, 2048, 4095, 4096, 8191, 8192, 20_000, 70_000])
def test_random_letters_and_digits_are_over_the_limit(size):
    r = random.Random(size)
    for _ in range(20):
        assert not quality_rules.ratios(noise(r, size, string.ascii_letters + string.digits), COMPRESS)[3]
        assert size < 2048 or not quality_rules.ratios(noise(r, size, string.ascii_lowercase), COMPRESS)[3]


@pytest.mark.parametrize("tail", [400, 1000, 1900, 3000])
def test_a_last_chunk_of_noise_is_seen(tail):
    r = random.Random(tail)
    text = prose(r, 9000, 3000).encode()[: 10 * quality_rules.CHUNK]
    assert quality_rules.ratios(text, COMPRESS)[3]
    assert not quality_rules.ratios(text + noise(r, tail, string.ascii_letters + string.digits), COMPRESS)[3]
