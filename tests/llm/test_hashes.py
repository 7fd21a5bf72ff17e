"""Rabin-Karp hashes against strings that defeat a modulus that is a power of two."""

import numpy as np
import pytest

from sigloom.llm import common as c


def thue_morse(n):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return bytes(97 + x for x in bits), bytes(98 - x for x in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_complementary_words_differ(n):
    one, other = thue_morse(n)
    a, b, again = c.Words([one, other, one]).hash
    assert a == again != b


@pytest.mark.parametrize("n", [1024, 4096])
def test_complementary_windows_of_words_and_bytes_differ(n):
    pair = thue_morse(n)
    first, second = (c.Words([b" ".join(bytes([x]) for x in t)]) for t in pair)
    assert first.windows(n)[1][0] != second.windows(n)[1][0]
    raw = np.frombuffer(b"".join(pair) + pair[0], np.uint8)
    sums = c.prefix_sums(c._TABLE[raw], c.BYTE_BASE)
    at = np.array([0, n, 2 * n])
    h = c.spans_hash(sums, at, at + n, c.BYTE_BASE)
    assert h[0] == h[2] != h[1]


def test_products_and_sums_modulo_the_prime():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, c.PRIME, (2, 40_000), dtype=np.uint64)
    a[:3], b[:3] = [0, c.PRIME - 1, c.PRIME - 1], [5, c.PRIME - 1, 1]
    assert c.times(a, b).tolist() == [x * y % c.PRIME for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    up = c.powers(c.WORD_BASE, 40_000)[2].tolist()
    assert up[:500] == [pow(c.WORD_BASE, i, c.PRIME) for i in range(500)]
    values = rng.integers(0, 1 << 64, 40_000, dtype=np.uint64)
    total = 0
    for v, u, s in zip(values.tolist(), up, c.prefix_sums(values, c.WORD_BASE)[1][1:].tolist(), strict=True):
        total = (total + v * u) % c.PRIME
        assert s == total
