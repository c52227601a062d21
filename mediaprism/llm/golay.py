"""The perfect binary Golay code [23, 12, 7] as a fuzzy hash of 23-bit words.

Every word is at distance 3 or less from exactly one codeword (its *narrow* key).  Its *wide* keys are the codewords at
distance 4 or less, at most six.  If two words differ in at most one bit, the narrow key of either is a wide key of the
other: the nearest codeword of the first is at distance 3 or less from it, so at 4 or less from the second.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, CHECKS = 23, 11
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the code.
GENERATOR = 0b101011100011


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits, and for each syndrome its error patterns of weight up to 4,
    lightest first, filled up with -1."""
    low = np.array([_remainder(x) for x in range(1 << 12)], dtype=np.int64)
    high = np.array([_remainder(x << 12) for x in range(1 << 11)], dtype=np.int64)
    errors: list[list[int]] = [[] for _ in range(1 << CHECKS)]
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            word = sum(1 << b for b in bits)
            errors[low[word & 0xFFF] ^ high[word >> 12]].append(word)
    most = max(map(len, errors))
    return low, high, np.array([x + [-1] * (most - len(x)) for x in errors], dtype=np.int64)


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Narrow keys (n) and wide keys (n, 6; -1 where there are fewer) as 12-bit codeword numbers."""
    low, high, errors = tables()
    words = words.astype(np.int64) & ((1 << LENGTH) - 1)
    near = errors[low[words & 0xFFF] ^ high[words >> 12]]
    wide = np.where(near >= 0, (words[:, None] ^ near) >> CHECKS, -1)
    return wide[:, 0], wide
