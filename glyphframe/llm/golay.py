"""Fuzzy hashing with the binary Golay code of length 23.

The code is perfect: every word of 23 bits is within 3 bits of exactly one codeword.  A word
gets the index of that codeword and, if it is exactly 3 bits away, the indices of the five
codewords at 4 bits.  Two words at most 2 bits apart then have an index in common:

* if one is within 2 bits of its codeword, the other is within 4 bits of that codeword;
* else both are 3 bits from their own, and for the bits ``i`` and ``j`` in which they differ,
  the codeword at 4 bits from the first that undoes ``i`` is 4 or fewer bits from the second.

All tables follow from the generator polynomial.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH, CHECK = 23, 11
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GENERATOR = 0b110001110101
#: Greatest number of indices of a word.
MOST = 6


def remainder(word: int) -> int:
    """``word`` modulo the generator polynomial."""
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK)
    return word


_known: list = []


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the upper 12 bits; by syndrome the nearest error, and the errors of 4 bits after one of 3 (else 0)."""
    if _known:
        return _known[0]
    high = np.array([remainder(x << CHECK) for x in range(1 << (LENGTH - CHECK))], dtype=np.int64)
    unit = [remainder(1 << i) for i in range(LENGTH)]
    nearest = np.zeros(1 << CHECK, dtype=np.int64)
    weight = np.zeros(1 << CHECK, dtype=np.int64)
    for n in (1, 2, 3):
        for bits in combinations(range(LENGTH), n):
            s = 0
            for b in bits:
                s ^= unit[b]
            nearest[s], weight[s] = sum(1 << b for b in bits), n
    fours: dict[int, list[int]] = {}
    for bits in combinations(range(LENGTH), 4):
        s = unit[bits[0]] ^ unit[bits[1]] ^ unit[bits[2]] ^ unit[bits[3]]
        if weight[s] == 3:
            fours.setdefault(s, []).append(sum(1 << b for b in bits))
    further = np.zeros((1 << CHECK, MOST - 1), dtype=np.int64)
    for s, errors in fours.items():
        further[s, : len(errors)] = errors
    _known.append((high, nearest, further))
    return high, nearest, further


def indices(words: np.ndarray) -> np.ndarray:
    """Codeword indices of 23-bit words: (n, MOST), filled up with -1."""
    high, nearest, further = tables()
    syndrome = high[words >> CHECK] ^ (words & ((1 << CHECK) - 1))
    first = (words ^ nearest[syndrome]) >> CHECK
    errors = further[syndrome]
    rest = np.where(errors > 0, (words[:, None] ^ errors) >> CHECK, -1)
    return np.concatenate([first[:, None], rest], axis=1)
