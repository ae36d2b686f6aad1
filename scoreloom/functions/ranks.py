"""Places of rows within their shard, by arithmetic on row numbers.

A row's shard is a range of ``factor * row_id mod modulus``. How many of the first n multiples lie in a
range is a sum of quotients, which Euclid's algorithm gives in some forty steps, the same for all rows.
"""

from __future__ import annotations

import numpy as np

# Multipliers of the rounds of the permutation.
MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def quotient_sums(n: np.ndarray, modulus: int, factor: int, offset: np.ndarray) -> np.ndarray:
    """Sum of ``(factor * i + offset) // modulus`` over i from 0 to n - 1, for arrays ``n`` and ``offset`` below 2^31."""
    n, offset, total = n.astype(np.int64), offset.astype(np.int64), np.zeros(len(n), dtype=np.int64)
    while n.any():
        total += n * (n - 1) // 2 * (factor // modulus) + n * (offset // modulus)
        factor, offset = factor % modulus, offset % modulus
        top = factor * n + offset
        if not factor:
            break
        # The same lattice points, counted along the other axis.
        n, offset = top // modulus, top % modulus
        modulus, factor = factor, modulus
    return total


def multiples_within(n: np.ndarray, low: np.ndarray, high: np.ndarray, modulus: int, factor: int) -> np.ndarray:
    """How many i below n have ``factor * i mod modulus`` from ``low`` to ``high - 1``; the factor has no divisor in common with the modulus."""
    cycles, rest = n // modulus, n % modulus
    some = quotient_sums(rest, modulus, factor, modulus - low) - quotient_sums(rest, modulus, factor, modulus - high)
    return cycles * (high - low) + some


def permuted(rank: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A permutation of 0..size-1 for each key, applied to ``rank``: Feistel rounds over the next even number of bits, repeated until the value is inside."""
    half = np.maximum((np.ceil(np.log2(np.maximum(size, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2), np.uint64(1))
    mask, value = (np.uint64(1) << half) - np.uint64(1), rank.astype(np.uint64)
    outside = np.ones(len(value), dtype=bool)
    while outside.any():
        left, right = value[outside] >> half[outside], value[outside] & mask[outside]
        for k, m in enumerate(MIX):
            mixed = (right + key[outside] + np.uint64(k)) * np.uint64(m)
            mixed ^= mixed >> np.uint64(15)
            mixed *= np.uint64(MIX[(k + 1) % len(MIX)])
            left, right = right, left ^ ((mixed >> np.uint64(13)) & mask[outside])
        value[outside] = (left << half[outside]) | right
        outside = value >= size.astype(np.uint64)
    return value.astype(np.int64)
