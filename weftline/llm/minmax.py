"""Min-max hashing: of each permutation both the least and the greatest value are kept.

One pass of h permutations gives 2 h signature values, each equal between two sets
with a chance of their Jaccard similarity, for half the hash evaluations of plain
MinHash. Values are cut into bands; a band's key is a 64-bit hash of its values.
"""

from __future__ import annotations

import numpy as np

from .words import U, mix

_random = np.random.default_rng(77001)
MULTIPLY = _random.integers(0, 2**64, 512, dtype=U) | U(1)
ADD = _random.integers(0, 2**64, 512, dtype=U)
FOLD = _random.integers(0, 2**64, 64, dtype=U) | U(1)


def signatures(hashes: np.ndarray, offsets: np.ndarray, permutations: int, after: int = 0) -> np.ndarray:
    """2 x permutations values for each row, by the permutations that follow the first ``after``; rows must not be empty."""
    out = np.empty((len(offsets) - 1, 2 * permutations), np.uint32)
    first = offsets[:-1]
    for p in range(permutations):
        v = ((hashes * MULTIPLY[after + p] + ADD[after + p]) >> U(32)).astype(np.uint32)
        out[:, 2 * p] = np.minimum.reduceat(v, first)
        out[:, 2 * p + 1] = np.maximum.reduceat(v, first)
    return out


def band_keys(values: np.ndarray, bands: int, width: int, after: int = 0) -> np.ndarray:
    """A key for each row and band, as signed 64-bit numbers; bands are told apart by numbers above ``after``."""
    out = np.empty((len(values), bands), U)
    for b in range(bands):
        key = np.full(len(values), after + b + 1, U)
        for j in range(width):
            key += values[:, b * width + j].astype(U) * FOLD[j]
            key = mix(key)
        out[:, b] = key
    return out.view(np.int64)
