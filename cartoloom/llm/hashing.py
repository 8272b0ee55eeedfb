"""Polynomial hashes of byte strings, modulo 2^64."""

from __future__ import annotations

import numpy as np

BASE = 0xD6E8FEB86659FD93
BACK = pow(BASE, -1, 1 << 64)

_tables: dict[int, np.ndarray] = {}


def power_table(base: int, n: int) -> np.ndarray:
    """Powers of a base modulo 2^64, one for each place of the longest text so far."""
    table = _tables.get(base, np.ones(1, np.uint64))
    if len(table) < n:
        more = np.empty(1 << (n - 1).bit_length(), np.uint64)
        have = len(table)
        more[:have] = table
        while have < len(more):
            more[have : 2 * have] = more[:have] * np.uint64(pow(base, have, 1 << 64))
            have *= 2
        _tables[base] = table = more
    return table[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the low bits' entropy over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each place on."""
    n = len(data) - k + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power_table(BASE, len(data)), out=sums[1:])
    return mixed((sums[k:] - sums[:n]) * power_table(BACK, n))
