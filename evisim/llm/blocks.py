"""Pigeonhole blocks of 64-bit fingerprints."""

from __future__ import annotations

from itertools import combinations

#: Fingerprints of one value of blocks that are still compared directly.
LOAD = 64


def choices(n: int, distance: int) -> list[int]:
    """Masks of fingerprint bits such that any two that differ in `distance` bits agree under one of them.

    Of m blocks m - distance agree; m is the least for which n fingerprints leave LOAD or fewer to a value of so many blocks.
    """
    m = distance + 1
    while 64 * (m - distance) // m < 16 or n > LOAD << (64 * (m - distance) // m):
        m += 1
        if m > 16:
            raise ValueError(f"blocks don't find differences of {distance} bits among {n} fingerprints")
    cuts = [64 * k // m for k in range(m + 1)]
    blocks = [(1 << cuts[k + 1]) - (1 << cuts[k]) for k in range(m)]
    return [sum(c) for c in combinations(blocks, m - distance)]


def signed(mask: int) -> int:
    """A mask as SQL's long."""
    return mask - (1 << 64) if mask >> 63 else mask
