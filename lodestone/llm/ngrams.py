"""Hashed character n-grams as numpy arrays, block by block, for texts of any length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters hashed at once.
BLOCK = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def hashed(cp: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """For each block and size, the bucket (below 2**bits) of every n-gram; no n-gram is lost between blocks."""
    most = max(sizes)
    shift = np.uint64(64 - bits)
    for at in range(0, len(cp), BLOCK):
        part = cp[at : at + BLOCK + most - 1].astype(np.uint64) + np.uint64(1)
        rolling = np.zeros(len(part), np.uint64)
        for n in range(1, most + 1):
            if len(part) < n:
                break
            rolling = (rolling[: len(part) - n + 1] * _STEP) ^ part[n - 1 :]
            if n in sizes:
                own = rolling[: min(BLOCK, len(rolling))]
                yield (((own + np.uint64(n)) * _ODD) >> shift).astype(np.int64)
