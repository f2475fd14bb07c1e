"""Words of byte strings as 64-bit hashes, vectorised: words are runs of bytes other than ASCII whitespace, A-Z lower-cased."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words longer than this are hashed one by one.
LONG = 64
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Keeps the first n bytes of a little-endian word of 8 bytes.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _C
    return h ^ (h >> np.uint64(32))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start offset, hash) of every word of ``data``, which must be lower-cased already."""
    raw = np.frombuffer(data + b" " * 16, np.uint8)
    space = _SPACE[raw]
    inside = ~space
    starts = np.flatnonzero(inside[1:] & space[:-1]) + 1
    if len(raw) and inside[0]:
        starts = np.concatenate([[0], starts])
    ends = np.flatnonzero(inside[:-1] & space[1:]) + 1
    size = ends - starts
    lanes = np.ndarray((len(raw) - 8,), "<u8", buffer=raw, strides=(1,))
    h = size.astype(np.uint64) * _A
    at = np.arange(len(starts))
    for lane in range(LONG // 8):
        at = at[size[at] > 8 * lane]
        if not len(at):
            break
        left = np.minimum(size[at] - 8 * lane, 8)
        h[at] = mix((h[at] ^ (lanes[starts[at] + 8 * lane] & _MASK[left])) * _B)
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]], 7)
    return starts, mix(h * _A)
