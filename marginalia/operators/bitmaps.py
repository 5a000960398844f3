"""Compressed bitmap containers over 2^16 integer keys.

A container is one tag byte and a body: sorted 16-bit values while there are few,
else a plain bitmap of 8 KiB. Both forms hold the same set.
"""

from __future__ import annotations

import numpy as np

SPAN_BITS = 16
SPAN = 1 << SPAN_BITS
_ARRAY, _BITMAP = b"\x00", b"\x01"
_MOST_IN_ARRAY = SPAN // 16


def encode(values) -> bytes:
    """Container of a set of integers 0..65535; an empty set gives an empty array container."""
    v = np.unique(np.asarray(values, dtype=np.uint16))
    if len(v) < _MOST_IN_ARRAY:
        return _ARRAY + v.tobytes()
    bits = np.zeros(SPAN, dtype=bool)
    bits[v] = True
    return _BITMAP + np.packbits(bits).tobytes()


def words(container: bytes) -> np.ndarray:
    """The container as 64-bit words."""
    if container[:1] == _BITMAP:
        return np.frombuffer(container, dtype=np.uint8, offset=1).view(np.uint64).copy()
    bits = np.zeros(SPAN, dtype=bool)
    bits[np.frombuffer(container, dtype=np.uint16, offset=1)] = True
    return np.packbits(bits).view(np.uint64)


def decode(w: np.ndarray) -> np.ndarray:
    """Positions of the set bits, ascending."""
    return np.flatnonzero(np.unpackbits(w.view(np.uint8))).astype(np.int32)


def empty() -> np.ndarray:
    return np.zeros(SPAN // 64, dtype=np.uint64)
