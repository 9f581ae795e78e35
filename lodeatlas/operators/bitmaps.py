"""Compressed bitmaps of one container of ordinals, in the manner of roaring bitmaps.

A container holds the ordinals that are set in one of three forms, whichever is shortest: a sorted array
of places, runs of places, or packed bits. Sets are combined in packed form.
"""

from __future__ import annotations

import numpy as np

#: Ordinals of one container.
CONTAINER = 8192

_ARRAY, _RUNS, _BITS = b"a", b"r", b"b"


def compress(places: np.ndarray) -> bytes:
    """The set of distinct places, 0 to CONTAINER - 1, given in ascending order."""
    places = places.astype("<u2")
    if not len(places):
        return _ARRAY
    breaks = np.flatnonzero(np.diff(places.astype(np.int32)) != 1)
    runs = np.column_stack([places[np.r_[0, breaks + 1]], places[np.r_[breaks, len(places) - 1]]])
    sizes = {_ARRAY: 2 * len(places), _RUNS: 4 * len(runs), _BITS: CONTAINER // 8}
    form = min(sizes, key=lambda k: (sizes[k], k))
    if form == _ARRAY:
        return form + places.tobytes()
    return form + (runs.astype("<u2").tobytes() if form == _RUNS else np.packbits(_bits(places)).tobytes())


def _bits(places: np.ndarray) -> np.ndarray:
    out = np.zeros(CONTAINER, bool)
    out[places] = True
    return out


def packed(held: bytes | None) -> np.ndarray:
    """The packed bits of a compressed set; none is the empty set."""
    if not held:
        return np.zeros(CONTAINER // 8, np.uint8)
    form, data = held[:1], held[1:]
    if form == _BITS:
        return np.frombuffer(data, np.uint8)
    values = np.frombuffer(data, "<u2").astype(np.int64)
    if form == _ARRAY:
        return np.packbits(_bits(values))
    edges = np.zeros(CONTAINER + 1, np.int32)
    np.add.at(edges, values[0::2], 1)
    np.add.at(edges, values[1::2] + 1, -1)
    return np.packbits(np.cumsum(edges)[:CONTAINER] > 0)


def places(bits: np.ndarray) -> np.ndarray:
    """The places that are set in packed bits, in ascending order."""
    return np.flatnonzero(np.unpackbits(bits))
