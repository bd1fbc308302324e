"""Sampled suffixes of a block of texts: the minimizers of all windows of a fixed length.

Every window of ``length`` bytes chooses the ``gram`` bytes with the smallest hash inside it (the leftmost on ties).
Equal windows choose at equal offsets, so any string of ``length`` bytes that occurs twice shares a chosen place.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.textbytes import U64, Block, powers

GRAM = 40


def window_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, from running minima of runs of w."""
    n = len(x) - w + 1
    if n <= 0:
        return np.empty(0, x.dtype)
    full = -(-len(x) // w) * w
    p = np.full(full, np.iinfo(x.dtype).max, x.dtype)
    p[: len(x)] = x
    p = p.reshape(-1, w)
    before = np.minimum.accumulate(p, axis=1).ravel()
    after = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def sampled(block: Block, length: int, gram: int = GRAM):
    """(text, place, first start, last start) of each chosen place: it serves the windows that start from the first to the last."""
    data, offs = block.data, block.offsets
    none = (np.empty(0, np.int64),) * 4
    if len(data) < length:
        return none
    p = block.prefix(False)
    _, inv = powers(len(data) + 1)
    n = len(data) - gram + 1
    rank = (p[gram:] - p[:n]) * inv[:n]
    rank ^= rank >> U64(29)
    rank *= U64(0xBF58476D1CE4E5B9)
    # The rank's upper half decides, then the place.
    rank &= U64(0xFFFFFFFF00000000)
    rank |= np.arange(n, dtype=U64)
    least = window_minimum(rank, length - gram + 1)
    sizes = np.diff(offs)
    fits = np.flatnonzero(sizes >= length)
    if not len(fits):
        return none
    counts = sizes[fits] - length + 1
    starts = np.repeat(offs[fits] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(int(counts.sum()))
    at = (least[starts] & U64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    place = at[first]
    return np.searchsorted(offs, place, "right") - 1, place, starts[first], starts[last]
