"""Hashed terms of whole texts, many texts at once."""

from __future__ import annotations

import numpy as np

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_POWERS = np.full(4096, 0x9E3779B97F4A7C15, np.uint64)
_POWERS[0] = 1
_POWERS = np.cumprod(_POWERS, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of runs of ASCII letters, digits and all bytes beyond ASCII."""
    edge = np.diff(_IN_WORD[data].astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefixes: tuple[int, ...] = ()) -> list[np.ndarray]:
    """64-bit hashes of the words, A-Z folded, and of their first bytes for each of ``prefixes`` (0 where the word is not longer)."""
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in (0, *prefixes)]
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    place = np.arange(total) - np.repeat(first, lengths)
    weighted = (_FOLD[data[place + np.repeat(starts, lengths)]].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 4095]
    out = [mixed(np.add.reduceat(weighted, first))]
    for p in prefixes:
        head = np.where(place < p, weighted, np.uint64(0))
        out.append(np.where(lengths > p, mixed(np.add.reduceat(head, first) + np.uint64(p)), np.uint64(0)))
    return out


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of rows [bounds[i], bounds[i + 1]); empty ranges give 0."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full], axis=0)
    return out


def distinct_terms(data: np.ndarray, offsets: np.ndarray, bits: int, prefixes: tuple[int, ...] = (4, 5)) -> tuple[np.ndarray, np.ndarray]:
    """(term numbers below 2**bits in order within each text, bounds): the distinct hashed words and word beginnings of each text."""
    lo = offsets[0]
    starts, ends = word_bounds(data[lo : offsets[-1]])
    # a run over the seam of two texts is cut there
    seams = offsets[1:-1] - lo
    at = np.searchsorted(starts, seams, "right") - 1
    cut = np.unique(seams[(at >= 0) & (ends[np.maximum(at, 0)] > seams) & (starts[np.maximum(at, 0)] < seams)]) if len(starts) and len(seams) else seams[:0]
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    owner = np.searchsorted(offsets - lo, starts, "right") - 1
    keys = []
    for h in word_hashes(data[lo : offsets[-1]], starts, ends, prefixes):
        use = h != 0
        keys.append((owner[use].astype(np.uint64) << np.uint64(bits)) | (h[use] >> np.uint64(64 - bits)))
    keys = np.unique(np.concatenate(keys))
    bounds = np.searchsorted(keys, np.arange(len(offsets), dtype=np.uint64) << np.uint64(bits))
    return (keys & np.uint64((1 << bits) - 1)).astype(np.int64), bounds
