"""Content anchors: where a long repeat can be, found without comparing everything.

A window of ``width`` tokens is keyed by the least hash among its grams of
``gram`` tokens. The key depends on the window's content alone, so equal windows
have equal keys, and neighbouring windows mostly share theirs: a text falls into
runs of windows with one key.
"""

from __future__ import annotations

import numpy as np

# Fixed multipliers of a published 64-bit mixing function.
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def byte_hashes(b: bytes) -> np.ndarray:
    return _BYTE[np.frombuffer(b, dtype=np.uint8)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, ``n`` at least."""
    if len(_POWERS[0]) < n:
        size = 1 << max(16, n.bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[k] = np.concatenate([np.ones(1, np.uint64), np.full(size, base, np.uint64)]).cumprod()
    return _POWERS


def word_hashes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words ``text[start:end]``, from prefix sums of one polynomial over the text."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(text) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte_hashes(text) * power[:len(text)])])
    return mixed((total[ends] - total[starts]) * inverse[starts])


def _grams(h: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all grams; ``gram`` is a power of two."""
    step, factor = 1, 0x9E3779B97F4A7C15
    while step < gram:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor = factor * factor & 0xFFFFFFFFFFFFFFFF
        step *= 2
    return mixed(h)


def _sliding(a: np.ndarray, size: int, best) -> np.ndarray:
    span = 1
    while span * 2 <= size:
        a = best(a[:-span], a[span:])
        span *= 2
    return best(a[:len(a) - (size - span)], a[size - span:]) if size > span else a


def keys_of_windows(h: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """``(gram hashes, key of each window)``; both empty for fewer tokens than a window."""
    if len(h) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    g = _grams(h, gram)
    return g, _sliding(g, width - gram + 1, np.minimum)


def anchor_keys(h: np.ndarray, width: int, gram: int) -> np.ndarray:
    """The key of each gram that is the least of some window, one entry a place: windows that repeat have keys that are here at least twice."""
    g, keys = keys_of_windows(h, width, gram)
    if not len(keys):
        return keys
    pad = np.zeros(width - gram, np.uint64)
    return g[_sliding(np.concatenate([pad, keys, pad]), width - gram + 1, np.maximum) == g]


def runs(h: np.ndarray, width: int, gram: int, longest: int = 1_024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first window, number of windows, key)`` of the runs, cut at ``longest``; they cover every window once."""
    _, keys = keys_of_windows(h, width, gram)
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), keys
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(start, len(keys)))
    if size.max() > longest:
        pieces = -(-size // longest)
        at = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, size = np.repeat(start, pieces) + at * longest, np.minimum(np.repeat(size, pieces) - at * longest, longest)
    return start, size, keys[start]
