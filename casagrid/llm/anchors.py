"""Positions in texts that depend on content alone, so that equal byte strings hold them at equal places.

Of all windows of ``window`` bytes, each belongs to one anchor: the place inside it where the hash of ``gram`` bytes is
least, the leftmost among equals. Equal windows have their anchor at the same offset. The windows of an anchor begin at
consecutive bytes.
"""

from __future__ import annotations

import numpy as np

from casagrid.llm.words import mixed

_random = np.random.default_rng(77)
BYTE = _random.integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.array([0xD1342543DE82EF95], np.uint64)
PLACE_BITS = 24


def _power(n: int) -> np.ndarray:
    out, base = np.ones(1, np.uint64), BASE
    while n:
        if n & 1:
            out = out * base
        base, n = base * base, n >> 1
    return out


def window_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive bytes, by doubling."""
    if len(raw) < size:
        return np.zeros(0, np.uint64)
    have, span, out, done = BYTE[raw], 1, None, 0
    rest = size
    while rest:
        if rest & 1:
            out = have if out is None else out[: len(out) - span] * _power(span) + have[done:]
            done += span
        rest >>= 1
        if rest:
            have = have[:-span] * _power(span) + have[span:]
            span *= 2
        if out is not None and len(out) > len(raw) - done + 1:
            out = out[: len(raw) - done + 1]
    return out[: len(raw) - size + 1]


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` consecutive values."""
    have, span = values, 1
    while span * 2 <= size:
        have = np.minimum(have[:-span], have[span:])
        span *= 2
    if span < size:
        have = np.minimum(have[: len(values) - size + 1], have[size - span : size - span + len(values) - size + 1])
    return have[: len(values) - size + 1]


def anchors(raw: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For one text: key (hash of the gram), first window, number of windows, and place of each anchor."""
    if len(raw) < window:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    grams = mixed(window_hashes(raw, gram))
    if len(raw) >= 1 << PLACE_BITS:
        return _long(grams, window, gram, len(raw))
    mask = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_least((grams & ~mask) | np.arange(len(grams), dtype=np.uint64), window - gram + 1)
    at = (least & mask).astype(np.int64)
    begin = np.flatnonzero(np.diff(at, prepend=-1))
    return grams[at[begin]], begin, np.diff(begin, append=len(at)), at[begin]


def _long(grams: np.ndarray, window: int, gram: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A text too long for packed places, in overlapping parts."""
    size, mask, parts = (1 << PLACE_BITS) - window, np.uint64((1 << PLACE_BITS) - 1), []
    for lo in range(0, n - window + 1, size):
        own = grams[lo : lo + size + window - gram]
        least = sliding_least((own & ~mask) | np.arange(len(own), dtype=np.uint64), window - gram + 1)
        parts.append((least & mask).astype(np.int64) + lo)
    at = np.concatenate(parts)
    begin = np.flatnonzero(np.diff(at, prepend=-1))
    return grams[at[begin]], begin, np.diff(begin, append=len(at)), at[begin]
