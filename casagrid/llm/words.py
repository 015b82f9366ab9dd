"""Words and word shingles of whole texts as 64-bit hashes, a batch of texts at a time in numpy.

A word is a run of bytes other than space and the control characters 9 to 13; A-Z count as a-z.
"""

from __future__ import annotations

import numpy as np

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For words without marks: every ASCII byte but letters and digits parts them.
IS_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_random = np.random.default_rng(20240501)
LETTER = _random.integers(1, 2**63, 256).astype(np.uint64)[LOWER] | np.uint64(1)
SPAN = 1 << 16
with np.errstate(over="ignore"):
    POWER = np.cumprod(np.full(SPAN, 0x9E3779B97F4A7C15, np.uint64))
ROLE = _random.integers(1, 2**63, 64).astype(np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(raw: np.ndarray, at: np.ndarray, parts: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of words in ``raw``, and the first word of each text (with the number of words last)."""
    letter = ~parts[raw]
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[at[:-1]] = True
    before = np.concatenate([[False], letter[:-1]]) if len(raw) else letter
    starts = np.flatnonzero(letter & (fresh[:-1] | ~before))
    after = np.concatenate([letter[1:], [False]]) if len(raw) else letter
    fresh[at[1:]] = True
    ends = np.flatnonzero(letter & (fresh[1:] | ~after)) + 1
    return starts, ends - starts, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, at: np.ndarray, parts: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and the first word of each text (with the number of words last)."""
    starts, sizes, first = word_spans(raw, at, parts)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    spans = np.diff(starts, append=len(raw))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, spans)
    weight = POWER[place & (SPAN - 1)]
    if sizes.max() > SPAN:
        weight = weight * (2 * (place // SPAN) + 1).astype(np.uint64)
    letters = np.where(parts, np.uint64(0), LETTER)
    total = np.add.reduceat(letters[raw[starts[0] :]] * weight, starts - starts[0])
    return mixed(total + sizes.astype(np.uint64)), first


def shingle_sets(raw: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, one text after the other, and where each text's begin.

    A text with fewer than ``size`` words has its whole sequence as one shingle, a text without words has none.
    """
    words, first = word_hashes(raw, at)
    counts = np.diff(first)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(n)), n)
    head = first[text] + np.arange(begin[-1]) - begin[text]
    length = np.minimum(counts, size)[text]
    total = ROLE[10 + length].copy()
    for j in range(size):
        has = length > j
        total[has] += mixed(words[head[has] + j] + ROLE[j]) * ROLE[20 + j]
    total = mixed(total)
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        total[a:b].sort()
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (text[1:] != text[:-1])
    kept = np.concatenate([[0], np.cumsum(new)])
    return total[new], kept[begin]


def sums_by_text(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sum (mod 2^64) of each text's values."""
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return running[begin[1:]] - running[begin[:-1]]
