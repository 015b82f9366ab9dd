"""SuperMinHash signatures: each element ranks all registers by a random permutation of its own, and a register keeps
its least (rank, fraction).

All elements of a batch go through the ranks in step. A text stops as soon as every register holds a lower rank than
the next one, which for n elements is after about ``registers * ln(registers) / n`` ranks; the result is the same as
with all ranks. The permutation is a Fisher-Yates shuffle of which the first steps are kept as traces, and which is
spelt out for the few short texts that go on.
"""

from __future__ import annotations

import numpy as np

from casagrid.llm.words import ROLE, mixed

FRACTION_BITS = 22
TRACED = 12
GOLD = np.uint64(0x9E3779B97F4A7C15)


def signatures(elements: np.ndarray, begin: np.ndarray, registers: int) -> np.ndarray:
    """One row of ``registers`` 32-bit values per text; texts without elements keep the largest value everywhere."""
    if registers >= 1 << (32 - FRACTION_BITS):
        raise ValueError("too many registers")
    n = np.diff(begin)
    out = np.full((len(n), registers), 0xFFFFFFFF, np.uint32)
    flat = out.reshape(-1)
    text = np.repeat(np.arange(len(n)), n)
    seed = elements
    steps: list[np.ndarray] = []
    order = None
    for rank in range(registers):
        if not len(text):
            break
        draw = mixed(seed + GOLD * np.array([rank + 1], np.uint64))
        pick = (rank + (((draw >> np.uint64(32)) * np.uint64(registers - rank)) >> np.uint64(32)).astype(np.int64)).astype(np.int32)
        if order is None:
            place = pick.copy()
            for t in range(rank - 1, -1, -1):
                place[steps[t] == place] = t
            steps.append(pick)
        else:
            rows = np.arange(len(text))
            place = order[rows, pick].astype(np.int32)
            order[rows, pick] = order[rows, rank]
        at = text * registers + place
        free = flat[at] > np.uint32((rank << FRACTION_BITS) - 1 if rank else 0)
        value = (np.uint64(rank) << np.uint64(FRACTION_BITS)) | (draw & np.uint64((1 << FRACTION_BITS) - 1))
        np.minimum.at(flat, at[free], value[free].astype(np.uint32))
        live = np.unique(text)
        done = np.zeros(len(n), bool)
        done[live] = out[live].max(axis=1) < ((rank + 1) << FRACTION_BITS)
        if done.any():
            stay = ~done[text]
            text, seed = text[stay], seed[stay]
            steps = [s[stay] for s in steps] if order is None else steps
            order = order[stay] if order is not None else None
        if order is None and rank + 1 == TRACED:
            order = np.tile(np.arange(registers, dtype=np.uint16), (len(text), 1))
            rows = np.arange(len(text))
            for t, pick in enumerate(steps):
                order[rows, pick] = order[rows, t]
    return out


def band_keys(rows: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = rows.reshape(len(rows), bands, -1).astype(np.uint64)
    total = np.zeros(parts.shape[:2], np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * GOLD
    for j in range(parts.shape[2]):
        total = mixed(total + parts[:, :, j] * ROLE[30 + j % 30])
    return total.view(np.int64)
