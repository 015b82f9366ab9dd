"""A convolutional text classifier: hashed word embeddings, filters of several widths, max pooling, trained in numpy.

Words are runs of letters and digits; their 64-bit hash picks a row of the embedding table. Words in fewer than
``LEAST_TEXTS`` training texts have no row of their own: they share row 0, which stays zero. A filter of width w sums w word
vectors, each by its own weights; a text's feature is the filter's greatest value anywhere in the text (0 at least), so
texts of any length are read whole. An embedding begins with how far the word's share of positive texts is from chance,
beyond what chance gives among many words; a word that training has not seen changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from casagrid.llm.words import IS_MARK, word_hashes

SLOTS_LOG2 = 20
LEAST_TEXTS = 5
MOST_WORDS = 1 << 16
CHANCE = 3.0  # standard deviations


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(raw, at, IS_MARK)


def lean(texts: list[np.ndarray], labels: np.ndarray, words: HashedWords) -> np.ndarray:
    """How many standard deviations each row's number of positive texts is from its expectation."""
    rows = [np.unique(words.rows(t)) for t in texts]
    n, hits = np.zeros(len(words.hashes)), np.zeros(len(words.hashes))
    for own, label in zip(rows, labels, strict=True):
        n[own] += 1
        hits[own] += label
    share = labels.mean() if len(labels) else 0.5
    return (hits - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 0.25))


class HashedWords:
    """Rows of word hashes: a slot by the leading bits, and the whole hash compared there."""

    def __init__(self, texts: list[np.ndarray]):
        every = np.concatenate([np.zeros(0, np.uint64), *map(np.unique, texts)])
        words, texts_with = np.unique(every, return_counts=True)
        known = np.flatnonzero(texts_with >= LEAST_TEXTS)
        known = known[np.argsort(texts_with[known], kind="stable")][-MOST_WORDS:]  # of words in one slot the more frequent stays
        self.slots = np.zeros(1 << SLOTS_LOG2, np.int32)
        self.slots[words[known] >> np.uint64(64 - SLOTS_LOG2)] = np.arange(1, len(known) + 1)
        self.hashes = np.concatenate([np.zeros(1, np.uint64), words[known]])

    def rows(self, words: np.ndarray) -> np.ndarray:
        row = self.slots[words >> np.uint64(64 - SLOTS_LOG2)]
        return np.where(self.hashes[row] == words, row, 0)


@dataclass
class TextCnn:
    words: HashedWords
    embedding: np.ndarray  # (rows of words, dim)
    filters: list[np.ndarray]  # of width w: (w, dim, count)
    bias: np.ndarray  # of the filters, one after the other
    weight: np.ndarray
    offset: float
    scale: float = 1.0
    shift: float = 0.0

    def tables(self) -> list[np.ndarray]:
        """What each row gives to each filter at each place: (w, rows, count)."""
        return [np.einsum("vd,wdc->wvc", self.embedding, f) for f in self.filters]

    def pooled(self, ids: np.ndarray, first: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Greatest value of each filter in each text, and the word at which it begins (-1: no word or below 0)."""
        n = np.diff(first)
        features, places = [], []
        has = n > 0
        text = np.repeat(np.arange(len(n)), n)
        end = first[1:][text]
        for table in tables:
            out = table[0][ids]
            for j in range(1, len(table)):
                inside = np.flatnonzero(np.arange(len(ids)) + j < end)
                out[inside] += table[j][ids[inside + j]]
            most = np.full((len(n), out.shape[1]), -np.inf, out.dtype)
            place = np.full(most.shape, -1)
            if len(ids):
                most[has] = np.maximum.reduceat(out, first[:-1][has], axis=0)
            features.append(most)
            if self.training:
                for c in range(out.shape[1]):
                    at = np.flatnonzero(out[:, c] == most[text, c])[::-1]
                    place[text[at], c] = at
            places.append(place)
        features, places = np.concatenate(features, axis=1), np.concatenate(places, axis=1)
        features[~has] = -1e9
        return features, places

    training: bool = False

    def logits_of(self, words: np.ndarray, first: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        return self.logits(self.words.rows(words), first, tables)

    def logits(self, ids: np.ndarray, first: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        features, _ = self.pooled(ids, first, tables or self.tables())
        return np.maximum(features + self.bias, 0) @ self.weight + self.offset

    def scores(self, words: np.ndarray, first: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        x = self.logits_of(words, first, tables).astype(np.float64) * self.scale + self.shift
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gather(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.uint64), *texts]), np.cumsum([0, *map(len, texts)])


def train(texts: list[np.ndarray], labels: np.ndarray, dim: int = 12, widths: tuple[int, ...] = (1, 2, 3), count: int = 6, epochs: int = 4, batch: int = 64, rate: float = 0.01, word_rate: float = 0.005, decay: float = 1e-4, seed: int = 11) -> TextCnn:
    """``texts``: the word hashes of each text. Gradients flow through the place of each maximum alone (Adam steps)."""
    random = np.random.default_rng(seed)
    filters = [random.normal(0, 1 / np.sqrt(dim * w), (w, dim, count)).astype(np.float32) for w in widths]
    total = count * len(widths)
    words = HashedWords(texts)
    model = TextCnn(words, np.zeros((len(words.hashes), dim), np.float32), filters, np.full(total, 0.05, np.float32), random.normal(0, 0.3, total).astype(np.float32), 0.0, training=True)
    z = lean(texts, labels, words) if texts else np.zeros(1)
    model.embedding[1:, 0] = np.clip((z[1:] - CHANCE) / 6, 0, 1.5)
    model.embedding[1:, 1] = np.clip((-z[1:] - CHANCE) / 6, 0, 1.5)
    for f in model.filters:
        f[:, 0, :] = np.abs(f[:, 0, :]) + 0.5
    model.weight = np.abs(model.weight) + np.float32(0.5)
    positive = max(labels.mean(), 1e-3)
    model.offset = float(np.log(positive / max(1 - positive, 1e-3)))
    of_class = np.where(labels == 1, 0.5 / positive, 0.5 / max(1 - positive, 1e-3))
    moments: dict[str, list[np.ndarray]] = {}
    step = 0

    def adam(name: str, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None, rate: float = rate) -> None:
        m, v = moments.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
        i = slice(None) if rows is None else rows
        m[i] = 0.9 * m[i] + 0.1 * grad
        v[i] = 0.99 * v[i] + 0.01 * grad * grad
        size = np.sqrt(v[i] / (1 - 0.99**step)) + 1e-6
        value[i] -= rate * (m[i] / (1 - 0.9**step) / size + decay * value[i])

    offset = np.array([model.offset], np.float32)
    for _ in range(epochs):
        order = random.permutation(len(texts))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            step += 1
            all_words, first = gather([texts[i] for i in pick])
            local, ids = np.unique(words.rows(all_words), return_inverse=True)
            small = [np.einsum("vd,wdc->wvc", model.embedding[local], f) for f in model.filters]
            features, places = model.pooled(ids, first, small)
            active = np.maximum(features + model.bias, 0)
            y = labels[pick]
            p = 1 / (1 + np.exp(-np.clip(active @ model.weight + offset[0], -30, 30)))
            error = ((p - y) * of_class[pick] / len(pick)).astype(np.float32)
            back = error[:, None] * model.weight * (active > 0) * (places >= 0)
            moved = np.zeros((len(local), dim), np.float32)
            grads = []
            for k, f in enumerate(model.filters):
                g = np.zeros_like(f)
                for c in range(count):
                    column = k * count + c
                    rows = np.flatnonzero(back[:, column])
                    for j in range(len(f)):
                        at = places[rows, column] + j
                        ok = at < first[1:][rows]
                        r, at = rows[ok], ids[at[ok]]
                        g[j, :, c] = back[r, column] @ model.embedding[local[at]]
                        np.add.at(moved, at, back[r, column][:, None] * f[j, :, c])
                grads.append(g)
            adam("weight", model.weight, active.T @ error)
            adam("bias", model.bias, back.sum(axis=0))
            adam("offset", offset, error.sum(keepdims=True))
            used = np.flatnonzero((np.abs(moved).sum(axis=1) > 0) & (local > 0))
            if len(used):
                adam("embedding", model.embedding, moved[used], local[used], word_rate)
            for k, f in enumerate(model.filters):
                adam(f"filter{k}", f, grads[k])
    model.offset, model.training = float(offset[0]), False
    return model


def best_cut(logits: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> float:
    """The logit between two rows (``counts``: each stands for so many) at which F0.5 is greatest (the middle of equals); above all rows if even there most
    of what it takes is wrong, so that a model that has learnt nothing takes nothing."""
    order = np.argsort(-logits, kind="stable")
    x, y = logits[order], labels[order]
    of = np.ones(len(y), np.int64) if counts is None else counts[order]
    hits, taken = np.cumsum(y * of), np.cumsum(of)
    f = 1.25 * hits / (taken + 0.25 * max(hits[-1], 1))
    ends = np.flatnonzero(np.append(x[1:] < x[:-1], True))
    best = ends[np.flatnonzero(f[ends] >= f[ends].max() - 1e-12)]
    if 2 * hits[best[0]] < taken[best[0]]:
        return float(x[0] + 1)
    below = [x[i + 1] if i + 1 < len(x) else x[i] - 1 for i in best]
    return float(np.mean([(x[i] + b) / 2 for i, b in zip(best, below, strict=True)]))
