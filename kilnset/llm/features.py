"""Hashed word and character n-grams, and a logistic regression on them.

A document's vector holds, for each kind of n-gram, the share of the document's
n-grams that fall into a bin, so long and short texts compare and a score is a
mean of weights. Vectors are only materialised for the bounded fitting sample;
scoring adds weights up straight from the n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kilnset.llm.words import Words, as_strings, mix, slices, window_hashes

#: Bins of the hashed space (the size of a model).
BINS = 1 << 16
WORD_SIZES = (1, 2)
CHARACTER_SIZES = (2, 4)
KINDS = len(WORD_SIZES) + len(CHARACTER_SIZES)


def _code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and the document of each."""
    whole = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    counts = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return whole, np.repeat(np.arange(len(column), dtype=np.int32), counts)


def grams(column: pa.Array, words: Words | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bin, document) of every n-gram, one pair of arrays for each kind."""
    words = words or Words(column)
    hashes = words.hashes()
    for size in WORD_SIZES:
        found = window_hashes(hashes, size, seed=11)
        whole = words.doc[:len(found)] == words.doc[size - 1:] if len(found) else np.zeros(0, bool)
        yield (found[whole] % np.uint64(BINS)).astype(np.int32), words.doc[:len(found)][whole]
    points, doc = _code_points(column)
    for size in CHARACTER_SIZES:
        n = max(0, len(points) - size + 1)
        key = np.full(n, size, dtype=np.uint64)
        for j in range(size):
            key = key * np.uint64(0x9E3779B97F4A7C15) + points[j:j + n]
        whole = doc[:n] == doc[size - 1:size - 1 + n]
        yield (mix(key[whole]) % np.uint64(BINS)).astype(np.int32), doc[:n][whole]


def scores(column: pa.Array, weights: np.ndarray, words: Words | None = None) -> np.ndarray:
    """Sum over the kinds of the mean weight of the document's n-grams."""
    n = len(column)
    out = np.zeros(n)
    for bins, doc in grams(column, words):
        total = np.bincount(doc, weights=weights[bins], minlength=n)
        out += total / np.maximum(np.bincount(doc, minlength=n), 1)
    return out


def vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse vectors as (document, bin, share)."""
    n = len(column)
    keys, values = [], []
    for bins, doc in grams(column):
        cell, count = np.unique(doc.astype(np.int64) * BINS + bins, return_counts=True)
        size = np.maximum(np.bincount(doc, minlength=n), 1)
        keys.append(cell)
        values.append(count / size[cell // BINS])
    cell, value = np.concatenate(keys), np.concatenate(values)
    return cell // BINS, cell % BINS, value


@dataclass
class Linear:
    """Weights of the bins, an intercept and the calibration of the score."""

    weights: np.ndarray
    slope: float
    shift: float

    def probability(self, column: pa.Array, words: Words | None = None) -> np.ndarray:
        margin = scores(column, self.weights, words)
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def _newton(margin: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Two-parameter logistic regression of target on margin."""
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -40, 40)))
        gradient = x.T @ (weight * (p - target)) + 1e-3 * (beta - [1.0, 0.0])
        curve = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        beta = beta - step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-6)), float(beta[1])


def fit(texts: pa.Array, target: np.ndarray, steps: int = 80, penalty: float = 1e-6, balanced: bool = True) -> Linear:
    """Logistic regression on three quarters of the rows, calibrated (Platt) on
    the rest. ``target`` may be probabilities. Without two classes the model
    says 1 for everything."""
    target = np.asarray(target, dtype=float)
    n = len(target)
    held = np.arange(n) % 4 == 3
    high = target >= 0.5
    if n < 8 or min(high[held].sum(), (~high)[held].sum(), high[~held].sum(), (~high)[~held].sum()) == 0:
        return Linear(np.zeros(BINS), 1.0, 40.0)
    # a slice of the rows at a time, in narrow types: the vectors have thousands of
    # entries a row, and temporary arrays of them all would be most of a task's memory
    cells = []
    for a, b in slices(texts):
        r, c, v = vectors(texts.slice(a, b - a))
        cells.append((a, b, r.astype(np.int32), c.astype(np.uint16), v))

    def by_bin(weights):
        """Sum by bin, in the order of the rows."""
        total, every = np.zeros(BINS), np.arange(BINS)
        for part in cells:
            total = np.bincount(np.concatenate([every, part[3]]), weights=np.concatenate([total, weights(part)]), minlength=BINS)
        return total

    def by_row(weights):
        return np.concatenate([np.bincount(part[2], weights=weights(part), minlength=part[1] - part[0]) for part in cells])

    # bins seen often move by small steps and rare ones by large ones
    mean = by_bin(lambda part: part[4]) / n
    scale = 1.0 / np.sqrt(mean + 1e-5)
    for _, _, _, c, v in cells:
        v *= scale[c]
    share = np.where(high, 0.5 / high[~held].sum(), 0.5 / (~high)[~held].sum()) if balanced else np.full(n, 1.0 / n)
    weight = np.where(held, 0.0, share)

    def margin(w, b):
        return by_row(lambda part: part[4] * w[part[3]]) + b

    norm = by_row(lambda part: part[4] * part[4])
    rate = 4.0 / (float(norm.max()) + 1.0)
    w = y = np.zeros(BINS)
    b = yb = 0.0
    t = 1.0
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(margin(y, yb), -40, 40)))
        r = weight * (p - target)
        nw = y - rate * (by_bin(lambda part: part[4] * r[part[0]:part[1]][part[2]]) + penalty * y)
        nb = yb - rate * r.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, yb = nw + (t - 1) / t2 * (nw - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = nw, nb, t2
    m = margin(w, b)
    slope, shift = _newton(m[held], target[held], np.where(high, 1.0, 1.0)[held])
    return Linear(w * scale, slope, slope * b + shift)


def fit_rows(table: pa.Table, text: str, target: str, key: str, **options) -> Linear:
    """``fit`` on a gathered sample, in the order of ``key``, so that the model
    doesn't depend on how the rows arrived."""
    table = table.take(pc.sort_indices(table, sort_keys=[(key, "ascending")]))
    return fit(as_strings(table[text]), table[target].to_numpy(), **options)
