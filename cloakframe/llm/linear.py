"""Logistic regression on hashed features of a bounded sample; used by the classifiers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """Sparse rows one after another; row i holds ``at[start[i]:start[i + 1]]``, all with value 1."""

    at: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, lists: list[np.ndarray]) -> Rows:
        sizes = np.fromiter((len(x) for x in lists), np.int64, len(lists))
        at = np.concatenate(lists) if len(lists) else np.empty(0)
        return cls(at.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))

    def __len__(self) -> int:
        return len(self.start) - 1

    def take(self, index: np.ndarray) -> Rows:
        return Rows.of([self.at[self.start[i]:self.start[i + 1]] for i in index])

    def times(self, w: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(w[self.at])])
        return sums[self.start[1:]] - sums[self.start[:-1]]

    def transposed_times(self, v: np.ndarray, places: int) -> np.ndarray:
        return np.bincount(self.at, np.repeat(v, np.diff(self.start)), places)

    def present(self, places: int) -> np.ndarray:
        return np.bincount(self.at, minlength=places)


def telling(rows: Rows, y: np.ndarray, seen: int = 4, most: int | None = None) -> np.ndarray:
    """The sorted keys whose presence depends on ``y``: chi-square of the two-by-two table at least 30, or
    a sixtieth of the rows, as accidental company also grows with their number.  ``most`` bounds the size of a model:
    so many keys at most, the most dependent ones; None for all that pass."""
    if not len(rows.at) or y.all() or not y.any():
        return np.empty(0, np.int64)
    label = np.repeat(y.astype(float), np.diff(rows.start))
    keys, place = np.unique(rows.at, return_inverse=True)
    return keys[dependent(np.bincount(place, label), np.bincount(place), len(rows), float(y.sum()), seen, most)]


def dependent(n1: np.ndarray, n: np.ndarray, total: int, positive: float, seen: int = 4,
              most: int | None = None) -> np.ndarray:
    """``telling`` by counts: the sorted places, of which ``n`` rows and ``n1`` positive ones hold each."""
    if not 0 < positive < total:
        return np.empty(0, np.int64)
    expected = n * positive / total
    spread = expected * (1 - positive / total) * np.maximum(1 - n / total, 1e-9)
    score = np.where(n >= seen, (n1 - expected) ** 2 / np.maximum(spread, 1e-9), 0)
    best = np.argsort(-score, kind="stable")[:most]
    return np.sort(best[score[best] >= max(30, total / 60)])


def among(rows: Rows, keys: np.ndarray) -> Rows:
    """``rows`` restricted to ``keys``, renumbered by their order."""
    if not len(keys):
        return Rows(np.empty(0, np.int64), np.zeros(len(rows) + 1, np.int64))
    place = np.minimum(np.searchsorted(keys, rows.at), len(keys) - 1)
    known = keys[place] == rows.at
    counts = np.concatenate([[0], np.cumsum(known)])
    return Rows(place[known], counts[rows.start])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logit(p: np.ndarray, edge: float = 1e-3) -> np.ndarray:
    p = np.clip(p, edge, 1 - edge)
    return np.log(p / (1 - p))


@dataclass
class Logistic:
    """Weights of hashed places, of a few dense columns, and an intercept."""

    w: np.ndarray
    dense: np.ndarray
    b: float

    def margin(self, rows: Rows, dense: np.ndarray | None = None) -> np.ndarray:
        z = rows.times(self.w) + self.b
        return z + dense @ self.dense if dense is not None and len(self.dense) else z

    def prob(self, rows: Rows, dense: np.ndarray | None = None) -> np.ndarray:
        return sigmoid(self.margin(rows, dense))


def fit(rows: Rows, y: np.ndarray, places: int, dense: np.ndarray | None = None, l2: float = 1e-3,
        least_seen: int = 3, steps: int = 60, rate: float = 0.15) -> Logistic:
    """Full-batch gradient steps with Adam; places seen in fewer than ``least_seen`` rows stay zero.  Both kinds
    of rows weigh half; rows of one kind only give a constant."""
    dense = np.zeros((len(rows), 0)) if dense is None else dense
    n, positive = len(y), float(np.sum(y))
    if n == 0 or positive in (0, n):
        return Logistic(np.zeros(places), np.zeros(dense.shape[1]), 5.0 if n and positive == n else -5.0)
    weight = np.where(y > 0, 0.5 / positive, 0.5 / (n - positive))
    usable = rows.present(places) >= least_seen
    x = np.zeros(places + dense.shape[1] + 1)
    m, s = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        model = Logistic(x[:places], x[places:-1], x[-1])
        error = weight * (model.prob(rows, dense) - y)
        g = np.concatenate([rows.transposed_times(error, places) * usable, dense.T @ error, [error.sum()]])
        g[:-1] += l2 * x[:-1] / max(1, len(x) ** 0.5)
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        x = x - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-6)
    return Logistic(x[:places], x[places:-1], float(x[-1]))
