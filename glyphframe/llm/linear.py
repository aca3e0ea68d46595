"""Sparse multinomial logistic regression, trained by follow-the-regularised-leader.

Elastic-net penalties: weights whose summed gradient stays under the first are zero.
A temperature fitted on rows that did not train makes probabilities of scores.
"""

from __future__ import annotations

import numpy as np


class SparseSoftmax:
    """Classes by sparse feature vectors (indices, values)."""

    def __init__(self, size: int, classes: list[str], alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.001):
        self.classes, self.alpha, self.beta, self.l1, self.l2 = classes, alpha, beta, l1, l2
        self.z, self.n = np.zeros((size, len(classes))), np.zeros((size, len(classes)))
        self.temperature = 1.0

    def weights(self, idx: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        step = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / step)

    def update(self, idx: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(idx)
        p = softmax(values @ w)
        p[label] -= 1
        g = np.outer(values, p)
        n = self.n[idx]
        self.z[idx] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[idx] = n + g * g

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = 3, seed: int = 7) -> SparseSoftmax:
        """Three quarters of the rows train; the rest calibrate."""
        r = np.random.default_rng(seed)
        order = r.permutation(len(rows))
        own = order[: max(1, len(order) * 3 // 4)]
        for _ in range(epochs):
            for i in r.permutation(own):
                self.update(*rows[i], labels[i])
        rest = order[len(own) :] if len(order) > len(own) else own
        w = self.weights()
        logits = np.array([rows[i][1] @ w[rows[i][0]] for i in rest])
        self.temperature = best_temperature(logits, np.array([labels[i] for i in rest]))
        return self


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The one of a grid from 0.05 to 20 with the least log loss."""
    grid = np.geomspace(0.05, 20, 121)
    loss = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
