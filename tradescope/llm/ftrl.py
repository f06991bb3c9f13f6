"""Follow-the-regularised-leader (proximal) with an elastic net, for sparse rows in numpy."""

from __future__ import annotations

import numpy as np


def softmax(scores: np.ndarray) -> np.ndarray:
    """Row-wise probabilities."""
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def dense(rows: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """Sparse rows (columns, values) as a matrix with a last column of ones for the bias."""
    x = np.zeros((len(rows), width + 1), dtype=np.float32)
    x[:, width] = 1.0
    for i, (columns, values) in enumerate(rows):
        x[i, columns] = values
    return x


class Ftrl:
    """Logistic regression with ``classes`` outputs: softmax, or a single sigmoid for one.

    The bias is not penalised. ``l1`` makes weights exactly zero until their gradient sum is
    larger; ``l2`` shrinks the rest; steps follow each coordinate's own gradient history.
    """

    def __init__(self, width: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3):
        self.width, self.alpha, self.beta, self.l2 = width, alpha, beta, l2
        self.l1 = np.full((width + 1, 1), l1, dtype=np.float32)
        self.l1[width] = 0.0
        self.z = np.zeros((width + 1, classes), dtype=np.float32)
        self.n = np.zeros_like(self.z)

    def weights(self) -> np.ndarray:
        """(width + 1, classes); the last row is the bias."""
        shrunk = np.sign(self.z) * np.maximum(np.abs(self.z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(self.n)) / self.alpha + self.l2)

    def predict(self, x: np.ndarray) -> np.ndarray:
        scores = x @ self.weights()
        return softmax(scores) if scores.shape[1] > 1 else 1.0 / (1.0 + np.exp(-scores))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 4, batch: int = 32, seed: int = 7) -> Ftrl:
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for part in np.array_split(order.permutation(len(rows)), max(1, len(rows) // batch)):
                if not len(part):
                    continue
                x = dense([rows[i] for i in part], self.width)
                w = self.weights()
                scores = x @ w
                p = softmax(scores) if scores.shape[1] > 1 else 1.0 / (1.0 + np.exp(-scores))
                g = x.T @ (p - y[part]) / len(part)
                after = self.n + g * g
                self.z += g - (np.sqrt(after) - np.sqrt(self.n)) / self.alpha * w
                self.n = after
        return self
