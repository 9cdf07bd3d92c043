"""Sparse logistic regression on bounded samples, with numpy only."""

from __future__ import annotations

import numpy as np


class Sparse:
    """Rows of 0/1 features: ``cols`` holds each row's feature numbers, one row after another."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.col = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def t_dot(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], self.width)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: Sparse, dense: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None, l2: float = 1.0, steps: int = 200, columns: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the sparse and of the dense columns (add a column of ones for the intercept).

    Adam on the mean log-loss with an L2 penalty of ``l2`` / rows; deterministic. ``columns``
    says which sparse columns there are; the others' weights are 0.
    """
    there = 1.0 if columns is None else columns.astype(float)
    use = np.ones(x.n) if rows is None else rows.astype(float)
    total = max(1.0, use.sum())
    w, v = np.zeros(x.width), np.zeros(dense.shape[1])
    m1 = [np.zeros_like(w), np.zeros_like(v)]
    m2 = [np.zeros_like(w), np.zeros_like(v)]
    for t in range(1, steps + 1):
        g = (sigmoid(x.dot(w) + dense @ v) - y) * use / total
        for k, (p, grad) in enumerate(((w, there * (x.t_dot(g) + l2 * w / total)), (v, dense.T @ g))):
            m1[k] = 0.9 * m1[k] + 0.1 * grad
            m2[k] = 0.999 * m2[k] + 0.001 * grad**2
            p -= 0.1 * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
    return w, v
