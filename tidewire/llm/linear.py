"""Small dense and sparse linear learners on numpy, for fits on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit_sparse_logistic(indptr: np.ndarray, indices: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, l2: float, steps: int = 120, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty over CSR rows, by full-batch Adam; deterministic."""
    rows = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(indptr))
    weight = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
    w, bias = np.zeros(width + 1), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=values * w[indices], minlength=len(y)) + w[-1]
        err = (sigmoid(z) - y) * weight / len(y)
        g = np.append(np.bincount(indices, weights=values * err[rows], minlength=width), err.sum())
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    bias = float(w[-1])
    return w[:-1], bias


def fit_linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss by dual coordinate descent (y is -1 or 1); the bias is a
    further constant feature. Deterministic for a seed."""
    n = len(y)
    xb = np.hstack([x, np.ones((n, 1), x.dtype)])
    diagonal = (xb * xb).sum(1) + 0.5 / c
    alpha, w, order = np.zeros(n), np.zeros(xb.shape[1]), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(n):
            g = y[i] * (xb[i] @ w) - 1 + alpha[i] * 0.5 / c
            new = max(0.0, alpha[i] - g / diagonal[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * xb[i]
                alpha[i] = new
    return w[:-1], float(w[-1])
