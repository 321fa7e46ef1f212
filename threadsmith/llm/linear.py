"""Small linear models, trained on bounded samples on the driver."""

from __future__ import annotations

import numpy as np


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 100) -> np.ndarray:
    """Weights (bias last) of a linear support vector machine with squared
    hinge loss, by accelerated gradient steps; ``y`` is +1 or -1 and both
    sides weigh alike."""
    y = y.astype(x.dtype)
    side = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    a = np.concatenate((x, np.ones((len(x), 1), dtype=x.dtype)), axis=1)
    w = np.zeros(a.shape[1], dtype=x.dtype)
    # the rows have length 1, plus the bias
    v, step = w.copy(), x.dtype.type(1.0 / (1.0 + 4.0 * c))
    c = x.dtype.type(2.0 * c)
    for i in range(rounds):
        slack = np.maximum(0.0, 1 - y * (a @ v))
        new = v - step * (v - c * (a.T @ (side * y * slack)))
        v = new + x.dtype.type(i / (i + 3.0)) * (new - w)
        w = new
    return w


def train_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-5, rounds: int = 30) -> np.ndarray:
    """Weights (bias last) of a logistic model of few columns, by Newton's
    method; ``y`` is 0 or 1."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) / max(1, len(y)) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a / max(1, len(y)) + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w
