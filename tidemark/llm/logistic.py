"""Logistic regression by Newton's method, on a bounded sample."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights (the last is the bias) near the prior mean. y may be fractions."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    mean = np.zeros(x.shape[1]) if prior is None else prior
    w, pull = mean.copy(), np.full(x.shape[1], ridge)
    pull[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(pull), x.T @ (y - p) - pull * (w - mean))
        norm = np.abs(step).max()
        w = w + step * min(1.0, 5 / max(norm, 1e-9))
        if norm < 1e-6:
            break
    return w


def score(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
