"""A small logistic regression, fitted on the driver on a bounded number of rows of numbers."""

from __future__ import annotations

import numpy as np


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray | None = None, strength: float = 1.0, weight: np.ndarray | None = None, rounds: int = 30) -> np.ndarray:
    """Weights, the bias last, by Newton's method; a Gaussian prior of that strength holds them near `prior`.

    Without rows the prior is the result.
    """
    x = np.hstack([np.asarray(x, dtype=float), np.ones((len(x), 1))])
    prior = np.zeros(x.shape[1]) if prior is None else np.asarray(prior, dtype=float)
    weight = np.ones(len(x)) if weight is None else weight
    w = prior.copy()
    for _ in range(rounds if len(x) else 0):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) + strength * (w - prior)
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        size = np.abs(step).max()
        w = w - step * min(1.0, 3.0 / max(size, 1e-12))
        if size < 1e-6:
            break
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.asarray(x, dtype=float) @ w[:-1] + w[-1]
