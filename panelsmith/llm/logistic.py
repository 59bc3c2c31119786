"""Ridge logistic regression by Newton steps, for the few features of a bounded sample."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, intercept: bool = True, steps: int = 50) -> np.ndarray:
    """Weights (the intercept last, unpenalised) that minimise logistic loss + ridge / 2 * |w|^2."""
    if intercept:
        x = np.c_[x, np.ones(len(x))]
    penalty = np.full(x.shape[1], ridge)
    if intercept:
        penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * penalty @ (v * v))

    now = loss(w)
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian + 1e-9 * np.eye(len(w)), gradient)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w, before, now = w - size * step, now, loss(w - size * step)
        if before - now < 1e-9 * max(1.0, abs(now)):
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))
