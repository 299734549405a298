"""Linear support vector machines in numpy, for models that are fitted on bounded samples."""

from __future__ import annotations

import numpy as np


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 150, weight=None) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM with squared hinge loss, by accelerated gradient descent.

    ``y`` holds -1 and 1; classes count alike whatever their sizes.  With one class only, the bias alone
    says which.
    """
    y = np.asarray(y, dtype=np.float32)
    if len(y) == 0 or (y == y[0]).all():
        return np.zeros(x.shape[1], np.float32), float(y[0]) if len(y) else 0.0
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1).astype(np.float32)
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum()).astype(np.float32) if weight is None else weight
    c = cost * share * 10
    # the curvature is bounded by the largest eigenvalue of the weighted Gram matrix
    v = np.ones(x.shape[1], np.float32)
    for _ in range(12):
        v = x.T @ (c * (x @ v))
        v /= np.linalg.norm(v) + 1e-12
    rate = 1 / (1 + 2 * float(v @ (x.T @ (c * (x @ v)))))
    w = z = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        short = np.maximum(0, 1 - y * (x @ z))
        new = z - rate * (z - 2 * (x.T @ (c * y * short)))
        z = new + k / (k + 3) * (new - w)
        w = new
    return w[:-1].copy(), float(w[-1])


def fit_platt(f: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities, by Newton steps on smoothed labels."""
    f, y = np.asarray(f, float), np.asarray(y, float)
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    if not n1 or not n0:
        return 1.0, (5.0 if n1 else -5.0)
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -30, 30)))
        g = p - target
        h = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(g * f).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * f * f).sum() + 1e-3, (h * f).sum()], [(h * f).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - 0.7 * step[0], b - 0.7 * step[1]
    return float(a), float(b)


def fit_joint(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Slopes, none of them negative, and offset that turn several margins into one probability.

    As ``fit_platt``, by Newton steps on smoothed labels; a margin whose slope would be negative is left out.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    if not n1 or not n0:
        return np.full(x.shape[1], 1 / x.shape[1]), (5.0 if n1 else -5.0)
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    used = list(range(x.shape[1]))
    while True:
        part = np.c_[x[:, used], np.ones(len(x))]
        b, pull = np.zeros(len(used) + 1), np.r_[np.full(len(used), ridge), 1e-6]
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(part @ b, -30, 30)))
            h = np.maximum(p * (1 - p), 1e-9)
            b -= 0.7 * np.linalg.solve((part.T * h) @ part + np.diag(pull), part.T @ (p - target) + pull * b)
        if len(used) == 1 or (b[:-1] >= 0).all():
            break
        used.pop(int(np.argmin(b[:-1])))
    slopes = np.zeros(x.shape[1])
    slopes[used] = np.maximum(b[:-1], 0)
    return slopes, float(b[-1])
