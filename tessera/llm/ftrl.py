"""Follow-the-regularised-leader (FTRL-proximal) for logistic regression over sparse rows.

Per-coordinate rates and elastic-net penalties; L1 keeps most weights at exactly zero, so a fitted model
is a short list of (coordinate, weights) whose size does not depend on the scored corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Sparse:
    """Non-zero rows of a (dimension x classes) weight table, and a bias for each class."""

    dimension: int
    index: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def dense(self) -> np.ndarray:
        full = np.zeros((self.dimension, self.weights.shape[1]), np.float32)
        full[self.index] = self.weights
        return full


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, classes: int, dimension: int, *, alpha: float, beta: float = 1.0, l1: float, l2: float, epochs: int, seed: int = 7) -> Sparse:
    """Fit on (distinct coordinates, values) rows. Two classes are fitted as one logistic column.

    Rows are taken in one seeded order an epoch, so equal input gives equal weights. The bias is not
    penalised.
    """
    columns = 1 if classes == 2 else classes
    z, n = np.zeros((dimension + 1, columns)), np.zeros((dimension + 1, columns))
    order = np.random.default_rng(seed)
    penalty = np.full((1, columns), l1)

    def weights(zs: np.ndarray, ns: np.ndarray, first: np.ndarray | float) -> np.ndarray:
        return np.where(np.abs(zs) <= first, 0.0, -(zs - np.sign(zs) * first) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            index, values = rows[r]
            at, x = np.append(index, dimension), np.append(values, 1.0)[:, None]
            zs, ns = z[at], n[at]
            first = np.repeat(penalty, len(at), axis=0)
            first[-1] = 0.0
            w = weights(zs, ns, first)
            error = probabilities((x * w).sum(axis=0)[None, :])[0] if columns > 1 else sigmoid((x * w).sum(axis=0))
            error = error - (np.arange(columns) == target[r]) if columns > 1 else error - target[r]
            g = x * error
            n[at] = ns + g * g
            z[at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha * w
    w = weights(z[:-1], n[:-1], l1)
    index = np.flatnonzero(np.any(w != 0, axis=1))
    return Sparse(dimension, index, w[index].astype(np.float32), weights(z[-1:], n[-1:], 0.0)[0])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60.0, 60.0)))


def probabilities(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def platt(margin: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """(scale, shift) so that sigmoid(scale * margin + shift) is calibrated; Newton steps, smoothed targets."""
    ones, zeros = target.sum(), len(target) - target.sum()
    if not ones or not zeros:
        return 1.0, 0.0
    wanted = np.where(target == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    for _ in range(50):
        p = sigmoid(x @ a)
        gradient = x.T @ (p - wanted) + 1e-3 * (a - [1.0, 0.0])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
        a = a - np.clip(step, -1.0, 1.0)
    return float(max(a[0], 1e-3)), float(a[1])


def temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The factor on logits that minimises log loss, by golden-section search over its logarithm."""

    def loss(log_t: float) -> float:
        p = probabilities(logits * np.exp(log_t))
        return float(-np.log(np.maximum(p[np.arange(len(target)), target], 1e-12)).mean())

    low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        one, two = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, two) if loss(one) < loss(two) else (one, high)
    return float(np.exp((low + high) / 2))
