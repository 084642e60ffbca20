"""Logistic regression over hashed sparse features, trained with follow-the-regularised-leader updates (numpy)."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Per-coordinate FTRL-Proximal. Documents come as (indices, values) with distinct indices."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.zb = self.nb = 0.0

    def weights(self, i) -> np.ndarray:
        z = self.z[i]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2))

    @property
    def bias(self) -> float:
        return -self.zb / ((self.beta + self.nb**0.5) / self.alpha)

    def update(self, i: np.ndarray, x: np.ndarray, y: float) -> None:
        w, b = self.weights(i), self.bias
        p = 1 / (1 + np.exp(-np.clip(w @ x + b, -35, 35)))
        g = (p - y) * x
        s = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha
        self.z[i] += g - s * w
        self.n[i] += g * g
        g = p - y
        self.zb += g - ((self.nb + g * g) ** 0.5 - self.nb**0.5) / self.alpha * b
        self.nb += g * g

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 3, seed: int = 7) -> "Ftrl":
        order = np.random.default_rng(seed)
        for _ in range(epochs if rows else 0):
            for k in order.permutation(len(rows)):
                self.update(*rows[k], labels[k])
        return self

    def model(self) -> tuple[np.ndarray, float]:
        return self.weights(slice(None)).astype(np.float32), float(self.bias)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
