"""What the numpy networks share: Adam, logistic pieces, a small logistic regression."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


class Adam:
    """Adam over a dict of float32 arrays, in place."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self._weights, self._rate, self._step = weights, rate, 0
        self._first = {k: np.zeros_like(v) for k, v in weights.items()}
        self._second = {k: np.zeros_like(v) for k, v in weights.items()}

    def update(self, gradients: dict[str, np.ndarray]) -> None:
        self._step += 1
        rate = self._rate * (1 - 0.999**self._step) ** 0.5 / (1 - 0.9**self._step)
        for k, g in gradients.items():
            self._first[k] += 0.1 * (g - self._first[k])
            self._second[k] += 0.001 * (g * g - self._second[k])
            self._weights[k] -= (rate * self._first[k] / (np.sqrt(self._second[k]) + 1e-8)).astype(self._weights[k].dtype)


def logistic_fit(features: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Coefficients (the last is the constant) of a weighted logistic regression by Newton's method."""
    x = np.column_stack([features, np.ones(len(features))])
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        p = np.clip(sigmoid(x @ beta), 1e-9, 1 - 1e-9)
        slope = x.T @ (weights * (labels - p)) - penalty @ beta
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(curve, slope)
        beta += step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return beta
