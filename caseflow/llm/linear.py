"""Text features and linear models for the classifiers: everything over whole texts, without one Python object per word."""

from __future__ import annotations

import numpy as np

#: Buckets of hashed byte n-grams.
GRAM_BUCKETS = 1 << 15


def gram_buckets(data: np.ndarray, n: int = 3, buckets: int = GRAM_BUCKETS) -> np.ndarray:
    """The bucket of the n-gram at each byte but the last n - 1."""
    if len(data) < n:
        return np.zeros(0, np.int64)
    code = np.zeros(len(data) - n + 1, np.uint32)
    for i in range(n):
        code = code << np.uint32(8) | data[i : len(data) - n + 1 + i]
    code *= np.uint32(0x9E3779B1)
    return (code >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int64)


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each i, empty segments 0."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, float)))


def svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 10, seed: int = 1) -> np.ndarray:
    """A linear support vector machine by dual coordinate descent; y is +1 or -1; x has a constant column for the bias."""
    rng = np.random.default_rng(seed)
    x = np.ascontiguousarray(x, np.float32)
    w, alpha, norm = np.zeros(x.shape[1], np.float32), np.zeros(len(y)), np.maximum((x * x).sum(1), 1e-12)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            g = y[i] * float(x[i] @ w) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost)
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return w
