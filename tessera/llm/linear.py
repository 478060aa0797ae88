"""Small trainers for sparse linear models, run on bounded samples."""

from __future__ import annotations

import numpy as np

Rows = list[tuple[np.ndarray, np.ndarray]]  # feature indices and values of each row


def ftrl_multinomial(rows: Rows, labels: np.ndarray, size: int, classes: int, *, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Weights (size, classes) and biases by follow-the-regularised-leader, proximal, with an elastic net."""
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))
    rng = np.random.default_rng(11)

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zz) <= l1, 0.0, w)

    for _ in range(epochs):
        for k in rng.permutation(len(rows)).tolist():
            at, x = np.append(rows[k][0], size), np.append(rows[k][1], 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[labels[k]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    return w[:size], w[size]


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""

    def loss(log_t: float) -> float:
        return -np.log(np.maximum(softmax(logits / np.exp(log_t))[np.arange(len(labels)), labels], 1e-300)).mean()

    low, high, ratio = np.log(0.02), np.log(50.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def cumulative_link(rows: Rows, grades: np.ndarray, size: int, levels: int, *, l1: float = 2e-4, l2: float = 1e-4, rounds: int = 600, step: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights (size,) shared by all ordered thresholds (levels - 1,): P(grade > k) = sigmoid(w.x - t_k).

    Full-batch proximal Adam; thresholds are a first one and positive gaps, so they stay ordered."""
    home = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    at = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int64)
    x = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0)
    above = (grades[:, None] > np.arange(levels - 1)).astype(float)
    share = np.clip(above.mean(axis=0), 1e-3, 1 - 1e-3)
    start = np.log((1 - share) / share)
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    params = np.concatenate([np.zeros(size), start[:1], gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, rounds + 1):
        w, first, log_gaps = params[:size], params[size], params[size + 1 :]
        cuts = first + np.concatenate([[0.0], np.cumsum(np.exp(log_gaps))])
        s = np.bincount(home, x * w[at], minlength=len(rows))
        # P(grade = k) as a difference of neighbouring tails; gradients of its logarithm.
        tail = sigmoid(s[:, None] - cuts)
        full = np.hstack([np.ones((len(rows), 1)), tail, np.zeros((len(rows), 1))])
        slope = full * (1 - full)
        k = grades
        i = np.arange(len(rows))
        p = np.maximum(full[i, k] - full[i, k + 1], 1e-12)
        to_s = (slope[i, k] - slope[i, k + 1]) / p
        to_cut = np.zeros((len(rows), levels + 1))
        np.add.at(to_cut, (i, k), -slope[i, k] / p)
        np.add.at(to_cut, (i, k + 1), slope[i, k + 1] / p)
        cut_grad = to_cut[:, 1:levels].mean(axis=0)
        grad = np.concatenate([
            np.bincount(at, x * to_s[home], minlength=size) / len(rows) - l2 * w,
            [cut_grad.sum()],
            np.array([cut_grad[j + 1 :].sum() for j in range(levels - 2)]) * np.exp(log_gaps),
        ])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        scale = step / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        params = params + scale * m / (1 - 0.9**t)
        w = params[:size]
        params[:size] = np.sign(w) * np.maximum(np.abs(w) - np.minimum(scale[:size], 1.0) * l1, 0)
    return params[:size], params[size] + np.concatenate([[0.0], np.cumsum(np.exp(params[size + 1 :]))])
