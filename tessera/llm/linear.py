"""Small models over hashed features, fitted with numpy on a bounded sample."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_ordinal(
    indptr: np.ndarray, indices: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int, l2: float = 1e-3, steps: int = 300, rate: float = 0.1
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the cumulative-link model ``P(grade <= k) = sigmoid(t_k - w.x)``.

    Rows are sparse (``indptr, indices, values``); the log-likelihood is averaged over them, with ``l2 / 2 |w|^2``
    against large weights. Adam, full batch; thresholds stay in order through positive steps ``exp(d_k)``.
    Two grades make it logistic regression.
    """
    n, rows = len(grades), np.repeat(np.arange(len(grades)), np.diff(indptr))
    share = np.array([(grades <= k).mean() for k in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    w, base, gaps = np.zeros(n_features), start[0], np.log(np.maximum(1e-3, np.diff(start)))
    state = [np.zeros(n_features + n_grades - 1) for _ in range(2)]
    for step in range(1, steps + 1):
        t = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        score = np.bincount(rows, values * w[indices], minlength=n)
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        up, down = sigmoid(edge[grades + 1] - score), sigmoid(edge[grades] - score)
        p = np.maximum(up - down, 1e-12)
        d_up, d_down = up * (1 - up) / p, down * (1 - down) / p  # d log p / d edges
        g_score = (d_up - d_down) / n  # of the loss, with respect to the score
        g_w = np.bincount(indices, values * g_score[rows], minlength=n_features) + l2 * w
        g_t = np.zeros(n_grades + 1)
        np.add.at(g_t, grades + 1, -d_up / n)
        np.add.at(g_t, grades, d_down / n)
        g_t = g_t[1:-1]
        tail = np.cumsum(g_t[::-1])[::-1]
        g = np.concatenate([g_w, [tail[0]], tail[1:] * np.exp(gaps)])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.999 * state[1] + 0.001 * g * g
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        w, base, gaps = w - move[:n_features], base - move[n_features], gaps - move[n_features + 1 :]
    return w, base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
