"""A linear-chain conditional random field with two labels, on many sequences at once.

Sequences lie one after the other in flat arrays. A position's evidence is a sum
of weights of its features (each feature slot picks one weight of its table).
Messages are kept as log-odds of label 1 and are passed for all sequences together,
so a step costs one numpy operation over the sequences still running.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def marginals(evidence: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of label 1 at each position, and how often each pair of neighbouring labels is expected.

    ``evidence`` are log-odds, ``trans[i, j]`` the weight of label j after i.
    """
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    start, length = starts[order], lengths[order]
    running = [int(k) for k in np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")]
    ahead, back = evidence.astype(np.float64).copy(), np.zeros(len(evidence))
    for t in range(1, len(running)):
        at = start[: running[t]] + t
        before = ahead[at - 1]
        ahead[at] += np.logaddexp(before + trans[1, 1], trans[0, 1]) - np.logaddexp(before + trans[1, 0], trans[0, 0])
    for t in range(len(running) - 2, -1, -1):
        at = start[: running[t + 1]] + t
        after = evidence[at + 1] + back[at + 1]
        back[at] = np.logaddexp(after + trans[1, 1], trans[1, 0]) - np.logaddexp(after + trans[0, 1], trans[0, 0])
    one = 1 / (1 + np.exp(-np.clip(ahead + back, -60, 60)))
    inner = np.ones(len(evidence), dtype=bool)
    inner[starts[lengths > 0]] = False
    at = np.flatnonzero(inner)
    left, right = ahead[at - 1], evidence[at] + back[at]
    pair = np.stack([np.full(len(at), trans[0, 0]), right + trans[0, 1], left + trans[1, 0], left + right + trans[1, 1]])
    pair = np.exp(pair - pair.max(axis=0))
    pair /= pair.sum(axis=0)
    return one, pair.sum(axis=1).reshape(2, 2)


@dataclass
class Chain:
    """Weights by feature slot and feature, and of neighbouring labels."""

    weights: np.ndarray  # slots x size
    bias: float = 0.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def evidence(self, features: np.ndarray) -> np.ndarray:
        """``features`` holds a feature number for each slot (slots x positions)."""
        total = np.full(features.shape[1], self.bias)
        for table, picked in zip(self.weights, features, strict=True):
            total += table[picked]
        return total

    def tag(self, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return marginals(self.evidence(features), lengths, self.trans)[0] if features.shape[1] else np.zeros(0)


def fit(features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, size: int, steps: int = 40, decay: float = 1e-4) -> Chain:
    """Maximum likelihood by full-batch steps with a rate for each weight."""
    chain = Chain(np.zeros((len(features), size)))
    n, lengths = len(labels), lengths[lengths > 0]
    inner = np.ones(n, dtype=bool)
    inner[np.cumsum(lengths) - lengths] = False
    at = np.flatnonzero(inner)
    seen = np.bincount(2 * labels[at - 1] + labels[at], minlength=4).reshape(2, 2)
    past_w, past_b, past_t = np.full_like(chain.weights, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    for _ in range(steps):
        one, pairs = marginals(chain.evidence(features), lengths, chain.trans)
        off = (one - labels) / n
        slope = np.stack([np.bincount(f, weights=off, minlength=size) for f in features]) + decay * chain.weights / n
        past_w += slope**2
        chain.weights -= 0.5 * slope / np.sqrt(past_w)
        past_b += off.sum() ** 2
        chain.bias -= 0.5 * off.sum() / np.sqrt(past_b)
        slope = (pairs - seen) / n
        past_t += slope**2
        chain.trans -= 0.3 * slope / np.sqrt(past_t)
    return chain


#: Penalty on squared weights, for a mean loss: large enough for inputs that separate the labels, too small to flatten the curve.
RIDGE = 1e-5


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights (the last is the constant) of a logistic regression, by Newton steps that are halved until they help."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    weight = weight / weight.sum()
    sign = np.where(y > 0, -1.0, 1.0)

    def loss(w):
        return (weight * np.logaddexp(0, sign * (x @ w))).sum() + RIDGE / 2 * (w @ w)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + RIDGE * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        while (after := loss(w - step)) > now and np.abs(step).max() > 1e-9:
            step /= 2
        if np.abs(step).max() < 1e-8:
            break
        w, now = w - step, min(now, after)
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
