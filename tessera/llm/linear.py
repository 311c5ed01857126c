"""Logistic regression on bounded samples, for the operators that train one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Rows that are worked on at once: what is held beside a sample is bounded by it.
BLOCK = 1_024


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def blocks(n: int) -> Iterator[slice]:
    return (slice(at, min(n, at + BLOCK)) for at in range(0, n, BLOCK))


def fit(x: np.ndarray | Rows, y: np.ndarray, l2: float | np.ndarray = 1.0, rounds: int = 25, weight: np.ndarray | None = None) -> np.ndarray:
    """Newton's method; ``y`` may be soft. ``l2``: the penalty of all columns or of each. Returns the weights, the intercept (not penalised) last."""
    l2 = np.append(l2, 0.0) if isinstance(l2, np.ndarray) else l2
    weight = np.ones(len(x)) if weight is None else weight
    many = x.shape[1] + 1
    penalty = np.full(many, l2)
    penalty[-1] = 1e-6
    w = np.zeros(many)
    for _ in range(rounds):
        slope, curve = penalty * w, np.diag(penalty)
        for at in blocks(len(x)):
            some = np.hstack([x[at], np.ones((at.stop - at.start, 1))])
            p = sigmoid(some @ w)
            slope += some.T @ (weight[at] * (p - y[at]))
            curve += (some * (weight[at] * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ some
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def predict(x: np.ndarray | Rows, w: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(x[at] @ w[:-1] for at in blocks(len(x)))]) + w[-1]


class Scale:
    """Centre and scale by the columns of a sample, given in parts."""

    def __init__(self, *parts: np.ndarray):
        n = sum(map(len, parts))
        each = lambda f: sum(f(x[at].astype(np.float64)).sum(0) for x in parts for at in blocks(len(x))) / n
        self.mean = each(lambda x: x)
        self.deviation = np.sqrt(each(lambda x: (x - self.mean) ** 2))
        self.deviation[self.deviation < 1e-9] = 1

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.deviation, -8, 8)


class Rows:
    """Some rows of a sample's parts, scaled when a block of them is asked for: no copy of the sample is held."""

    def __init__(self, scale: Scale, parts: list[np.ndarray], at: np.ndarray):
        self.scale, self.parts, self.at = scale, parts, at
        self.shape = len(at), parts[0].shape[1]

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, some: slice) -> np.ndarray:
        at, first = self.at[some], len(self.parts[0])
        out = np.empty((len(at), self.shape[1]))
        out[at < first] = self.parts[0][at[at < first]]
        out[at >= first] = self.parts[1][at[at >= first] - first]
        return self.scale(out)
