"""Logistic regression by Newton steps: dense for a few hundred features, sparse for any number."""

from dataclasses import dataclass, field

import numpy as np


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights, the intercept last. The ridge leaves the intercept alone."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    if not len(x):
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (y - p) - penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


#: Turns of conjugate gradients in a Newton step.
MOST_TURNS = 100


@dataclass
class SparseRows:
    """Rows of sparse features, (start of each row, place and value of each entry), and dense columns beside them."""

    starts: np.ndarray
    at: np.ndarray
    value: np.ndarray
    size: int
    dense: np.ndarray = field(default=None)

    def __post_init__(self):
        self.row = np.repeat(np.arange(len(self)), np.diff(self.starts))
        if self.dense is None:
            self.dense = np.empty((len(self), 0))

    def __len__(self) -> int:
        return len(self.starts) - 1

    @staticmethod
    def of(rows: list[tuple[np.ndarray, np.ndarray]], size: int) -> "SparseRows":
        """Of (places, values) of each row."""
        starts = np.cumsum([0, *(len(at) for at, _ in rows)])
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
        return SparseRows(starts, join([a for a, _ in rows], np.int64), join([v for _, v in rows], np.float64), size)

    def beside(self, column: np.ndarray) -> "SparseRows":
        """With another dense column."""
        return SparseRows(self.starts, self.at, self.value, self.size, np.column_stack([self.dense, column]))

    def where(self, keep: np.ndarray) -> "SparseRows":
        """The rows that a mask keeps."""
        entries, sizes = keep[self.row], np.diff(self.starts)[keep]
        return SparseRows(np.cumsum([0, *sizes]), self.at[entries], self.value[entries], self.size, self.dense[keep])

    def times(self, w: np.ndarray) -> np.ndarray:
        """Rows times weights: the sparse features', the dense columns', the intercept's."""
        return np.bincount(self.row, self.value * w[self.at], len(self)) + self.dense @ w[self.size : -1] + w[-1]

    def back(self, r: np.ndarray) -> np.ndarray:
        """The transposed product."""
        return np.concatenate([np.bincount(self.at, self.value * r[self.row], self.size), self.dense.T @ r, [r.sum()]])


def fit_sparse(x: SparseRows, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """As ``fit_logistic``, for sparse rows: each Newton step is solved by conjugate gradients, so no matrix of features is made."""
    w = np.zeros(x.size + x.dense.shape[1] + 1)
    if not len(x):
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    squares = SparseRows(x.starts, x.at, x.value**2, x.size, x.dense**2)
    for _ in range(steps):
        p = sigmoid(x.times(w))
        curve = p * (1 - p)
        scale = 1 / (squares.back(curve) + penalty)
        left = x.back(y - p) - penalty * w
        step, along = np.zeros_like(w), scale * left
        dot = left @ along
        goal = dot * 1e-12  # a rough step is mended by the next
        for _ in range(MOST_TURNS):
            if dot <= goal or dot < 1e-300:
                break
            bent = x.back(curve * (x.times(along))) + penalty * along
            far = dot / (along @ bent)
            step += far * along
            left = left - far * bent
            turned = scale * left
            before, dot = dot, left @ turned
            along = turned + dot / before * along
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def predict_sparse(x: SparseRows, w: np.ndarray) -> np.ndarray:
    return sigmoid(x.times(w))
