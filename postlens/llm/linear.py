"""Small dense solvers that fit a linear model on a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def l2_svm(gram: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Minimises ridge/2 |w|^2 + 1/2 sum weight_i max(0, 1 - y_i (w x_i + b))^2; returns (beta, b), w = sum beta_i x_i.

    Newton's method on the set of rows inside the margin, in terms of the Gram
    matrix (float32 or float64; the bias is a weakly regularised constant
    feature). At most one float64 matrix of its size stands beside it, and the
    solver's own copy.
    """
    y = y.astype(np.float64)
    active = np.ones(len(y), bool)
    beta = np.zeros(len(y))
    for _ in range(rounds):
        at = np.flatnonzero(active)
        beta = np.zeros(len(y))
        if len(at):
            inside = np.empty((len(at), len(at)))
            for a, rows in blocks(at):
                inside[a : a + len(rows)] = gram[np.ix_(rows, at)]
            inside += 1.0  # the constant feature
            inside.flat[:: len(at) + 1] += ridge / weight[at]
            beta[at] = np.linalg.solve(inside, y[at])
            del inside
        margin = np.concatenate([np.zeros(0), *((gram[rows[0] : rows[-1] + 1].astype(np.float64) + 1.0) @ beta for _, rows in blocks(np.arange(len(y))))])
        now = y * margin < 1
        if (now == active).all():
            break
        active = now
    return beta, float(beta.sum())


def blocks(rows: np.ndarray, size: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """(position, rows) of slices of rows."""
    for a in range(0, len(rows), size):
        yield a, rows[a : a + size]


def l2_svm_sparse(rows: list[np.ndarray], square: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, epochs: int = 12, tolerance: float = 0.1, seed: int = 5) -> tuple[np.ndarray, float]:
    """The same problem over rows of present features, by dual coordinate descent; memory is that of the rows.

    Feature k of a row that has it is the root of square[k]. Returns what each
    present feature adds to the margin (its weight times its value), and the bias.
    """
    draw = np.random.default_rng(seed)
    out, bias = np.zeros(len(square)), 0.0
    beta, slack = np.zeros(len(y)), ridge / weight
    curve = np.array([square[r].sum() for r in rows]) + 1.0 + slack
    for _ in range(epochs):
        worst = 0.0
        for i in draw.permutation(len(y)).tolist():
            r = rows[i]
            slope = y[i] * (out[r].sum() + bias) - 1.0 + beta[i] * slack[i]
            if beta[i] == 0 and slope >= 0:
                continue
            worst = max(worst, abs(slope))
            now = max(beta[i] - slope / curve[i], 0.0)
            step = (now - beta[i]) * y[i]
            if step:
                beta[i] = now
                out[r] += step * square[r]
                bias += step
        if worst < tolerance:
            break
    return out, float(bias)


def balanced(y: np.ndarray) -> np.ndarray:
    """Weights that give both signs of y the same total."""
    pos, n = max(1, int((y > 0).sum())), len(y)
    return np.where(y > 0, n / (2 * pos), n / (2 * max(1, n - pos)))


def platt(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(a, c) of the logistic curve 1 / (1 + exp(-(a margin + c))) of greatest likelihood, targets pulled in as Platt does."""
    n1, n0 = float((y > 0).sum()), float((y <= 0).sum())
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(margin))], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * (theta - [1.0, 0.0]))
        theta -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))
