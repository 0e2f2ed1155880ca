"""Linear models fitted on a bounded sample: hinge loss by dual coordinate descent, and margins as probabilities."""

from __future__ import annotations

import numpy as np


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dims: int, cost: float = 1.0,
                 epochs: int = 20, seed: int = 7) -> np.ndarray:
    """Weights of a hinge-loss linear model, with a constant feature last.

    ``rows`` are (indices, values), ``labels`` +1 or -1. Both classes weigh the same in total.
    """
    weights, alpha = np.zeros(dims + 1), np.zeros(len(rows))
    share = {s: len(rows) / (2 * max(1, int((labels == s).sum()))) for s in (1, -1)}
    limit = np.array([cost * share[int(y)] for y in labels])
    square = np.array([float(v @ v) + 1.0 for _, v in rows])
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for k in random.permutation(len(rows)):
            at, values = rows[k]
            y = labels[k]
            gradient = y * (weights[at] @ values + weights[-1]) - 1.0
            new = min(max(alpha[k] - gradient / square[k], 0.0), limit[k])
            if (step := (new - alpha[k]) * y) != 0.0:
                weights[at] += step * values
                weights[-1] += step
                moved = max(moved, abs(step))
                alpha[k] = new
        if moved < 1e-4:
            break
    return weights


def margin_scale(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that turns margins into probabilities.

    Smoothed targets keep the curve finite when the classes do not overlap.
    """
    up, down = int((labels > 0).sum()), int((labels < 0).sum())
    target = np.where(labels > 0, (up + 1) / (up + 2), 1 / (down + 2))
    weight = np.where(labels > 0, 0.5 / max(up, 1), 0.5 / max(down, 1))
    slope, offset = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        error, bend = weight * (p - target), weight * p * (1 - p)
        g = np.array([error @ margins, error.sum()])
        h = np.array([[bend @ margins**2 + 1e-6, bend @ margins], [bend @ margins, bend.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        slope, offset = slope - np.clip(step[0], -1, 1), offset - np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(slope, 0.0)), float(offset)


def probability(margin, scale: tuple[float, float]):
    return 1 / (1 + np.exp(-np.clip(scale[0] * margin + scale[1], -30, 30)))
