"""Classifier two-sample test on counted cells: logistic regression with categorical features.

A load and the first load of its source are told apart by a logistic regression whose features are categories (binned
values). Rows with equal categories and fold are one weighted cell, so a model sees every row while its input
stays bounded by the number of categories. Two folds: each cell is scored by the model of the other fold.
"""

from __future__ import annotations

import numpy as np


def fit(features: list[np.ndarray], sizes: list[int], n0: np.ndarray, n1: np.ndarray, ridge: float = 1.0) -> list[np.ndarray]:
    """Weights per category of every feature, by Newton steps over one feature at a time (its categories are disjoint)."""
    n = n0 + n1
    start = np.log((n1.sum() + 1) / (n0.sum() + 1))
    weights = [np.zeros(s) for s in sizes]
    z = np.full(len(n), start)
    for _ in range(40):
        change = 0.0
        for f, s, w in zip(features, sizes, weights):
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            slope = np.bincount(f, n1 - n * p, s) - ridge * w
            curve = np.bincount(f, n * p * (1 - p), s) + ridge
            step = np.clip(slope / curve, -2, 2)
            w += step
            z += step[f]
            change = max(change, float(np.abs(step).max(initial=0)))
        if change < 1e-3:
            break
    return weights


def auc(score: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> float:
    """Chance that a row of the second sample scores above one of the first, ties counting half."""
    a, b = n0.sum(), n1.sum()
    if not a or not b:
        return 0.5
    _, at = np.unique(score, return_inverse=True)
    c0, c1 = np.bincount(at, n0), np.bincount(at, n1)
    return float((c1 * (np.cumsum(c0) - c0 / 2)).sum() / (a * b))


def cross_fitted(features: list[np.ndarray], fold: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> float:
    sizes = [int(f.max(initial=-1)) + 1 for f in features]
    total, weight = 0.0, 0.0
    for k in (0, 1):
        train, held = fold != k, fold == k
        w = fit([f[train] for f in features], sizes, n0[train], n1[train])
        score = sum((x[f[held]] for f, x in zip(features, w)), np.zeros(int(held.sum())))
        size = min(float(n0[held].sum()), float(n1[held].sum()))
        total += size * auc(np.round(score, 9), n0[held], n1[held])
        weight += size
    return total / weight if weight else 0.5


def discriminate(columns: dict[str, list[np.ndarray]], fold: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> dict:
    """Cross-fitted AUC with all columns, without each, and with each alone; and the standard error under no change."""
    a, b = float(n0.sum()), float(n1.sum())
    out = {
        "error": float(np.sqrt((a + b + 1) / (12 * a * b))) if a and b else 1.0,
        "all": cross_fitted([f for fs in columns.values() for f in fs], fold, n0, n1),
    }
    for c, own in columns.items():
        out[f"without_{c}"] = cross_fitted([f for k, fs in columns.items() if k != c for f in fs], fold, n0, n1)
        out[f"only_{c}"] = cross_fitted(own, fold, n0, n1)
    return out
