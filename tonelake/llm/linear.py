"""Logistic regression on sparse binary features, fitted on a bounded table of rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Sparse:
    """Rows of feature numbers, one after the other; ``starts`` has one more entry than rows."""

    features: np.ndarray
    starts: np.ndarray

    @staticmethod
    def of(rows: list[np.ndarray]) -> Sparse:
        lengths = np.fromiter((len(r) for r in rows), np.int64, len(rows))
        flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.uint32)
        return Sparse(flat, np.concatenate([[0], np.cumsum(lengths)]))

    def __len__(self) -> int:
        return len(self.starts) - 1

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.starts))

    def rows(self, keep: np.ndarray) -> Sparse:
        lengths = np.diff(self.starts)
        return Sparse(self.features[np.repeat(keep, lengths)], np.concatenate([[0], np.cumsum(lengths[keep])]))

    def restricted(self, chosen: np.ndarray) -> Sparse:
        """Only the features in the sorted array ``chosen``, numbered by their place in it."""
        if not len(chosen):
            return Sparse(np.zeros(0, np.int64), np.zeros(len(self) + 1, np.int64))
        at, hit = _places(chosen, self.features)
        before = np.concatenate([[0], np.cumsum(hit)])
        return Sparse(at[hit].astype(np.int64), before[self.starts])


def _places(chosen: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each feature stands in the sorted array ``chosen``, and whether it is there."""
    at = np.zeros(len(features), np.int32)
    for k in range(0, len(features), 1 << 20):  # in parts: the search works on wider numbers
        at[k : k + (1 << 20)] = np.minimum(np.searchsorted(chosen, features[k : k + (1 << 20)]), len(chosen) - 1)
    return at, chosen[at] == features


def telling_features(rows: Sparse, label: np.ndarray, most: int, least_rows: int = 5, least_z: float = 4.0) -> np.ndarray:
    """Sorted numbers of the features whose share differs most between the classes.

    The share is that of rows, which name a feature once; ``z`` is the two-sample statistic.
    With one class only, none is telling.
    """
    positive = label > 0.5
    n1, n0 = float(positive.sum()), float((~positive).sum())
    if not n1 or not n0:
        return np.zeros(0, np.int64)
    names, counts = np.unique(rows.features, return_counts=True)
    names = names[counts >= least_rows].astype(np.int64)
    if not len(names):
        return np.zeros(0, np.int64)
    inside = rows.restricted(names)
    with_feature = np.bincount(inside.features, minlength=len(names))
    with_both = np.bincount(inside.features, weights=positive[inside.row_of], minlength=len(names))
    share = with_feature / (n1 + n0)
    spread = np.sqrt(np.maximum(share * (1 - share) * (1 / n1 + 1 / n0), 1e-12))
    z = np.abs(with_both / n1 - (with_feature - with_both) / n0) / spread
    fit = np.flatnonzero((z >= least_z) & (with_feature >= least_rows))
    best = fit[np.lexsort((names[fit], -z[fit]))][:most]
    return np.sort(names[best])


@dataclass(frozen=True)
class Logistic:
    """``chosen`` numbers the features; ``dense`` weighs further columns of numbers."""

    chosen: np.ndarray
    weights: np.ndarray
    dense: np.ndarray
    bias: float

    def probability(self, rows: Sparse, columns: np.ndarray) -> np.ndarray:
        """``columns`` has one row per row of ``rows`` and one column per dense weight."""
        inside = rows.restricted(self.chosen)
        z = np.bincount(inside.row_of, weights=self.weights[inside.features], minlength=len(rows)).astype(float)
        return 1 / (1 + np.exp(-np.clip(z + columns @ self.dense + self.bias, -30, 30)))


def fit(
    rows: Sparse,
    columns: np.ndarray,
    label: np.ndarray,
    chosen: np.ndarray,
    penalty: float = 1e-4,
    steps: int = 400,
    rate: float = 0.1,
) -> Logistic:
    """Full-batch Adam on the mean log loss with a squared penalty; the same input gives the same weights."""
    inside = rows.restricted(chosen)
    row_of, size = inside.row_of, len(chosen)
    width = size + columns.shape[1] + 1
    share = np.clip(label.mean() if len(label) else 0.5, 1e-3, 1 - 1e-3)
    theta = np.zeros(width)
    theta[-1] = np.log(share / (1 - share))
    first, second = np.zeros(width), np.zeros(width)
    for step in range(1, steps + 1 if len(label) else 1):
        z = np.bincount(row_of, weights=theta[inside.features], minlength=len(rows)).astype(float)
        z += columns @ theta[size:-1] + theta[-1]
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / len(label)
        slope = np.concatenate(
            [np.bincount(inside.features, weights=off[row_of], minlength=size), columns.T @ off, [off.sum()]]
        )
        slope[:-1] += penalty * theta[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Logistic(chosen, theta[:size], theta[size:-1], float(theta[-1]))
