"""Boosted regression trees for every origin of a one-row-per-period table.

Each fit has one row per known period, so it is small; there are as many fits as panels and origins. Origins are
dealt out in blocks: a task gets one panel's rows up to the last origin of its block, sorts every feature once
per origin, and reads the gain of all splits of all features of a tree level off running sums. Histories are copied
once per block and not once per origin, no task holds more than a panel's periods, and the driver holds nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import BY


class Booster:
    """Least-squares boosting with shrunken leaves: gain GL^2/(nL+l2) + GR^2/(nR+l2) - G^2/(n+l2), splits midway between values."""

    def __init__(self, x: np.ndarray, y: np.ndarray, *, trees: int, step: float, depth: int, min_leaf: int, l2: float):
        self.depth, self.min_leaf, self.l2 = depth, min_leaf, l2
        self.order = np.argsort(x, axis=0, kind="stable")
        sorted_x = np.take_along_axis(x, self.order, axis=0)
        self.middle = (sorted_x[1:] + sorted_x[:-1]) / 2
        self.cut = sorted_x[1:] > sorted_x[:-1]
        self.x, self.base, self.trees = x, float(y.mean()), []
        at = np.full(len(y), self.base)
        for _ in range(trees):
            leaves = np.zeros(len(y))
            tree = self._grow(at - y, np.ones(len(y), bool), depth, step, leaves)
            at = at + leaves
            self.trees.append(tree)

    def _split(self, g: np.ndarray, inside: np.ndarray):
        """(feature, place) of the best split of the rows inside, None where no split gains; ties go to the first feature and the lowest value."""
        total, n = g[inside].sum(), int(inside.sum())
        if n < 2 * self.min_leaf or not self.x.shape[1]:
            return None
        left = np.cumsum(np.where(inside, g, 0.0)[self.order], axis=0)[:-1]
        many = np.cumsum(inside[self.order], axis=0)[:-1]
        ok = self.cut & (many >= self.min_leaf) & (n - many >= self.min_leaf)
        gain = np.where(ok, left ** 2 / (many + self.l2) + (total - left) ** 2 / (n - many + self.l2) - total ** 2 / (n + self.l2), -np.inf)
        best = gain.max(axis=0)
        feature = int(best.argmax())
        return None if best[feature] <= 0 else (feature, int(gain[:, feature].argmax()))

    def _grow(self, g, inside, depth, step, leaves):
        found = self._split(g, inside) if depth else None
        if found is None:
            value = -step * g[inside].sum() / (inside.sum() + self.l2)
            leaves[inside] = value
            return value
        feature, place = found
        threshold = self.middle[place, feature]
        low = inside & (self.x[:, feature] <= threshold)
        return feature, threshold, self._grow(g, low, depth - 1, step, leaves), self._grow(g, inside & ~low, depth - 1, step, leaves)

    def predict(self, row: np.ndarray) -> float:
        total = self.base
        for tree in self.trees:
            while isinstance(tree, tuple):
                feature, threshold, low, high = tree
                tree = low if row[feature] <= threshold else high
            total += tree
        return total


def filled(train: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features that training has seen, gaps filled with its medians, and flags of the features with gaps."""
    seen = np.isfinite(train).any(axis=0)
    train, row = train[:, seen], row[seen]
    gaps, gap = ~np.isfinite(train), ~np.isfinite(row)
    middle = np.array([np.median(c[~m]) for c, m in zip(train.T, gaps.T)])
    some = gaps.any(axis=0)
    return (np.hstack([np.where(gaps, middle, train), gaps[:, some].astype(float)]),
            np.concatenate([np.where(gap, middle, row), gap[some].astype(float)]))


def boosted_forecast(market: DataFrame, cols: list[str], target: str, *, lo: int, hi: int, trees: int = 100, step: float = 0.04, depth: int = 2,
                     min_leaf: int = 12, l2: float = 10.0, lag: int = 1, block: int = 8, bounds=(0.02, 0.98), out: str = "forecast_breadth", by=BY) -> DataFrame:
    """Forecast of `target` at every origin lo..hi from rows at positions <= origin - lag - 1: keys, `out`, train_rows, fit_through.

    An origin without a known target gives null. Features without any known value in training are left out; missing
    ones take the median and a flag. Values are clipped to `bounds`. Periods are expected once per panel.
    """
    by = list(by)
    rows = market.select(*by, "position", F.col(target).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in cols])
    at = F.floor((F.col("position") - lo) / block)
    blocks = rows.where(F.col("position").between(lo, hi)).groupBy(*by, at.alias("_block")).agg(F.max("position").alias("_last"))
    parts = rows.join(blocks, by).where(F.col("position") <= F.col("_last"))
    keys = ", ".join(f"`{c}` {market.schema[c].dataType.simpleString()}" for c in by)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        pos, y, x, first = pdf["position"].to_numpy(), pdf["_y"].to_numpy(dtype=float), pdf[cols].to_numpy(dtype=float), lo + int(pdf["_block"].iloc[0]) * block
        made = []
        for i in np.flatnonzero((pos >= first) & (pos <= hi)):
            known = (pos <= pos[i] - lag - 1) & np.isfinite(y)
            value, through = None, None
            if known.any():
                train, row = filled(x[known], x[i])
                value = float(np.clip(Booster(train, y[known], trees=trees, step=step, depth=depth, min_leaf=min_leaf, l2=l2).predict(row), *bounds))
                through = int(pos[known].max())
            made.append((*[pdf[c].iloc[0] for c in by], int(pos[i]), value, int(known.sum()), through))
        return pd.DataFrame(made, columns=[*by, "position", out, "train_rows", "fit_through"]).astype({"fit_through": "Int32"})

    return parts.groupBy(*by, "_block").applyInPandas(fit, f"{keys}, position int, {out} double, train_rows int, fit_through int")
