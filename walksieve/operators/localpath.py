"""Local logistic models over feature sets, penalties and origins in one visit per series.

A series holds at most one row per period. All origins of a series are fitted together as one stack of small systems,
and the penalties as a path: each starts from the coefficients of the stronger one before, which is a few Newton steps
away. So a grid of feature sets and penalties costs one shuffle and little more than its largest fit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import BY
from .varying import _own

#: Compact feature sets of local models.
LEAN = ["direction_lag_1", "momentum_3", "momentum_6", "distance_mean_12", "rolling_std_12"]
CORE = ["direction_lag_1", "direction_lag_2", "direction_lag_3", "momentum_3", "momentum_6", "rolling_std_12", "distance_mean_12", "cross_section_rank"]
WIDE = ["direction_lag_1", "direction_lag_2", "direction_lag_3", "change_lag_1", "momentum_3", "momentum_6", "momentum_12", "rolling_std_12", "robust_z_12",
        "distance_mean_12", "cross_section_rank", "cross_section_breadth"]
SETS = {"lean5": LEAN, "core8": CORE, "wide12": WIDE}


def _standard(x: np.ndarray, use: np.ndarray):
    """Per origin: rows with gaps filled by the median of its known rows, standardised by them; and whether every feature was seen."""
    k, m = len(use), x.shape[1]
    z, seen = np.zeros((k, len(x), m)), np.zeros(k, bool)
    for o in range(k):
        train = x[use[o]]
        seen[o] = len(train) > 0 and np.isfinite(train).any(axis=0).all()
        if seen[o]:
            middle = np.nanmedian(train, axis=0)
            full = np.where(np.isfinite(x), x, middle)
            mean, sd = full[use[o]].mean(axis=0), full[use[o]].std(axis=0)
            z[o] = (full - mean) / np.where(sd > 0, sd, 1.0)
    return z, seen


def fit_local_path(rows: DataFrame, sets: dict[str, list[str]], cs: list[float], *, lo: int, hi: int, y: str = "y_true", lag: int = 1, min_rows: int = 1, min_class: int = 1,
                   by=BY) -> DataFrame:
    """Keys, feature_set, c, p_local and local_rows of every row at origins lo..hi, for each set and penalty.

    A model is fitted on the series' own labelled rows at positions <= origin - lag - 1, intercept penalised like slopes.
    p_local is null where there are fewer than min_rows such rows or min_class of either label, or a feature has no value.
    """
    by, cs = list(by), sorted(cs)
    cols = list(dict.fromkeys(c for v in sets.values() for c in v))
    d = rows.select(*by, "series_id", "position", F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in cols])
    keys = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (*by, "series_id", "position"))

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        pos, yy = pdf["position"].to_numpy(), pdf["_y"].to_numpy(dtype=float)
        at = np.flatnonzero((pos >= lo) & (pos <= hi))
        known = np.isfinite(yy)
        use = (pos[None] <= pos[at][:, None] - lag - 1) & known[None]
        n = use.sum(1)
        ones = (use * np.where(known, yy, 0.0)).sum(1)
        enough = (n >= min_rows) & (np.minimum(ones, n - ones) >= max(min_class, 1))
        head, made = [pdf[c].iloc[0] for c in (*by, "series_id")], []
        for name, chosen in sets.items():
            x = pdf[chosen].to_numpy(dtype=float)
            z, seen = _standard(x, use)
            ok = np.flatnonzero(enough & seen)
            values = np.full((len(cs), len(at)), np.nan)
            if len(ok):
                design = np.concatenate([np.ones((len(ok), len(x), 1)), z[ok]], axis=2)
                start = None
                for i, c in enumerate(cs):
                    start = _own(np.zeros((len(ok), len(x))), design, np.where(known, yy, 0.0)[None], use[ok].astype(float), c, start=start)
                    e = (design[np.arange(len(ok)), at[ok]] * start).sum(1)
                    values[i, ok] = np.clip(1.0 / (1.0 + np.exp(-e)), 1e-6, 1 - 1e-6)
            for i, c in enumerate(cs):
                made += [(*head, int(pos[r]), name, c, None if np.isnan(v) else float(v), int(m)) for r, v, m in zip(at, values[i], n)]
        return pd.DataFrame(made, columns=[*by, "series_id", "position", "feature_set", "c", "p_local", "local_rows"])

    # a stated number: adaptive execution would put few bytes into one task, but fits cost far more than their bytes
    d = d.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "series_id")
    return d.groupBy(*by, "series_id").applyInPandas(task, f"{keys}, feature_set string, c double, p_local double, local_rows int")
