"""Bootstraps and calibrations on counts: rows become counts per period and score once, replicates and origins are weights.

A replicate of months is a weight per period, an origin a mask of periods. Multiplied into the counts, they give AUC,
Brier score and ECE of every replicate, or the isotonic fit of every origin, so no row is repeated. Scores are dealt out
by ranges; a task works in the order of its scores and hands on totals per replicate, or stacks of pooled blocks per
origin, which a small last step joins in the order of the ranges. Both are exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import BY
from .resample import INCREMENT, MODULUS, MULTIPLIER


def circular_weights(n: int, block: int, reps: int, seed: int) -> np.ndarray:
    """(replicates, n): how often each of n months is drawn by the circular block bootstrap of `resample.block_draws`."""
    b = min(block, n)
    blocks = -(-n // b)
    start = (np.arange(reps)[:, None] * MULTIPLIER + np.arange(blocks)[None] * INCREMENT + seed) % MODULUS % n
    at = ((start[:, :, None] + np.arange(b)[None, None]) % n).reshape(reps, -1)[:, :n]
    out = np.zeros((reps, n), np.int64)
    np.add.at(out, (np.arange(reps)[:, None], at), 1)
    return out


def _cells(df: DataFrame, p: str, y: str, by) -> DataFrame:
    """Counts and hits per key, period and distinct score."""
    d = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    return d.groupBy(*by, "position", F.col(p).cast("double").alias("_p")).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.sum(F.col(y).cast("double")).alias("_s"))


def _chunks(score: np.ndarray, size: int):
    """Slices of sorted scores of about `size` cells; equal scores stay together (at most one cell per period)."""
    at = 0
    while at < len(score):
        end = min(at + size, len(score))
        while end < len(score) and score[end] == score[end - 1]:
            end += 1
        yield slice(at, end)
        at = end


def _by_key(pdf: pd.DataFrame, names: list[str]):
    """Runs of equal keys of sorted rows."""
    if len(pdf):
        yield from pdf.groupby(names, sort=False, dropna=False)


def bootstrap_metrics(df: DataFrame, p: str, y: str, *, block: int = 6, reps: int = 500, seed: int = 1, bins: int = 10, qs=(0.05, 0.95), by=BY) -> DataFrame:
    """Quantiles of AUC, Brier score and ECE over circular block replicates of months, per key.

    The driver holds which periods each key has (keys x periods). Labels are 0 or 1; rows without score or label are left out.
    A replicate with one class has no AUC and does not count there.
    """
    by = list(by)
    cells = _cells(df, p, y, by).persist()
    try:
        months: dict = {}
        for r in cells.select(*by, "position").distinct().collect():
            months.setdefault(tuple(r[k] for k in by), []).append(r["position"])
        months = {k: sorted(v) for k, v in months.items()}
        sent = df.sparkSession.sparkContext.broadcast(months)

        def task(batches):
            weights: dict = {}
            part = [b for b in batches if len(b)]
            if not part:
                return
            whole = pd.concat(part, ignore_index=True)  # one range of scores: counts, not rows
            for key, own in _by_key(whole, by):
                key = key if isinstance(key, tuple) else (key,)
                ms = sent.value[key]
                if key not in weights:
                    weights[key] = circular_weights(len(ms), block, reps, seed).astype(float)
                cols, before = np.zeros((reps, 4 + 3 * bins)), np.zeros(reps)
                for few in _chunks(own["_p"].to_numpy(), 4096):
                    cell = own.iloc[few]
                    w = weights[key][:, np.searchsorted(ms, cell["position"].to_numpy())]
                    score, n, s = cell["_p"].to_numpy(), cell["_n"].to_numpy(), cell["_s"].to_numpy()
                    first = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
                    pos = np.add.reduceat(w * s, first, axis=1)
                    neg = np.add.reduceat(w * (n - s), first, axis=1)
                    below = before[:, None] + np.cumsum(neg, axis=1) - neg
                    # ECE: sums of counts, scores and hits per bin; Brier: sum of squares
                    b = np.clip(np.floor(score * bins), 0, bins - 1).astype(int)
                    table = np.zeros((3, bins, reps))
                    for i, v in enumerate((n, n * score, s)):
                        np.add.at(table[i], b, (w * v).T)
                    square = (w * (n * score ** 2 - 2 * score * s + s)).sum(1)
                    cols += np.column_stack([pos.sum(1), neg.sum(1), (pos * (below + neg / 2)).sum(1), square, *(t.T for t in table)])
                    before += neg.sum(1)
                score = own["_p"].to_numpy()
                yield pd.DataFrame({**{c: [v] for c, v in zip(by, key)}, "lo": [float(score[0])], "v": [cols.ravel().tolist()]})

        keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
        order = [*by, "_p", "position"]
        parts = cells.repartitionByRange(*by, "_p").sortWithinPartitions(*order).mapInPandas(task, f"{keys}, lo double, v array<double>")
        width = 4 + 3 * bins
        names = [f"{m}_p{int(round(q * 100)):02d}" for m in ("auc", "brier", "ece") for q in qs]

        def finish(pdf):
            pdf = pdf.sort_values("lo")
            v = np.array(pdf["v"].tolist()).reshape(len(pdf), reps, width)
            before = np.cumsum(v[:, :, 1], axis=0) - v[:, :, 1]
            pos, neg = v[:, :, 0].sum(0), v[:, :, 1].sum(0)
            with np.errstate(divide="ignore", invalid="ignore"):
                auc = (v[:, :, 2] + v[:, :, 0] * before).sum(0) / (pos * neg)
            t = v.sum(0)
            n = t[:, 4:4 + bins]
            ece = np.abs(t[:, 4 + bins:4 + 2 * bins] - t[:, 4 + 2 * bins:]).sum(1) / n.sum(1)
            got = [np.nanquantile(x, q) if np.isfinite(x).any() else None for x in (auc, t[:, 3] / (pos + neg), ece) for q in qs]
            return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, **{m: [g] for m, g in zip(names, got)}})

        # as many rows per key as there are ranges of scores
        return parts.groupBy(*by).applyInPandas(finish, f"{keys}, " + ", ".join(f"{m} double" for m in names))
    finally:
        cells.unpersist()


def pool(lo: np.ndarray, hi: np.ndarray, w: np.ndarray, s: np.ndarray):
    """Pool adjacent violators: blocks [lo, hi] with weights and sums whose means rise. Pooling stacks of parts equals pooling the whole."""
    out: list[list[float]] = []
    for a, b, n, t in zip(lo.tolist(), hi.tolist(), w.tolist(), s.tolist()):
        out.append([a, b, n, t])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, b2, n2, t2 = out.pop()
            out[-1][1], out[-1][2], out[-1][3] = b2, out[-1][2] + n2, out[-1][3] + t2
    return out


def isotonic_fits(df: DataFrame, score: str, y: str, *, lo: int, hi: int, lag: int = 1, min_months: int = 12, by=BY) -> DataFrame:
    """Monotone fits for origins lo..hi on rows at positions <= origin - lag - 1: keys, origin, xs, ys (ends of the pooled blocks), months.

    Every range of scores is pooled on its own for all origins, then the stacks of the ranges are pooled in order.
    """
    by = list(by)
    cells = _cells(df, score, y, by)
    origins = np.arange(lo, hi + 1)

    def task(batches):
        part = [b for b in batches if len(b)]
        if not part:
            return
        whole = pd.concat(part, ignore_index=True)
        for key, own in _by_key(whole, by):
            key = key if isinstance(key, tuple) else (key,)
            x, pos, n, s = own["_p"].to_numpy(), own["position"].to_numpy(), own["_n"].to_numpy(), own["_s"].to_numpy()
            made = []
            for o in origins.tolist():
                use = pos <= o - lag - 1
                if not use.any():
                    continue
                at, first = np.unique(x[use], return_index=True)
                made.append((*key, o, float(at[0]), pool(at, at, np.add.reduceat(n[use], first), np.add.reduceat(s[use], first))))
            yield pd.DataFrame(made, columns=[*by, "origin", "lo", "stack"])

    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    parts = cells.repartitionByRange(*by, "_p").sortWithinPartitions(*by, "_p", "position").mapInPandas(task, f"{keys}, origin int, lo double, stack array<array<double>>")

    def merge(pdf):
        rows = np.array([r for stack in pdf.sort_values("lo")["stack"] for r in stack])
        out = pool(*rows.T)
        # one point per end of a block
        xs = [v for a, b, _, _ in out for v in ((a, b) if b > a else (a,))]
        ys = [t / n for a, b, n, t in out for _ in range(2 if b > a else 1)]
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "origin": [int(pdf["origin"].iloc[0])], "xs": [xs], "ys": [ys]})

    fits = parts.groupBy(*by, "origin").applyInPandas(merge, f"{keys}, origin int, xs array<double>, ys array<double>")
    # months known at an origin: from the calendar of periods with labels
    per = cells.select(*by, "position").distinct()
    o = df.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias("origin"))
    months = per.join(F.broadcast(o), F.col("position") <= F.col("origin") - lag - 1).groupBy(*by, "origin").agg(F.count(F.lit(1)).alias("months"))
    return fits.join(months, [*by, "origin"]).where(F.col("months") >= min_months)


def isotonic_prequential(df: DataFrame, score: str, y: str, *, lo: int, hi: int, lag: int = 1, min_months: int = 12, out: str = "calibrated", by=BY) -> DataFrame:
    """Each row's score through the monotone fit known at its own origin (linear between blocks, ends held); null where there is none."""
    by = list(by)
    fits = isotonic_fits(df, score, y, lo=lo, hi=hi, lag=lag, min_months=min_months, by=by).withColumnRenamed("origin", "position")
    rows = df.join(fits.select(*by, "position", "xs", "ys"), [*by, "position"], "left")
    x, xs, ys = F.col(score).cast("double"), F.col("xs"), F.col("ys")
    k = F.size(F.filter(xs, lambda v: v <= x))
    at = lambda a, i: F.get(a, i)
    x0, x1, y0, y1 = at(xs, k - 1), at(xs, k), at(ys, k - 1), at(ys, k)
    inner = y0 + (y1 - y0) * (x - x0) / (x1 - x0)
    value = F.when(xs.isNull() | x.isNull(), F.lit(None).cast("double")).when(k == 0, at(ys, F.lit(0))).when(k == F.size(xs), at(ys, k - 1)).otherwise(inner)
    return rows.withColumn(out, value).drop("xs", "ys")
