"""Is direction seasonal? Permutation tests on bitmaps of labels.

A series' labels are two bitmaps over periods: which are known, which are Up. A permutation of the calendar is twelve
bitmaps, alike for all series; counts of a calendar month are population counts of ANDs, so a task tests thousands of
permutations on its series without a row per period, and sends sums per permutation only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import BY
from .resample import INCREMENT, MODULUS, MULTIPLIER

STATISTICS = ("heterogeneity", "split_half_r", "breadth_seasonality")


def permutations(n: int, reps: int, seed: int) -> np.ndarray:
    """(reps + 1, n): which calendar entry a place gets; row 0 keeps the calendar, the others follow the generator of `label_permutation`."""
    i = np.arange(n)
    rows = [i]
    for rep in range(1, reps + 1):
        rows.append(np.lexsort((i, (rep * 7919 * MULTIPLIER + i * 104729 * INCREMENT + seed) % MODULUS)))
    return np.array(rows)


def packed(bits: np.ndarray) -> np.ndarray:
    """Bits along the last axis as 64-bit words."""
    n = bits.shape[-1]
    wide = np.zeros((*bits.shape[:-1], -(-max(n, 1) // 64) * 64), bool)
    wide[..., :n] = bits
    return np.packbits(wide, axis=-1, bitorder="little").view(np.uint64)


def existence_tests(targets: DataFrame, *, reps: int = 200, seed: int = 1, min_cell: int = 3, min_labels: int = 1, by=BY) -> DataFrame:
    """Per panel: observed value, null median, null 95 % quantile and p-value of three statistics of seasonality.

    heterogeneity: chi-square of a series' Up-rates per calendar month about its own rate, over all series. split_half_r:
    correlation of the cells' deviations between even and odd years. breadth_seasonality: share of breadth's variance
    between calendar months. Calendar months are permuted over periods, jointly for all series; years stay. Series with
    fewer than min_labels labels are left out. The driver holds one row per period.
    """
    by = list(by)
    t = targets.where("y_true is not null").withColumns({"_cal": F.add_months("month", 1), "_m": F.month(F.add_months("month", 1)), "_year": F.year(F.add_months("month", 1))})
    if min_labels > 1:
        enough = t.groupBy(*by, "series_id").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= min_labels).select(*by, "series_id")
        t = t.join(enough, [*by, "series_id"])
    per = t.groupBy(*by, "position", "_m", "_year").agg(F.count(F.lit(1)).alias("n"), F.sum("y_true").alias("s")).collect()
    calendars: dict = {}
    for r in sorted(per, key=lambda r: r["position"]):
        calendars.setdefault(tuple(r[k] for k in by), []).append((r["position"], r["_m"] - 1, r["_year"] % 2, r["s"] / r["n"]))
    masks = {}
    for key, cal in calendars.items():
        order = permutations(len(cal), reps, seed)
        month = np.array([m for _, m, _, _ in cal])[order]
        odd = np.array([y for *_, y, _ in cal])
        hot = month[:, None, :] == np.arange(12)[None, :, None]
        masks[key] = ([p for p, *_ in cal], packed(hot), packed(hot & (odd == 0)), packed(hot & (odd == 1)), packed(odd == 0), packed(odd == 1))
    sent = targets.sparkSession.sparkContext.broadcast(masks)

    def task(batches):
        sums: dict = {}
        for pdf in batches:
            for key, own in pdf.groupby(by, sort=False):
                key = key if isinstance(key, tuple) else (key,)
                places, hot, *halves, even, odd = sent.value[key]
                known = np.zeros((len(own), len(places)), bool)
                up = np.zeros_like(known)
                for i, (ps, ys) in enumerate(zip(own["ps"], own["ys"])):
                    at = np.searchsorted(places, np.asarray(ps))
                    known[i, at] = True
                    up[i, at[np.asarray(ys) > 0.5]] = True
                out = sums.setdefault(key, np.zeros((reps + 1, 7)))
                for k, u in zip(packed(known), packed(up)):
                    count = lambda words, mask: np.bitwise_count(words & mask).sum(axis=-1).astype(float)
                    c, s = count(k, np.uint64(2**64 - 1)), count(u, np.uint64(2**64 - 1))
                    base = s / c
                    with np.errstate(divide="ignore", invalid="ignore"):
                        if 0 < base < 1:
                            n, x = count(k, hot), count(u, hot)
                            ok = n >= min_cell
                            out[:, 0] += np.where(ok, n * (x / n - base) ** 2 / (base * (1 - base)), 0.0).sum(1)
                        dev, many = [], []
                        for half, mask in zip((even, odd), halves):
                            c2, s2 = count(k, half), count(u, half)
                            n = count(k, mask)
                            many.append(n)
                            dev.append(count(u, mask) / n - (s2 / c2 if c2 else np.nan))
                        ok = (many[0] >= min_cell) & (many[1] >= min_cell) & np.isfinite(dev[0]) & np.isfinite(dev[1])
                        a, b = np.where(ok, dev[0], 0.0), np.where(ok, dev[1], 0.0)
                    out[:, 1:] += np.column_stack([v.sum(1) for v in (ok, a, b, a * b, a * a, b * b)])
        made = [(*key, rep, v.tolist()) for key, m in sums.items() for rep, v in enumerate(m)]
        if made:
            yield pd.DataFrame(made, columns=[*by, "rep", "v"])

    keys = ", ".join(f"`{c}` {targets.schema[c].dataType.simpleString()}" for c in by)
    # a series has at most one row per period
    series = t.groupBy(*by, "series_id").agg(F.collect_list("position").alias("ps"), F.collect_list("y_true").alias("ys")).select(*by, "ps", "ys")
    parts = series.mapInPandas(task, f"{keys}, rep int, v array<double>")
    total = parts.groupBy(*by, "rep").agg(*[F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(7)])
    n, a, b, ab, aa, bb = (F.col(f"v{i}") for i in range(1, 7))
    r = (n * ab - a * b) / F.sqrt(F.greatest((n * aa - a * a) * (n * bb - b * b), F.lit(0.0)))
    stats = total.select(*by, "rep", F.col("v0").alias("heterogeneity"), F.when((n * aa - a * a > 1e-12) & (n * bb - b * b > 1e-12), r).alias("split_half_r"))
    breadth = [(*key, rep, float(v)) for key, cal in calendars.items() for rep, v in enumerate(_breadth(cal, reps, seed))]
    stats = stats.join(targets.sparkSession.createDataFrame(breadth, f"{keys}, rep int, breadth_seasonality double"), [*by, "rep"], "left")
    long = stats.unpivot([*by, "rep"], list(STATISTICS), "statistic", "value").where("value is not null and not isnan(value)")
    seen = long.where("rep = 0").select(*by, "statistic", F.col("value").alias("observed"))
    return long.where("rep > 0").join(seen, [*by, "statistic"]).groupBy(*by, "statistic", "observed").agg(
        F.percentile("value", F.lit(0.5)).alias("null_median"), F.percentile("value", F.lit(0.95)).alias("null_p95"),
        ((1 + F.sum((F.col("value") >= F.col("observed")).cast("int"))) / (1.0 + F.count(F.lit(1)))).alias("p_value"))


def _breadth(cal, reps: int, seed: int) -> np.ndarray:
    """Share of breadth's variance between calendar months, of every permutation; periods are few."""
    x = np.array([b for *_, b in cal])
    order = permutations(len(cal), reps, seed)
    month = np.array([m for _, m, _, _ in cal])[order]
    total = ((x - x.mean()) ** 2).mean()
    hot = month[:, None, :] == np.arange(12)[None, :, None]
    n = hot.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = (hot * x).sum(-1) / n
        between = np.where(n > 0, n * (mean - x.mean()) ** 2, 0.0).sum(1)
        return between / total if total > 0 else np.full(reps + 1, np.nan)
