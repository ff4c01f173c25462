"""Column helpers shared by every operator.

All of them are plain Spark expressions: null means "unavailable", a zero
denominator gives null, and no helper lets a null turn into a number.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# Default key columns.  Every frame carries ``panel_id``; operators that replay a
# grid or several horizons add their own key by passing ``by=``.
BY = ("panel_id",)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a, b) -> Column:
    a, b = col(a), col(b)
    return F.when(b != 0, a / b)


def clip(x, lo=None, hi=None) -> Column:
    """Bound ``x``; unlike bare greatest/least a null stays null."""
    x = col(x)
    y = x
    if lo is not None:
        y = F.greatest(y, lo if isinstance(lo, Column) else F.lit(lo))
    if hi is not None:
        y = F.least(y, hi if isinstance(hi, Column) else F.lit(hi))
    return F.when(x.isNotNull(), y)


def flag(cond: Column) -> Column:
    """1.0 / 0.0, null when the condition is null."""
    return F.when(cond, 1.0).when(~cond, 0.0)


def truth(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def within(c, most: int, what: str) -> Column:
    """The column, or an error where it exceeds a bound that a result was built for."""
    return F.when(col(c) > most, F.raise_error(F.concat(F.lit(f"{what} exceeds its bound {most}: "), col(c).cast("string")))).otherwise(col(c))


def logit(p, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.ln(q / (1.0 - q))


def sigmoid(z) -> Column:
    return 1.0 / (1.0 + F.exp(-col(z)))


def rnd(c, places: int = 6) -> Column:
    """Round; adding 0.0 folds a negative zero."""
    return F.round(col(c), places) + F.lit(0.0)


def round_cols(df, cols, places: int = 6):
    return df.withColumns({c: rnd(c, places) for c in cols})


# ---- windows ---------------------------------------------------------------


def series_window(lo=None, hi=None, by=BY):
    """History of one series: at most one row per period of the calendar."""
    w = Window.partitionBy(*by, "series_id").orderBy("position")
    return w if lo is None else w.rowsBetween(lo, hi)


def market_window(lo=None, hi=None, by=BY):
    """History of a one-row-per-period table; always partitioned by its panel."""
    w = Window.partitionBy(*by).orderBy("position")
    return w if lo is None else w.rowsBetween(lo, hi)


UNB = Window.unboundedPreceding


def lag(x, k: int = 1, by=BY) -> Column:
    return F.lag(col(x), k).over(series_window(by=by))


def roll(fn, x, k: int, m: int, window=series_window, by=BY, lag_rows: int = 0) -> Column:
    """Aggregate over the last ``k`` rows if at least ``m`` of them are present."""
    x = col(x)
    w = window(-(k - 1) - lag_rows, -lag_rows, by)
    return F.when(F.count(x).over(w) >= m, fn(x).over(w))


def roll_quantile(x, q: float, k: int, m: int, window=series_window, by=BY, lag_rows: int = 0):
    return roll(lambda c: F.percentile(c, F.lit(q)), x, k, m, window, by, lag_rows)


def _middle(sorted_array: Column) -> Column:
    n = F.size(sorted_array)
    return (
        F.get(sorted_array, F.floor((n - 1) / 2).cast("int"))
        + F.get(sorted_array, F.floor(n / 2).cast("int"))
    ) / 2.0


def array_median(a: Column) -> Column:
    """Median of a bounded array; the array is sorted once."""
    return F.get(F.transform(F.array(F.array_sort(a)), _middle), 0)


def array_mad(a: Column) -> Column:
    """Median absolute deviation of a bounded array."""
    return F.get(
        F.transform(
            F.array(F.array_sort(a)),
            lambda s: F.get(
                F.transform(
                    F.array(_middle(s)),
                    lambda m: array_median(F.transform(s, lambda x: F.abs(x - m))),
                ),
                0,
            ),
        ),
        0,
    )


def correct(direction="direction", y="y_true") -> Column:
    """Direction-aware hit: Up is right when y=1, Down when y=0, else null."""
    d, t = col(direction), col(y)
    return (
        F.when(t.isNull() | d.isNull(), F.lit(None).cast("double"))
        .when(d == "Up", flag(t == 1.0))
        .when(d == "Down", flag(t == 0.0))
    )


def wilson_bounds(hits, calls, z: float):
    """Lower and upper Wilson score bounds for ``hits`` out of ``calls``."""
    # both roots p of calls * (hits / calls - p)^2 = z^2 * p * (1 - p), as a p^2 - b p + c = 0
    successes, trials = col(hits).cast("double"), col(calls).cast("double")
    a, b, c = trials + z * z, 2.0 * successes + z * z, div(successes * successes, trials)
    root = F.sqrt(F.greatest(b * b - 4.0 * a * c, F.lit(0.0)))
    return tuple(F.when(trials > 0, (b + sign * root) / (2.0 * a)) for sign in (-1.0, 1.0))


Z_ONE_SIDED_95 = 1.6448536269514722
Z_TWO_SIDED_95 = 1.959963984540054


def const_frame(spark, rows: list[tuple], schema: str):
    """A parameter table (grids, windows, thresholds) as a literal plan node."""
    return spark.createDataFrame(rows, schema)
