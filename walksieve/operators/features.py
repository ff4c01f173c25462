"""Causal per-series features.

Everything at ``position`` t uses values up to t-1.  Rolling features read the
frame ``t-k .. t-1`` of the raw value, so most of them need a single window node;
all windows share one partitioning and one sort per series.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (
    BY, UNB, array_mad, clip, div, flag, lag, market_window, roll, roll_quantile, series_window, truth,
)

DIRECTION_LAGS = (1, 2, 3, 6, 12)
MOMENTUM_SPANS = (3, 6, 9, 12)

LEVEL = ["level", "diff_1", "pct_change_1", "direction_1"]
DIRECTION = [f"direction_lag_{k}" for k in DIRECTION_LAGS]
CHANGE = [f"change_lag_{k}" for k in DIRECTION_LAGS]
MOMENTUM = [f"momentum_{k}" for k in MOMENTUM_SPANS]
ROLLING = ["rolling_mean_12", "rolling_std_12", "rolling_mad_12", "robust_z_12", "distance_mean_6", "distance_mean_12"]
ISLANDS = ["stale_run", "observed", "time_since_observation", "signed_run_length"]
RISK = ["return_volatility_12", "risk_normalized_momentum_3", "risk_normalized_momentum_6"]

# Optional feature families of the walk-forward model.
FAMILIES = {
    "trend_persistence": ["signed_run_length", "momentum_acceleration_3"],
    "cross_sectional_dynamics": ["cross_section_rank_change_1", "cross_section_rank_change_3",
                                 "breadth_impulse_3", "dispersion_change_3"],
    "risk_normalized": RISK,
}


def _level(k: int = 0, by=BY):
    """Value observable k periods before the newest observable one."""
    return lag("value", 1 + k, by)


def _diff(k: int = 0, by=BY):
    return _level(k, by) - _level(k + 1, by)


def _momentum(k: int, start: int = 0, by=BY):
    return div(_level(start, by), _level(start + k, by)) - 1.0


def _ret(k: int = 0, by=BY):
    return _momentum(1, k, by)


def lag_features(panel: DataFrame, by=BY) -> DataFrame:
    """Level, change, its direction and their lags; an unknown change stays null."""
    cols = {
        "level": _level(0, by),
        "diff_1": _diff(0, by),
        "pct_change_1": div(_diff(0, by), _level(1, by)),
        "direction_1": flag(_diff(0, by) > 0),
    }
    for k in DIRECTION_LAGS:
        cols[f"direction_lag_{k}"] = flag(_diff(k, by) > 0)
        cols[f"change_lag_{k}"] = _diff(k, by)
    return panel.withColumns(cols)


def momentum(panel: DataFrame, ks=MOMENTUM_SPANS, by=BY) -> DataFrame:
    cols = {f"momentum_{k}": _momentum(k, 0, by) for k in ks}
    cols["momentum_acceleration_3"] = _momentum(3, 0, by) - _momentum(3, 3, by)
    return panel.withColumns(cols)


def rolling_level(panel: DataFrame, *, k: int = 12, m: int = 6, by=BY) -> DataFrame:
    w = series_window(-k, -1, by)
    p = panel.withColumns({
        f"rolling_mean_{k}": roll(F.avg, "value", k, m, by=by, lag_rows=1),
        f"rolling_std_{k}": roll(F.stddev_samp, "value", k, m, by=by, lag_rows=1),
        "_past": F.collect_list("value").over(w),
        "_half": roll(F.avg, "value", k // 2, m // 2, by=by, lag_rows=1),
        "_src": _level(0, by),
    })
    p = p.withColumn(f"rolling_mad_{k}", F.when(F.size("_past") >= m, array_mad(F.col("_past"))))
    src, mean = F.col("_src"), F.col(f"rolling_mean_{k}")
    return p.withColumns({
        f"robust_z_{k}": div(src - mean, 1.4826 * F.col(f"rolling_mad_{k}")),
        f"distance_mean_{k // 2}": div(src, F.col("_half")) - 1.0,
        f"distance_mean_{k}": div(src, mean) - 1.0,
    }).drop("_past", "_half", "_src")


def _run_start(cond, by=BY):
    """Position where the current run began; positions start at 1."""
    return F.coalesce(F.max(F.when(cond, F.col("position"))).over(series_window(UNB, 0, by)), F.lit(1))


def stale_run(panel: DataFrame, by=BY) -> DataFrame:
    """Periods since the level last changed, null where the level is missing."""
    p = panel.withColumn("_src", _level(0, by)).withColumn("_new", truth(_diff(0, by) != 0))
    run = (F.col("position") - _run_start(F.col("_new"), by)).cast("double")
    return p.withColumn("stale_run", F.when(F.col("_src").isNotNull(), run)).drop("_src", "_new")


def since_observed(panel: DataFrame, by=BY) -> DataFrame:
    p = panel.withColumn("_seen", _level(0, by).isNotNull())
    return p.withColumns({
        "observed": F.col("_seen").cast("double"),
        "time_since_observation": (F.col("position") - _run_start(F.col("_seen"), by)).cast("double"),
    }).drop("_seen")


def signed_run(panel: DataFrame, by=BY) -> DataFrame:
    """Length of the current run of same-sign changes, signed; a zero or missing change breaks it."""
    p = panel.withColumns({"_s": F.signum(_diff(0, by)), "_b": F.signum(_diff(1, by))})
    starts = ~F.col("_s").eqNullSafe(F.col("_b"))
    run = F.col("position") - _run_start(starts, by) + 1
    return p.withColumn("_run", run).withColumn("signed_run_length", F.col("_s") * F.col("_run")).drop("_s", "_b", "_run")


def risk_momentum(panel: DataFrame, by=BY) -> DataFrame:
    """Return volatility and momentum in units of it."""
    p = panel.withColumns({"_r": _ret(0, by), "_m3": _momentum(3, 0, by), "_m6": _momentum(6, 0, by)})
    p = p.withColumn("return_volatility_12", roll(F.stddev_samp, "_r", 12, 6, by=by))
    vol = F.col("return_volatility_12")
    return p.withColumns({
        "risk_normalized_momentum_3": div(F.col("_m3"), vol * math.sqrt(3.0)),
        "risk_normalized_momentum_6": div(F.col("_m6"), vol * math.sqrt(6.0)),
    }).drop("_r", "_m3", "_m6")


DOWNSIDE = ["return_1", "return_lag_1", "return_lag_2", "momentum_3", "momentum_6", "momentum_12", "volatility_3",
            "volatility_6", "volatility_12", "drawdown_12", "distance_mean_12", "negative_share_3"]


def _returns(panel: DataFrame, by=BY, ks=(3, 6, 12)) -> DataFrame:
    cols = {f"return_lag_{k}" if k else "return_1": _ret(k, by) for k in (0, 1, 2)}
    cols |= {f"momentum_{k}": _momentum(k, 0, by) for k in ks}
    return panel.withColumns(cols)


def downside_features(panel: DataFrame, by=BY) -> DataFrame:
    p = _returns(panel, by)
    src = _level(0, by)
    r = F.col("return_1")
    return p.withColumns({
        "volatility_3": roll(F.stddev_samp, r, 3, 2, by=by),
        "volatility_6": roll(F.stddev_samp, r, 6, 3, by=by),
        "volatility_12": roll(F.stddev_samp, r, 12, 6, by=by),
        "drawdown_12": div(src, roll(F.max, "value", 12, 6, by=by, lag_rows=1)) - 1.0,
        "distance_mean_12": div(src, roll(F.avg, "value", 12, 6, by=by, lag_rows=1)) - 1.0,
        "negative_share_3": roll(F.avg, flag(r < 0), 3, 2, by=by),
    })


REVERSAL = ["rise_6_before_2", "stall_2", "rise_score", "stall_score", "exhaustion_score", "exhaustion_flag",
            "near_high_12", "deceleration_2_vs_4", "volatility_compression"]


def reversal_features(panel: DataFrame, by=BY) -> DataFrame:
    """Signs of a rise that is running out: a six-period rise followed by a two-period stall."""
    p = _returns(panel, by, ())
    r = F.col("return_1")
    p = p.withColumns({
        "rise_6_before_2": _momentum(6, 2, by),
        "stall_2": _momentum(2, 0, by),
        "_v3": roll(F.stddev_samp, r, 3, 2, by=by),
        "_v12": roll(F.stddev_samp, r, 12, 6, by=by),
        "_v24": roll(F.stddev_samp, r, 24, 12, by=by),
        "_two": roll(F.avg, r, 2, 2, by=by),
        "_four": roll(F.avg, r, 4, 3, by=by, lag_rows=2),
        "_high": roll(F.max, "value", 12, 6, by=by, lag_rows=1),
        "_src": _level(0, by),
    })
    p = p.withColumns({
        "rise_score": div(F.col("rise_6_before_2"), F.col("_v24") * math.sqrt(6.0)),
        "stall_score": div(F.abs("stall_2"), F.col("_v24") * math.sqrt(2.0)),
    })
    worn = (F.col("rise_6_before_2") > 0) & (F.col("rise_score") >= 0.5) & (F.col("stall_score") <= 0.5)
    return p.withColumns({
        "exhaustion_score": F.col("rise_score") - F.col("stall_score"),
        "exhaustion_flag": truth(worn).cast("double"),
        "near_high_12": truth(F.col("_src") >= 0.98 * F.col("_high")).cast("double"),
        "deceleration_2_vs_4": F.col("_four") - F.col("_two"),
        "volatility_compression": div(F.col("_v3"), F.col("_v12")),
    }).drop("_v3", "_v12", "_v24", "_two", "_four", "_high", "_src", "return_lag_1", "return_lag_2")


def trailing_z(panel: DataFrame, *, k: int = 60, m: int = 24, by=BY) -> DataFrame:
    """One- and three-period changes against their own previous ``k`` values."""
    p = panel.withColumns({"_d1": _diff(0, by), "_d3": _level(0, by) - _level(3, by)})
    cols = {}
    for name, x in (("ret1_z", "_d1"), ("mom3_z", "_d3")):
        mean = roll(F.avg, x, k, m, by=by, lag_rows=1)
        std = roll(F.stddev_samp, x, k, m, by=by, lag_rows=1)
        cols[name] = div(F.col(x) - mean, std)
    return p.withColumns(cols).drop("_d1", "_d3")


def consecutive_down(panel: DataFrame, by=BY) -> DataFrame:
    """0..3 non-rising changes in a row, newest first."""
    d1, d2, d3 = (flag(_diff(k, by) <= 0) for k in range(3))
    return panel.withColumn("consec_down", d1 + d1 * d2 + d1 * d2 * d3)


def previous_shock(panel: DataFrame, *, k: int = 60, m: int = 24, q: float = 0.05, by=BY) -> DataFrame:
    p = panel.withColumn("_d", _diff(0, by))
    tail = roll_quantile("_d", q, k, m, by=by, lag_rows=1)
    return p.withColumn("_tail", tail).withColumn(
        "prev_shock", F.when(F.col("_tail").isNotNull(), flag((F.col("_d") < 0) & (F.col("_d") <= F.col("_tail"))))
    ).drop("_d", "_tail")


def relative_scale(panel: DataFrame, by=BY) -> DataFrame:
    std = roll(F.stddev_samp, "value", 12, 6, by=by, lag_rows=1)
    mean = roll(F.avg, "value", 12, 6, by=by, lag_rows=1)
    return panel.withColumns({
        "relative_volatility_12": div(F.when(std != 0, std), F.abs(mean)),
        "diff_z_12": div(_diff(0, by), std),
        "momentum_acceleration_3_12": _momentum(3, 0, by) - _momentum(12, 0, by),
    })


def log_shock(panel: DataFrame, *, k: int = 36, m: int = 24, by=BY) -> DataFrame:
    """Log change in units of its earlier spread."""
    ln = lambda x: F.when(x > 0, F.ln(x))
    p = panel.withColumn("_c", ln(_level(0, by)) - ln(_level(1, by)))
    scale = roll(F.stddev_samp, "_c", k, m, by=by, lag_rows=1)
    p = p.withColumn("log_shock", div(F.col("_c"), scale))
    return p.withColumn("abs_log_shock", F.abs("log_shock")).drop("_c")


def ma_flags(panel: DataFrame, by=BY) -> DataFrame:
    src = _level(0, by)
    return panel.withColumns({
        "above_ma_10": flag(src > roll(F.avg, "value", 10, 10, by=by, lag_rows=1)),
        "above_12_ago": flag(src > _level(12, by)),
    })


BREAKDOWN = ["dist_high_3", "dist_high_6", "dist_high_12", "below_mean_3", "below_mean_6", "return_after_high_6",
             "lower_high", "momentum_turn_neg", "negative_acceleration", "reversal_after_strength",
             "failed_recovery", "z_1", "z_3", "neg_z_share_3"]


def breakdown_features(panel: DataFrame, by=BY) -> DataFrame:
    """Loss of structure: distance to recent highs, lower highs, turning momentum, weak z-scores."""
    high = lambda k, m: roll(F.max, "value", k, m, by=by, lag_rows=1)
    mean = lambda k, m: roll(F.avg, "value", k, m, by=by, lag_rows=1)
    p = panel.withColumns({
        "_src": _level(0, by), "_r": _ret(0, by), "_h3": high(3, 2), "_h6": high(6, 3), "_h12": high(12, 6),
        "_a3": mean(3, 2), "_a6": mean(6, 3), "_m3": _momentum(3, 0, by), "_m6": _momentum(6, 0, by),
        "_m12": _momentum(12, 0, by),
    })
    c = F.col
    p = p.withColumn("z_1", div(c("_r"), roll(F.stddev_samp, "_r", 12, 6, by=by)))
    num = lambda cond: truth(cond).cast("double")
    d6 = div(c("_src"), c("_h6"))
    return p.withColumns({
        "dist_high_3": div(c("_src"), c("_h3")), "dist_high_6": d6, "dist_high_12": div(c("_src"), c("_h12")),
        "below_mean_3": num(c("_src") < c("_a3")), "below_mean_6": num(c("_src") < c("_a6")),
        "return_after_high_6": d6 - 1.0,
        "lower_high": num(c("_h3") < c("_h6")),
        "momentum_turn_neg": num((c("_m3") < 0) & (c("_m6") > 0)),
        "negative_acceleration": c("_m3") - c("_m6"),
        "reversal_after_strength": c("_m3") * num(c("_m12") > 0),
        "failed_recovery": num((c("_r") > 0) & (d6 < 1.0)),
        "z_3": roll(F.avg, "z_1", 3, 2, by=by),
        "neg_z_share_3": roll(F.avg, flag(c("z_1") < 0), 3, 2, by=by),
    }).drop("_src", "_r", "_h3", "_h6", "_h12", "_a3", "_a6", "_m3", "_m6", "_m12")


STRENGTH = ["pos_share_3", "pos_share_6", "strength_momentum_3", "strength_momentum_6", "vol_adj_momentum_3",
            "trend_slope_3", "trend_consistency_6"]


def strength_features(panel: DataFrame, by=BY) -> DataFrame:
    p = panel.withColumns({
        "_r": _ret(0, by), "strength_momentum_3": _momentum(3, 0, by), "strength_momentum_6": _momentum(6, 0, by),
    })
    up = flag(F.col("_r") > 0)
    m3, m6 = F.col("strength_momentum_3"), F.col("strength_momentum_6")
    return p.withColumns({
        "pos_share_3": roll(F.avg, up, 3, 1, by=by),
        "pos_share_6": roll(F.avg, up, 6, 3, by=by),
        "vol_adj_momentum_3": div(m3, roll(F.stddev_samp, "_r", 12, 6, by=by)),
        "trend_slope_3": roll(F.avg, "_r", 3, 2, by=by),
        "trend_consistency_6": m6 * truth(m3 > 0).cast("double"),
    }).drop("_r")


def context(panel: DataFrame, *, n: int = 36, by=BY) -> DataFrame:
    """Newest ``n`` known changes at t-1: standardised values, U/D/= string, share rising."""
    p = panel.withColumn("_d", F.col("value") - lag("value", 1, by))
    has = F.col("_d").isNotNull()
    own = Window.partitionBy(*by, "series_id", has).orderBy("position").rowsBetween(-(n - 1), 0)
    p = p.withColumns({
        "_list": F.when(has, F.collect_list("_d").over(own)),
        "_sd": F.when(has, F.stddev_pop("_d").over(own)),
        "_up": F.when(has, F.avg((F.col("_d") > 0).cast("double")).over(own)),
    })
    known = series_window(UNB, -1, by)
    last = lambda c: F.last(c, ignorenulls=True).over(known)
    p = p.withColumns({"_list": last("_list"), "_sd": last("_sd"), "_up": last("_up")})
    sd = F.col("_sd")
    return p.withColumns({
        "standardised_changes": F.transform(
            "_list", lambda x: F.round(F.when(sd > 0, x / sd).otherwise(0.0), 2) + F.lit(0.0)),
        "directions": F.array_join(F.transform(
            "_list", lambda x: F.when(x > 0, "U").when(x < 0, "D").otherwise("=")), ""),
        "share_rising": F.round("_up", 3),
    }).drop("_list", "_sd", "_up", "_d")


def market_context(market: DataFrame, *, n: int = 36, breadth: str = "breadth_raw", by=BY) -> DataFrame:
    """Newest ``n`` known breadth values before each position of a one-row-per-period table."""
    has = F.col(breadth).isNotNull()
    own = Window.partitionBy(*by, has).orderBy("position").rowsBetween(-(n - 1), 0)
    m = market.withColumn("_l", F.when(has, F.collect_list(F.round(breadth, 3)).over(own)))
    return m.withColumn("monthly_share_rising", F.last("_l", ignorenulls=True).over(market_window(UNB, -1, by))).drop("_l")


def diff_context(panel: DataFrame, *, lag: int = 1, by=BY) -> DataFrame:
    """Differences of everything observed up to t-lag, after the leading gap; null with fewer than two values."""
    known = series_window(UNB, -lag, by)
    first = F.min(F.when(F.col("value").isNotNull(), F.col("position"))).over(
        Window.partitionBy(*by, "series_id"))
    p = panel.withColumn("_first", first)
    # a struct keeps inner gaps; rows before the first value are left out
    cell = F.when(F.col("position") >= F.col("_first"), F.struct(F.col("value").alias("v")))
    p = p.withColumn("_a", F.collect_list(cell).over(known))
    n = F.size("_a")
    diffs = F.zip_with(F.slice("_a", 2, n - 1), F.slice("_a", 1, n - 1), lambda b, a: b["v"] - a["v"])
    return p.withColumn("context", F.when(n >= 2, diffs)).drop("_a", "_first")


def calendar_enc(df: DataFrame, month: str = "month") -> DataFrame:
    angle = 2.0 * math.pi * F.month(month) / 12.0
    return df.withColumns({"month_sin": F.sin(angle), "month_cos": F.cos(angle), "time_index": F.col("position") / 100.0})


def causal_percentile(market: DataFrame, col: str, *, out: str | None = None, min_n: int = 12,
                      default: float = 0.5, by=BY) -> DataFrame:
    """Share of earlier values that do not exceed this one; ``default`` until ``min_n`` are known."""
    past = F.collect_list(col).over(market_window(UNB, -1, by))
    m = market.withColumn("_h", past)
    known = F.size("_h")
    share = F.size(F.filter("_h", lambda x: x <= F.col(col))) / known
    ok = F.col(col).isNotNull() & (known >= min_n)
    return m.withColumn(out or f"{col}_pct", F.when(ok, share).otherwise(default)).drop("_h")


def expanding_threshold(market: DataFrame, col: str, q: float, *, out: str = "threshold", min_n: int = 24, by=BY) -> DataFrame:
    """(1-q) quantile of the strictly earlier values."""
    w = market_window(UNB, -1, by)
    return market.withColumn(out, F.when(F.count(col).over(w) >= min_n, F.percentile(col, F.lit(1.0 - q)).over(w)))


def recent_miss(targets: DataFrame, *, k: int = 6, lag: int = 1, by=BY) -> DataFrame:
    """Share of Down outcomes among the ``k`` labels before the newest one, known at label + lag + 1."""
    m = max(2, k // 3)
    t = targets.where("y_true is not null")
    miss = 1.0 - F.col("y_true")
    w = series_window(-k, -1, by)
    n = F.count("y_true").over(w)
    return t.select(
        *by, "series_id", (F.col("position") + lag + 1).alias("position"),
        F.when(n >= m, F.avg(miss).over(w)).alias("recent_miss_rate"),
        F.when(n >= m, n.cast("double")).alias("recent_call_count"),
    )


def feature_panel(panel: DataFrame, by=BY) -> DataFrame:
    """All per-series features of the walk-forward model."""
    p = rolling_level(momentum(lag_features(panel, by), by=by), by=by)
    return risk_momentum(signed_run(since_observed(stale_run(p, by), by), by), by)
