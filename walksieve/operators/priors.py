"""Trailing priors, score blends and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import BY, UNB, clip, div, flag, logit, series_window, sigmoid, truth


def calendar_rate(targets: DataFrame, *, n: int | None = 48, lag: int = 2, min_labels: int = 24,
                  out: str = "prior", by=BY) -> DataFrame:
    """Up-rate of the labels at positions t-n-lag+1 .. t-lag; gaps shorten the sample."""
    lo = UNB if n is None else -(n + lag - 1)
    w = Window.partitionBy(*by, "series_id").orderBy("position").rangeBetween(lo, -lag)
    seen = F.count("y_true").over(w)
    return targets.withColumns({
        f"{out}_rows": seen, out: F.when(seen >= min_labels, F.avg("y_true").over(w)),
    })


def available_rate(targets: DataFrame, *, n: int = 48, lag: int = 2, min_labels: int = 24,
                   y: str = "y_true", out: str = "prior", by=BY, keys=("series_id",)) -> DataFrame:
    """Up-rate of the newest ``n`` existing labels at positions <= t-lag; gaps are skipped.

    The rate is formed on the label rows alone (a row frame over existing labels)
    and then carried forward to every later position.
    """
    has = F.col(y).isNotNull()
    w = Window.partitionBy(*by, *keys, has).orderBy("position").rowsBetween(-(n - 1), 0)
    t = targets.withColumns({
        "_rate": F.when(has, F.avg(y).over(w)), "_used": F.when(has, F.count(y).over(w)),
    })
    known = Window.partitionBy(*by, *keys).orderBy("position").rangeBetween(UNB, -lag)
    used = F.coalesce(F.last("_used", ignorenulls=True).over(known), F.lit(0))
    return t.withColumns({
        f"{out}_rows": used,
        out: F.when(used >= min_labels, F.last("_rate", ignorenulls=True).over(known)),
    }).drop("_rate", "_used")


def prior_blend(scores: DataFrame, *, p: str = "p_up_raw", prior: str = "prior", w: float = 0.5, out: str = "p_up") -> DataFrame:
    """w * prior + (1-w) * model; a missing model score falls back to the prior."""
    if not 0.0 <= w <= 1.0:
        raise ValueError("the prior weight must be between 0 and 1")
    return scores.withColumn(out, w * F.col(prior) + (1.0 - w) * F.coalesce(F.col(p), F.col(prior)))


def pattern_prior(rows: DataFrame, *, lag: int = 2, min_rows: int = 8, pattern: str = "exhaustion_flag",
                  prior: str = "p_down_prior", out: str = "p_down_pattern", by=BY) -> DataFrame:
    """Down-rate after earlier pattern rows, (hits+2)/(n+4), where the pattern is on now."""
    w = Window.partitionBy(*by, "series_id").orderBy("position").rangeBetween(UNB, -lag)
    seen = F.when((F.col(pattern) == 1.0) & F.col("y_true").isNotNull(), 1.0 - F.col("y_true"))
    n, hits = F.count(seen).over(w), F.sum(seen).over(w)
    post = F.when((F.col(pattern) == 1.0) & (n >= min_rows), (hits + 2.0) / (n + 4.0))
    return rows.withColumns({f"{out}_rows": n, out: F.coalesce(post, F.col(prior))})


def down_blend(df: DataFrame, *, local: float = 0.0, pattern: float = 0.0, out: str = "p_down") -> DataFrame:
    """Weighted mix of the Down components, bounded away from 0 and 1."""
    if min(local, pattern) < 0 or local + pattern > 1:
        raise ValueError("component weights must be non-negative and sum to at most one")
    mix = (1 - local - pattern) * F.col("p_down_global") + local * F.col("p_down_local") + pattern * F.col("p_down_pattern")
    return df.withColumn(out, clip(mix, 1e-6, 1 - 1e-6))


def mean_of(cols: list[str]):
    """Mean of the non-null columns."""
    known = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    return div(sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0)), known)


def group_strength(targets: DataFrame, groups: DataFrame, *, n: int = 12, lag: int = 2, tau: float | None = None, by=BY) -> DataFrame:
    """Recent Up-rate of each group against the market, as rates and as a log-odds difference.

    With ``tau`` the group rate is shrunk to the market by that many pseudo-labels.
    """
    g = targets.join(groups, "series_id", "left").withColumn("group_id", F.coalesce("group_id", F.lit("ungrouped")))
    per = g.groupBy(*by, "group_id", "position").agg(F.sum("y_true").alias("_s"), F.count("y_true").alias("_n"))
    m = per.groupBy(*by, "position").agg(F.sum("_s").alias("_ms"), F.sum("_n").alias("_mn"))
    frame = lambda keys: Window.partitionBy(*keys).orderBy("position").rangeBetween(-(n + lag - 1), -lag)
    wg, wm = frame([*by, "group_id"]), frame(list(by))
    m = m.select(*by, "position", div(F.sum("_ms").over(wm), F.sum("_mn").over(wm)).alias("market_prior"))
    per = per.select(*by, "group_id", "position", F.sum("_s").over(wg).alias("_gs"), F.sum("_n").over(wg).alias("_gn")).join(m, [*by, "position"])
    rate = div(F.col("_gs"), F.col("_gn"))
    if tau is not None:
        rate = (F.coalesce("_gs", F.lit(0.0)) + tau * F.col("market_prior")) / (F.coalesce("_gn", F.lit(0)) + tau)
    per = per.withColumn("group_prior", F.coalesce(rate, F.col("market_prior")))
    return per.select(*by, "group_id", "position", "group_prior", "market_prior",
                      (logit("group_prior", 1e-4) - logit("market_prior", 1e-4)).alias("group_relative_logit"),
                      (F.col("position") - lag).alias("group_fit_through"))


def logit_add(scores: DataFrame, *, p: str, signal: str, w, out: str, eps: float = 1e-4) -> DataFrame:
    return scores.withColumn(out, sigmoid(logit(p, eps) + w * F.coalesce(F.col(signal), F.lit(0.0))))


def shrink(df: DataFrame, *, p_local: str, p_global: str, w, out: str) -> DataFrame:
    w = F.col(w) if isinstance(w, str) else F.lit(w)
    return df.withColumn(out, clip(w * F.col(p_local) + (1.0 - w) * F.col(p_global), 1e-6, 1 - 1e-6))


def ramp_weight(df: DataFrame, *, w_max: float, n_min: int, n_ref: int, rows: str = "local_rows", fallback: str = "fallback_used", out: str = "local_weight"):
    """Weight that grows with a series' own history; zero where the pooled score was used."""
    if n_ref <= n_min:
        raise ValueError("n_ref must exceed n_min")
    ramp = w_max * clip((F.col(rows) - n_min) / float(n_ref - n_min), 0.0, 1.0)
    return df.withColumn(out, F.when(F.col(fallback), 0.0).otherwise(ramp))


def group_reliability(scores: DataFrame, *, n: int, lag: int = 2, ridge: float = 1.0, max_w: float = 0.75,
                      positive_only: bool = True, p: str = "p_graph", signal: str = "group_relative_logit", by=BY) -> DataFrame:
    """How much the group signal explained of past residuals; every month counts the same."""
    keys = [*by, "position"]
    d = scores.where(F.col(p).isNotNull() & F.col(signal).isNotNull() & F.col("y_true").isNotNull())
    # centred products from plain sums: mean(s*r) - mean(s)*mean(r), mean(s^2) - mean(s)^2
    s, r = F.col(signal), F.col("y_true") - F.col(p)
    m = d.groupBy(*keys).agg((F.avg(s * r) - F.avg(s) * F.avg(r)).alias("_a"), (F.avg(s * s) - F.avg(s) * F.avg(s)).alias("_b"))
    every = scores.select(*keys).distinct().join(m, keys, "left")
    w = Window.partitionBy(*by).orderBy("position").rangeBetween(-(n + lag - 1), -lag)
    raw = F.coalesce(div(F.sum("_a").over(w), F.coalesce(F.sum("_b").over(w), F.lit(0.0)) + ridge), F.lit(0.0))
    lo = 0.0 if positive_only else -max_w
    return every.select(*keys, raw.alias("raw_weight"), F.count("_a").over(w).alias("history_months")).withColumn(
        "reliability_weight", clip("raw_weight", lo, max_w))


def reliability_score(scores: DataFrame, weights: DataFrame, *, trigger: float = 0.5, p: str = "p_graph", by=BY) -> DataFrame:
    d = scores.join(weights.select(*by, "position", "reliability_weight"), [*by, "position"], "left")
    z = logit(p, 1e-4) + F.coalesce("reliability_weight", F.lit(0.0)) * F.coalesce("group_relative_logit", F.lit(0.0))
    excess = clip((F.coalesce("regime_stress", F.lit(0.0)) - trigger) / max(1e-6, 1 - trigger), 0.0, 1.0)
    d = d.withColumn("p_group_reliability", sigmoid(z))
    return d.withColumn("score_group_reliability", clip(
        F.col("p_group_reliability") * (1.0 - 0.25 * excess) - 0.15 * F.coalesce("p_down", F.lit(0.5)), 1e-6, 1.0))


def eb_rate(df: DataFrame, *, rate: str = "prior", rows: str = "prior_rows", out: str = "eb_prior", by=BY) -> DataFrame:
    """Shrink rates to their cross-section mean; the between-series variance is a moment estimate."""
    keys = [*by, "position"]
    ok = F.col(rate).isNotNull() & (F.col(rows) > 0)
    m = df.where(ok).groupBy(*keys).agg(F.avg(rate).alias("_m"), F.var_samp(rate).alias("_v"), F.avg(div(F.lit(1.0), F.col(rows))).alias("_i"))
    d = df.join(m, keys, "left")
    pq = F.col("_m") * (1 - F.col("_m"))
    tau2 = F.greatest(F.lit(0.0), F.coalesce(F.col("_v"), F.lit(0.0)) - pq * F.col("_i"))
    w = F.when(tau2 > 0, tau2 / (tau2 + div(pq, F.col(rows)))).otherwise(0.0)
    return d.withColumn(out, F.when(ok, F.col("_m") + w * (F.col(rate) - F.col("_m")))).drop("_m", "_v", "_i")


def seasonal_dev(targets: DataFrame, *, lag: int = 2, min_cell: int = 3, min_labels: int = 24, by=BY) -> DataFrame:
    """Same-calendar-month Up-rate minus the all-history rate, shrunk by a pooled variance.

    Per (series, calendar month) running counts give every cell at every position;
    the pooled variance is a mean over all cells of the period.
    """
    t = targets.withColumn("change_month", F.month(F.add_months("month", 1)))
    w = Window.partitionBy(*by, "series_id").orderBy("position").rangeBetween(UNB, -lag)
    cells = {}
    for m in range(1, 13):
        in_m = F.when(F.col("change_month") == m, F.col("y_true"))
        cells[f"_n{m}"] = F.count(in_m).over(w)
        cells[f"_k{m}"] = F.coalesce(F.sum(in_m).over(w), F.lit(0.0))
    t = t.withColumns({**cells, "_c": F.count("y_true").over(w), "_b": F.avg("y_true").over(w)})
    pq = F.col("_b") * (1 - F.col("_b"))

    def cell(n, k):
        dev = div(k, n) - F.col("_b")
        smp = pq * (div(F.lit(1.0), n) - div(F.lit(1.0), F.col("_c")))
        ok = truth((n >= min_cell) & (F.col("_c") >= min_labels) & (pq > 0) & (smp > 0))
        return dev, smp, ok

    over = [cell(F.col(f"_n{m}"), F.col(f"_k{m}")) for m in range(1, 13)]
    t = t.withColumns({
        "_x": sum((F.when(ok, d * d - s).otherwise(0.0) for d, s, ok in over), F.lit(0.0)),
        "_v": sum((ok.cast("int") for _, _, ok in over), F.lit(0)),
    })
    pool = t.groupBy(*by, "position").agg(F.greatest(F.lit(0.0), F.coalesce(div(F.sum("_x"), F.sum("_v")), F.lit(0.0))).alias("seasonal_tau2"))
    now_n = F.coalesce(*[F.when(F.col("change_month") == m, F.col(f"_n{m}")) for m in range(1, 13)])
    now_k = F.coalesce(*[F.when(F.col("change_month") == m, F.col(f"_k{m}")) for m in range(1, 13)])
    dev, smp, ok = cell(now_n, now_k)
    tau2 = F.col("seasonal_tau2")
    wt = F.when(ok & (tau2 > 0), tau2 / (tau2 + smp)).otherwise(0.0)
    j = t.join(pool, [*by, "position"])
    return j.select(*by, "series_id", "position", "seasonal_tau2",
                    F.when(ok, wt * dev).otherwise(0.0).alias("seasonal_shrunk"), F.when(ok, dev).otherwise(0.0).alias("seasonal_raw"))


def rank_ensemble(df: DataFrame, cols: list[str], *, min_present: int = 3, out: str = "window_ensemble", by=BY) -> DataFrame:
    """Mean of the percentile ranks of several scores; all are ranked in one long pass."""
    from ..functions.ordering import pct_rank

    keys = [*by, "position", "series_id"]
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(keys, cols, "_f", "_x")
    r = pct_rank(long, [*by, "position", "_f"], "_x", "_k")
    m = r.groupBy(*keys).agg(F.when(F.count("_k") >= min_present, F.avg("_k")).alias(out))
    return df.join(m, keys, "left")


def blend_arms(df: DataFrame, *, up_w: float, down_w: float, source: str = "opposite") -> DataFrame:
    """Mix each direction's score with the opposite evidence or with its own prior."""
    if source not in ("opposite", "prior"):
        raise ValueError(f"unknown source {source}")
    c = F.col
    up_o, dn_o = ((1 - c("p_down_arm"), 1 - c("p_up_arm")) if source == "opposite" else (c("p_up_prior_arm"), c("p_down_prior_arm")))
    return df.withColumns({"up_cal": up_w * c("p_up_arm") + (1 - up_w) * up_o, "down_cal": down_w * c("p_down_arm") + (1 - down_w) * dn_o})


def joint_score(df: DataFrame, up: str = "up_cal", down: str = "down_cal") -> DataFrame:
    """Complementary scores of both directions on one scale."""
    j = 0.5 * (F.col(up) + 1 - F.col(down))
    return df.withColumns({"joint_p_up": j, "joint_p_down": 1 - j})


def miss_overlay(df: DataFrame, *, base: float = 0.45, relax: float = 0.10, full: int = 4, zero: int = 1, bonus: float = 0.30,
                 strength: float = 0.40, std_penalty: float = 0.5, p: str = "p_select", out: str = "p_overlay") -> DataFrame:
    """Lower the log-odds of recently missed series, raise those of steadily rising groups."""
    n = F.coalesce("recent_call_count", F.lit(0.0))
    h = clip((n - zero) / max(1, full - zero), 0.0, 1.0)
    thr = base - relax * h
    miss = F.greatest(F.col("recent_miss_rate") - thr, F.lit(0.0)) / F.greatest(1.0 - thr, F.lit(1e-3))
    miss = clip(F.coalesce(F.when(F.col("recent_miss_rate").isNotNull() & (n >= zero), miss), F.lit(0.0)), 0.0, 1.0) * h
    steady = clip(F.coalesce("group_up_rate", F.lit(0.5)) - 0.5 - std_penalty * F.coalesce("group_up_std", F.lit(0.2)), -0.5, 0.5)
    return df.withColumn(out, clip(sigmoid(logit(p) - strength * miss + bonus * steady), 1e-6, 1 - 1e-6))


def unify(df: DataFrame, kind: str, *, up: str = "p_up", down: str = "p_down", up_cal: str = "up_cal", down_cal: str = "down_cal", by=BY) -> DataFrame:
    """One score and direction per series from both arms."""
    if kind in ("raw_max", "margin"):
        a, b = F.col(up), F.col(down)
    elif kind in ("calibrated_max", "calibrated_margin"):
        a, b = F.col(up_cal), F.col(down_cal)
    elif kind == "percentile_max":
        from ..functions.ordering import pct_rank

        keys = [*by, "position", "series_id"]
        long = df.select(*keys, F.col(up).alias("u"), F.col(down).alias("d")).unpivot(keys, ["u", "d"], "_f", "_x")
        r = pct_rank(long, [*by, "position", "_f"], "_x", "_k").groupBy(*keys).agg(
            F.max(F.when(F.col("_f") == "u", F.col("_k"))).alias("_u"), F.max(F.when(F.col("_f") == "d", F.col("_k"))).alias("_d"))
        df = df.join(r, keys, "left")
        a, b = F.col("_u"), F.col("_d")
    else:
        raise ValueError(f"unknown unified score {kind}")
    score = F.abs(a - b) if kind.endswith("margin") else F.greatest(a, b)
    return df.withColumns({"unified_score": score, "unified_direction": F.when(b > a, "Down").otherwise("Up")}).drop("_u", "_d")
