"""Composed jobs: each chains operators on tables, nothing is decided on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import BY, flag
from ..operators import features as X
from ..operators import graph as E
from ..operators import metrics as I
from ..operators import models as Z
from ..operators import priors as G
from ..operators import resample as J
from ..operators import select as H
from ..operators import targets as T


def uptrend_baseline(panel: DataFrame, cols: list[str], *, lo: int, hi: int, graph_upto: int, k: int = 15, n_prior: int = 48,
                     min_labels: int = 24, alpha: float = 0.35, w_prior: float = 0.5, train: DataFrame | None = None) -> DataFrame:
    """Features, walk-forward logistic, frozen graph, trailing prior, top-k Up calls."""
    keys = [*BY, "position", "series_id"]
    t = T.direction_targets(panel)
    rows = train if train is not None else X.feature_panel(panel).drop("month", "value").join(t.select(*keys, "y_true"), keys)
    s = Z.walk_forward(rows, cols, lo=lo, hi=hi, out="p_raw").select(*keys, "y_true", "p_raw", "fit_through")
    s = E.propagate(s.where("p_raw is not null"), E.frozen_graph(panel, upto=graph_upto), p="p_raw", alpha=alpha, out="p_up_raw")
    prior = G.available_rate(t, n=n_prior, min_labels=min_labels).select(*keys, "prior")
    s = G.prior_blend(s.join(prior, keys, "left"), w=w_prior).withColumn("ready", F.col("prior").isNotNull())
    return H.top_k(s, "p_up", k)


def shock_clustering(drops: DataFrame, *, share: float = 0.25, by=BY) -> tuple[DataFrame, DataFrame]:
    """(systemic months, how often a shock follows a shock and a quiet month)."""
    from ..functions.columns import series_window

    d = drops.where("label_valid")
    m = d.groupBy(*by, "position").agg(F.avg(F.col("sudden_drop").cast("double")).alias("shock_share")).where(F.col("shock_share") >= share)
    nxt = F.lead(F.when(F.col("label_valid"), F.col("sudden_drop").cast("double"))).over(series_window(by=by))
    f = drops.withColumn("_n", nxt).where("label_valid").groupBy("sudden_drop").agg(F.count("_n").alias("months"), F.avg("_n").alias("next_shock_rate"))
    return m, f


def next_periods(panel: DataFrame, *, hs=(1, 2, 3), k: int = 5, **kw) -> DataFrame:
    """One document per horizon from the newest origin."""
    from ..sources.snapshot import nest_forecast

    last = panel.groupBy(*BY).agg(F.max("position").alias("_last"))
    c = H.forecast_horizons(panel, hs, k=k, **kw).join(last, list(BY)).where("position = _last")
    return nest_forecast(c.select(*BY, "horizon", F.col("forecast_month").alias("month"), "rank", "series_id", "direction", "score"))


def locked_evaluation(policies: dict[str, DataFrame], lo: int, hi: int, *, reps: int = 500, seed: int = 1) -> DataFrame:
    """Several fixed policies on one window with a ratio bootstrap each."""
    from functools import reduce

    parts = []
    for name, calls in policies.items():
        c = calls.where(F.col("position").between(lo, hi))
        m = I.monthly(c)
        b = J.block_bootstrap(m, F.sum("hits") / F.sum("calls"), reps=reps, seed=seed, scheme="moving", qs=(0.05, 0.95))
        parts.append(b.withColumn("policy", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def context_export(panel: DataFrame, *, n: int = 36) -> DataFrame:
    """One content-keyed JSON context per origin and series."""
    c = X.context(panel, n=n)
    body = F.to_json(F.struct("directions", "share_rising", F.col("standardised_changes").alias("standardised_changes")))
    return c.where("directions is not null").select(*BY, "position", "series_id", body.alias("state")).withColumn("key", F.sha2("state", 256))


def signal_study(months: DataFrame, signals: list[str], windows: dict) -> DataFrame:
    """AUC of each signal for the flip target per window; the tuning window fixes its sign."""
    keys = ["position", "flip_target", *signals]
    long = T.in_windows(months, windows).select("window", "position", "flip_target", *signals).unpivot(["window", "position", "flip_target"], signals, "signal", "x")
    a = I.auc(long.withColumn("y", F.col("flip_target").cast("double")), "x", "y", ["window", "signal"])
    t = a.where("window = 'tuning'").select("signal", F.when(F.col("auc") >= 0.5, 1).otherwise(-1).alias("sign"))
    return a.join(t, "signal", "left")


def family_ablation(rows: DataFrame, configs: dict[str, list[str]], *, lo: int, hi: int, **kw) -> DataFrame:
    """AUC and Brier score of the walk-forward model under each feature list."""
    from functools import reduce

    parts = []
    for name, cols in configs.items():
        s = Z.walk_forward(rows, cols, lo=lo, hi=hi, **kw).where("p is not null and y_true is not null").withColumn("config", F.lit(name))
        parts.append(s.select("config", "position", "series_id", "y_true", "p"))
    d = reduce(lambda a, b: a.unionByName(b), parts)
    return d.groupBy("config").agg(F.count(F.lit(1)).alias("rows"), I.brier("p", "y_true").alias("brier")).join(I.auc(d, "p", "y_true", ["config"]), "config")
