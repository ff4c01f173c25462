"""Feature tables of the walk-forward model and of the market forecast, put together from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import BY, div
from ..operators import features as X
from ..operators import graph as G
from ..operators import market as M

#: Features of the walk-forward model.
PCA = [f"pca_{n}_{c}" for n in ("factor", "loading", "explained_variance") for c in (1, 2)]
PEERS = ["peer_corr_abs_mean", "peer_corr_signed_top1", "peer_direction_consensus", "peer_count"]
CROSS = ["cross_section_median", "cross_section_dispersion", "cross_section_breadth", "cross_section_rank"]
REGIME = ["regime_breadth_3", "regime_dispersion_12", "regime_volatility_12"]
UPTREND = [*X.LEVEL, *X.DIRECTION, *X.CHANGE, *X.MOMENTUM, *X.ROLLING, "stale_run", "observed", "time_since_observation", *CROSS, *PCA, *PEERS, *REGIME]
#: Features whose slope may vary by series.
VARYING = ["momentum_3", "momentum_6", "direction_lag_1", "rolling_std_12", "distance_mean_12", "cross_section_rank"]

#: What the market forecast averages over all series, and over groups.
MARKET_MEANS = ["direction_1", *X.DIRECTION, "pct_change_1", *X.MOMENTUM, "robust_z_12", "distance_mean_6", "distance_mean_12", "cross_section_breadth",
                "cross_section_dispersion", "pca_factor_1", "pca_factor_2", "pca_explained_variance_1", "pca_explained_variance_2", "peer_direction_consensus",
                *REGIME, "relative_volatility_12", "diff_z_12", "momentum_acceleration_3_12"]
GROUP_MEANS = ["direction_1", "direction_lag_1", "momentum_3", "momentum_6", "momentum_12", "robust_z_12"]


def structured_features(panel: DataFrame, by=BY) -> DataFrame:
    """All features of a series' row: its own history, its place in the cross-section, components, peers and regime."""
    keys = [*by, "position", "series_id"]
    own = M.rank_change(M.cross_section_rank(X.feature_panel(panel, by), by), by=by)
    market = M.structured_regime(M.market_change(M.cross_section(panel, by), by), by)
    factors = G.rolling_pca(panel, by=by).select(*keys, *PCA)
    peers = G.peer_features(panel, by=by).select(*keys, *PEERS)
    return own.join(market, [*by, "position"], "left").join(factors, keys, "left").join(peers, keys, "left")


def origin_features(features: DataFrame, targets: DataFrame, groups: DataFrame, names: list[str], by=BY) -> tuple[DataFrame, list[str]]:
    """One row per period: moments of features over all series and over groups, history of breadth, calendar; and the feature names."""
    f = features.withColumns({
        "relative_volatility_12": div(F.col("rolling_std_12"), F.abs("rolling_mean_12")), "diff_z_12": div(F.col("diff_1"), F.col("rolling_std_12")),
        "momentum_acceleration_3_12": F.col("momentum_3") - F.col("momentum_12")})
    keys = [*by, "position"]
    market = M.market_aggregate(f, MARKET_MEANS, by)
    group = M.group_aggregate(f, groups, GROUP_MEANS, [*names, "ungrouped"], by)
    history = M.breadth_history(targets, by)
    angle = 2.0 * 3.141592653589793 * F.month("month") / 12.0
    calendar = f.groupBy(*keys).agg(F.max("month").alias("month")).select(*keys, F.sin(angle).alias("month_sin"), F.cos(angle).alias("month_cos"), (F.col("position") / 100.0).alias("time_index"))
    out = market.join(group, keys, "left").join(history, keys, "left").join(calendar, keys, "left")
    return out, [c for c in out.columns if c not in (*keys, "breadth_target")]
