"""Next-period direction labels, causal splits and evaluation windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    BY, array_mad, const_frame, div, flag, roll_quantile, series_window, truth,
)


def direction_targets(panel: DataFrame, by=BY) -> DataFrame:
    """Direction of the move from ``position`` to the next one; a tie counts as Down."""
    w = series_window(by=by)
    nxt = F.lead("value").over(w)
    t = panel.withColumns({"value_t1": nxt, "target_month": F.lead("month").over(w)})
    change = F.col("value_t1") - F.col("value")
    return t.withColumns({
        "change": change,
        "y_true": flag(change > 0),
        "zero_change": change == 0,
        "target_available": change.isNotNull(),
    })


def horizon_targets(panel: DataFrame, h: int, by=BY) -> DataFrame:
    """Direction of the move ending ``h`` periods ahead, seen from ``position``."""
    w = series_window(by=by)
    t = panel.withColumns({
        "value_from": F.lead("value", h - 1).over(w) if h > 1 else F.col("value"),
        "value_to": F.lead("value", h).over(w),
        "target_month": F.lead("month", h).over(w),
    })
    change = F.col("value_to") - F.col("value_from")
    return t.withColumns({
        "horizon": F.lit(h), "change": change, "y_true": flag(change > 0),
        "zero_change": change == 0, "target_available": change.isNotNull(),
    })


def target_at(targets: DataFrame, position: int, series_id: str) -> DataFrame:
    """The label of one series at one origin; the filter reaches the scan."""
    return targets.where((F.col("position") == position) & (F.col("series_id") == series_id)).select(
        *BY, "position", "series_id", "y_true"
    )


def audit_alignment(panel: DataFrame, targets: DataFrame, by=BY) -> DataFrame:
    """Rows whose label disagrees with the two panel cells it is made from."""
    keys = [*by, "series_id", "position"]
    now = panel.select(*keys, F.col("value").alias("v0"))
    then = panel.select(*by, "series_id", (F.col("position") - 1).alias("position"), F.col("value").alias("v1"))
    j = targets.select(*keys, "y_true").join(now, keys, "left").join(then, keys, "left")
    want = flag(F.col("v1") > F.col("v0"))
    return j.where(~want.eqNullSafe(F.col("y_true")))


def layout(panel: DataFrame, *, audit: int = 48, warmup: int = 12, estimation: int = 119, by=BY) -> DataFrame:
    """Named position ranges of a panel with n periods."""
    n = panel.groupBy(*by).agg(F.max("position").alias("n"))
    lo_audit = F.col("n") - audit
    rows = F.array(
        F.struct(F.lit("warmup").alias("name"), F.lit(1).alias("lo"), F.lit(warmup).alias("hi")),
        F.struct(F.lit("estimation").alias("name"), F.lit(warmup + 1).alias("lo"), F.lit(estimation).alias("hi")),
        F.struct(F.lit("development").alias("name"), F.lit(estimation + 1).alias("lo"), (lo_audit - 1).alias("hi")),
        F.struct(F.lit("audit").alias("name"), lo_audit.alias("lo"), (F.col("n") - 1).alias("hi")),
        F.struct(F.lit("production").alias("name"), F.col("n").alias("lo"), F.col("n").alias("hi")),
    )
    return n.select(*by, F.explode(rows).alias("r")).select(*by, "r.name", "r.lo", "r.hi")


def origins_frame(spark, lo: int, hi: int, panel_id: str = "main") -> DataFrame:
    return spark.range(lo, hi + 1).select(
        F.lit(panel_id).alias("panel_id"), F.col("id").cast("int").alias("origin")
    )


def causal_train(rows: DataFrame, origins: DataFrame, *, lag: int = 1, by=BY) -> DataFrame:
    """All label rows usable at each origin: label position <= origin - lag - 1.

    The result repeats rows per origin, so use it for small follow-ups; sums over
    the same sets come cheaper from ``causal_totals``.
    """
    r, o = rows.alias("r"), origins.alias("o")
    cond = [F.col(f"r.{k}") == F.col(f"o.{k}") for k in by]
    cond.append(F.col("r.position") <= F.col("o.origin") - lag - 1)
    return r.join(F.broadcast(o), cond).select("o.origin", "r.*")


def causal_totals(rows: DataFrame, sums: dict, keys=(), *, lag: int = 1, by=BY) -> DataFrame:
    """Running sums usable at each position: collapse to one row per period, then prefix-sum."""
    from ..functions.columns import UNB
    from pyspark.sql import Window

    per = rows.groupBy(*by, *keys, "position").agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    w = Window.partitionBy(*by, *keys).orderBy("position").rangeBetween(UNB, -(lag + 1))
    return per.select(*by, *keys, "position", *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in sums])


def eligible(targets: DataFrame, *, min_position: int = 24, exclude: DataFrame | None = None, by=BY) -> DataFrame:
    """Flags ``eligible`` and ``data_quality_ok``; ``exclude`` lists series ids to leave out."""
    w = series_window(by=by)
    prev = F.lag("value").over(w)
    t = targets.withColumn("_seen", prev.isNotNull())
    ok = F.col("target_available") & F.col("_seen") & (F.col("position") > min_position)
    if exclude is None:
        return t.withColumns({"eligible": truth(ok), "data_quality_ok": F.lit(True)}).drop("_seen")
    ban = exclude.select("series_id").distinct().withColumn("_ban", F.lit(True))
    return (
        t.join(ban, "series_id", "left")
        .withColumn("data_quality_ok", F.col("_ban").isNull())
        .withColumn("eligible", truth(ok) & F.col("data_quality_ok"))
        .drop("_ban", "_seen")
    )


def windows_frame(spark, windows: dict[str, tuple[int, int]]) -> DataFrame:
    return const_frame(spark, [(k, lo, hi) for k, (lo, hi) in windows.items()], "window string, lo int, hi int")


def in_windows(df: DataFrame, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """Rows per evaluation window; windows may overlap.

    The handful of windows is a constant, so a row finds its windows with an
    expression and no join is needed.
    """
    hits = F.array_compact(F.array(*[
        F.when(F.col("position").between(lo, hi), F.lit(k)) for k, (lo, hi) in windows.items()
    ]))
    lo, hi = min(a for a, _ in windows.values()), max(b for _, b in windows.values())
    return df.where(F.col("position").between(lo, hi)).withColumn("window", F.explode(hits))


def sudden_drops(targets: DataFrame, *, window: int = 60, min_n: int = 24, q: float = 0.05,
                 z: float = 2.0, by=BY) -> DataFrame:
    """Unusually bad next-period returns against the series' own earlier returns.

    A drop is negative, at or below the trailing q-quantile and at or below
    median - z * 1.4826 * MAD; it also reports the quantile-only label.
    """
    w = series_window(-window, -1, by)
    t = targets.withColumn("target_return", div(F.col("value_t1"), F.col("value")) - 1.0)
    t = t.withColumns({
        "_past": F.collect_list("target_return").over(w),
        "lower_tail": roll_quantile("target_return", q, window, min_n, by=by, lag_rows=1),
        "_med": roll_quantile("target_return", 0.5, window, min_n, by=by, lag_rows=1),
    })
    t = t.withColumn("_scale", F.when(F.size("_past") >= min_n, 1.4826 * array_mad(F.col("_past"))))
    r = F.col("target_return")
    t = t.withColumn("robust_threshold", F.col("_med") - z * F.col("_scale"))
    valid = truth(r.isNotNull() & F.col("lower_tail").isNotNull()
                  & F.col("robust_threshold").isNotNull() & (F.col("_scale") > 0))
    tail = (r < 0) & (r <= F.col("lower_tail"))
    return t.withColumns({
        "label_valid": valid,
        "sudden_drop": truth(valid & tail & (r <= F.col("robust_threshold"))),
        "extreme_down": F.when(r.isNotNull() & F.col("lower_tail").isNotNull(), flag(tail)),
    }).drop("_past", "_med", "_scale")


def known_outcome(labels: DataFrame, *, lag: int = 1, groups: DataFrame | None = None, by=BY) -> DataFrame:
    """Newest drop label observable at a position, with its market and group share.

    The label of position s is known at s + lag + 1.
    """
    d = labels.select(
        *by, "series_id", (F.col("position") + lag + 1).alias("position"),
        F.when(F.col("label_valid"), flag(F.col("sudden_drop"))).alias("previous_shock"),
    )
    market = d.groupBy(*by, "position").agg(F.avg("previous_shock").alias("previous_shock_share"))
    out = d.join(market, [*by, "position"], "left")
    if groups is not None:
        g = d.join(groups, "series_id", "left")
        share = g.groupBy(*by, "position", "group_id").agg(F.avg("previous_shock").alias("previous_group_shock_share"))
        out = out.join(groups, "series_id", "left").join(share, [*by, "position", "group_id"], "left")
    return out


def forecast_month(df: DataFrame, h: int, month: str = "month") -> DataFrame:
    """Month in which the move of horizon ``h`` lands."""
    return df.withColumn("forecast_month", F.add_months(month, h))


def target_calendar(df: DataFrame) -> DataFrame:
    """Calendar month and year of the move that starts at this row."""
    nxt = F.add_months("month", 1)
    return df.withColumns({"change_month": F.month(nxt), "change_year": F.year(nxt)})


def broad_down(targets: DataFrame, by=BY) -> DataFrame:
    """Per period: did fewer than half of the known moves rise?"""
    return targets.groupBy(*by, "position").agg(F.avg("y_true").alias("breadth")).withColumn(
        "broad_down", flag(F.col("breadth") < 0.5)
    )


def month_outcomes(universe: DataFrame, by=BY) -> DataFrame:
    """Per period: calls, hits as called, hits if every Up call were reversed, and the targets.

    Needs accepted, direction and y_true on the ready universe.
    """
    acc = F.col("accepted")
    down = acc & (F.col("direction") == "Down")
    y = F.col("y_true")
    hit = truth(acc & (((y == 1) & ~down) | ((y == 0) & down)))
    agg = universe.groupBy(*by, "position").agg(
        F.sum(acc.cast("int")).alias("calls"),
        F.sum(hit.cast("int")).alias("hits"),
        F.sum(truth(acc & (y == 0)).cast("int")).alias("flipped_hits"),
        F.avg(F.when(acc, y)).alias("_rate"),
        F.avg("y_true").alias("_all"),
    )
    return agg.withColumns({
        "flip_target": truth(F.col("_rate") < 0.5).cast("int"),
        "universe_broad_down": truth(F.col("_all") < 0.5).cast("int"),
    }).drop("_rate", "_all")


def band_target(scores: DataFrame, lo: int, hi: int, rank: str = "base_up_rank", by=BY) -> DataFrame:
    """Mean label of the ranks lo..hi per period."""
    return scores.groupBy(*by, "position").agg(
        F.avg(F.when(F.col(rank).between(lo, hi), F.col("y_true"))).alias(f"quality_{lo}_{hi}")
    )
