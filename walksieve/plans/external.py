"""Evaluation of an external forecaster against the active model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import BY, truth
from ..operators import metrics as I
from ..operators import models as Z
from ..operators import resample as J
from ..operators import search as K
from ..operators import select as H
from ..operators import targets as T

WEIGHTS = (0.0, 0.25, 0.5, 0.75, 1.0)
SCORES = ("p_external", "p_calibrated", "p_active", "p_blend")


def calibrated(external: DataFrame, active: DataFrame, *, lo: int, hi: int, frozen_after: int, tuning: tuple[int, int], min_origins: int = 12, weights=WEIGHTS, by=BY) -> DataFrame:
    """Rows that both know, with the forecaster's raw and calibrated score, the active one and their blend.

    The score is calibrated on earlier origins, from `frozen_after` on with the last calibration known there; the weight of
    the active model has the least Brier score in tuning (ties to the larger weight). external: keys, p_up, failure_flag;
    active: keys, p_active, y_true.
    """
    keys = [*by, "position", "series_id"]
    j = active.select(*keys, "p_active", "y_true").join(external.where("not failure_flag").select(*keys, F.col("p_up").alias("p_external")), keys)
    j = j.where("p_active is not null and p_external is not null and not isnan(p_active)")
    c = Z.prequential(j, "p_external", "y_true", lo=lo, hi=hi, min_origins=min_origins, frozen_after=frozen_after, out="p_calibrated", by=by)
    known = c.where(F.col("position").between(*tuning))
    weight = K.best_weight(known, "p_active", "p_calibrated", "y_true", weights, list(by)).select(*by, F.col("weight").alias("active_weight"))
    c = c.join(F.broadcast(weight), list(by))  # one row per panel
    return c.withColumn("p_blend", F.col("active_weight") * F.col("p_active") + (1 - F.col("active_weight")) * F.col("p_calibrated"))


def evaluate(rows: DataFrame, calls: DataFrame, windows: dict[str, tuple[int, int]], *, hi: int, block: int = 6, reps: int = 500, seed: int = 1, gate: str = "validation",
             by=BY) -> dict[str, DataFrame]:
    """Tables of the evaluation from `calibrated` rows and the active selection's calls.

    metrics: probability metrics per window and score; diversity: raw against active score per window; matched: hits of as many
    calls per month as the active selection, with the paired monthly difference and its bootstrap; gate: in the gate window a
    positive difference whose 10 % quantile is not below zero, and a blend with a Brier score below the active one's.
    """
    by = list(by)
    known = T.in_windows(rows.where("y_true is not null"), windows)
    long = known.withColumn("x", F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).alias("p")) for s in SCORES]))).select(*by, "window", "y_true", "x.*")
    metrics = I.metrics(long, "p", "y_true", [*by, "window", "score"])
    diversity = I.diversity(known, "p_external", "p_active", "y_true", [*by, "window"])
    live = I.with_correct(calls).where("correct is not null")
    mine = H.matched(rows.withColumn("ready", F.lit(True)), live, hi=hi, p="p_blend", by=by)
    pairs = T.in_windows(J.paired_months(mine, live, common=True, by=by), windows)
    of = [*by, "window"]
    boot = J.block_bootstrap(pairs, F.sum("hit_delta"), block=block, reps=reps, seed=seed, scheme="moving", by=of)
    matched = pairs.groupBy(*of).agg(F.count(F.lit(1)).alias("months"), F.sum("c_calls").alias("calls"), F.sum("c_hits").cast("bigint").alias("hits"), F.sum("b_hits").cast("bigint").alias("active_hits"),
                                     F.sum("hit_delta").alias("hit_delta"), F.avg("hit_delta").alias("mean_monthly_delta")).join(boot.select(*of, "p10", "p50", "p90"), of)
    brier = metrics.where(F.col("window") == gate).groupBy(*by).agg(*[F.max(F.when(F.col("score") == s, F.col("brier"))).alias(f"brier_{s}") for s in ("p_blend", "p_active")])
    g = matched.where(F.col("window") == gate).select(*by, "hit_delta", "p10").join(brier, by)
    g = g.withColumns({"gains_hits": truth(F.col("hit_delta") > 0), "stable": truth(F.col("p10") >= 0), "better_brier": truth(F.col("brier_p_blend") < F.col("brier_p_active"))})
    return {"metrics": metrics, "diversity": diversity, "matched": matched, "gate": g.withColumn("passed", F.col("gains_hits") & F.col("stable") & F.col("better_brier"))}
