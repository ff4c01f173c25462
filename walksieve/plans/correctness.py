"""Audit of the probability that a call is right: eight causal methods side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import BY, UNB, truth
from ..operators import metrics as I
from ..operators import models as Z
from ..operators import targets as T
from ..operators.cube import bootstrap_metrics, isotonic_prequential

METHODS = ("score", "score_in_window", "global_cohort", "rank_cohort", "regime_cohort", "rank_regime_cohort", "platt_score_rank", "isotonic_score")
#: Methods that tell calls apart, causally.
INDIVIDUAL = METHODS[3:]
THRESHOLDS = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75)
RANK_GROUPS = ((3, "1_3"), (5, "4_5"), (10, "6_10"), (15, "11_15"), (None, "16_plus"))


def rank_group(rank: str = "rank"):
    out = F.lit(RANK_GROUPS[-1][1])
    for hi, name in reversed(RANK_GROUPS[:-1]):
        out = F.when(F.col(rank) <= hi, name).otherwise(out)
    return out


def candidates(calls: DataFrame, *, score: str = "confidence", lo: int, hi: int, min_months: int = 12, k: float = 50.0, by=BY) -> DataFrame:
    """Labelled calls with `correct` and the probability of every method, each from calls at least two periods old.

    Cohorts are (hits + k rate) / (calls + k) of earlier calls with the same rank group or regime; the logistic model and
    the monotone one are refitted at every origin lo..hi. A method without enough months gives null.
    """
    by = list(by)
    keys = [*by, "position", "series_id"]
    c = I.with_correct(calls).where("correct is not null").withColumns({"rank_group": rank_group(), "score": F.col(score), "_rank": (F.col("rank") - 1) / 14.0})
    d = c
    for name, group in (("global_cohort", []), ("rank_cohort", ["rank_group"]), ("regime_cohort", ["regime_label"]), ("rank_regime_cohort", ["rank_group", "regime_label"])):
        g = Z.cohort_probability(c, group, k=k, min_months=min_months, out=name, by=by).select(*keys, name)
        d = d.join(g, keys, "left")
    usable = c.where("score is not null and _rank is not null")
    fit = Z.fit_pooled(usable, ["score", "_rank"], y="correct", lo=lo, hi=hi, c=0.1, standardize=False, missing_flags=False, by=by)
    platt = Z.score_pooled(usable.where(F.col("position").between(lo, hi)), fit, out="_platt").select(*keys, "_platt")
    iso = isotonic_prequential(usable, "score", "correct", lo=lo, hi=hi, min_months=min_months, out="isotonic_score", by=by).select(*keys, "isotonic_score")
    d = d.join(platt, keys, "left").join(iso, keys, "left")
    # months with calls that an origin knows
    months = c.groupBy(*by, "position").agg(F.count(F.lit(1)).alias("_c"))
    months = months.select(*by, "position", F.count(F.lit(1)).over(Window.partitionBy(*by).orderBy("position").rangeBetween(UNB, -2)).alias("_known"))
    d = d.join(months, [*by, "position"])
    known = F.col("_known") >= min_months
    return d.withColumns({"score_in_window": F.when(F.col("global_cohort").isNotNull(), F.col("score")), "platt_score_rank": F.when(known, F.col("_platt"))}).drop("_platt", "_rank", "_known")


def by_method(found: DataFrame, methods=METHODS, by=BY) -> DataFrame:
    """One row per call and method with a probability."""
    keep = [c for c in found.columns if c not in METHODS or c == "score"]
    long = found.select(*[c for c in keep if c != "score"], F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).cast("double").alias("probability")) for m in methods])).alias("_x"))
    return long.select("*", "_x.method", "_x.probability").drop("_x").where("probability is not null")


def audit(found: DataFrame, windows: dict[str, tuple[int, int]], *, models: list[str], reps: int = 500, block: int = 6, seed: int = 1, min_auc: float = 0.55,
          min_gain: float = 0.002) -> dict[str, DataFrame]:
    """The audit's tables from `candidates` (of several models, told apart by the columns `models`).

    comparison: metrics per method; reliability: buckets with Wilson bounds; slices: the score's metrics per regime, rank
    group, series, direction and window; coverage: calls kept and accuracy per threshold and window; bootstrap: intervals
    over blocks of months; decision: whether any individual method has an AUC of min_auc, a Brier score better than the cohort's by
    min_gain, and in every window an accuracy that does not fall as the threshold rises.
    """
    m = [*models, "method"]
    long = by_method(found)
    comparison = I.metrics(long, "probability", "correct", m)
    reliability = I.reliability(long, "probability", "correct", m)
    tags = [F.concat(F.lit(f"{c}:"), F.col(c).cast("string")) for c in ("regime_label", "rank_group", "series_id", "direction") if c in found.columns]
    tags += [F.when(F.col("position").between(lo, hi), F.lit(f"window:{w}")) for w, (lo, hi) in windows.items()]
    sliced = found.where("score is not null").withColumn("slice", F.explode(F.array_compact(F.array(*tags))))
    slices = I.metrics(sliced, "score", "correct", [*models, "slice"])
    spans = T.in_windows(long, windows).unionByName(long.withColumn("window", F.lit("all")))
    of = [*m, "window"]
    kept = [e for t in THRESHOLDS for e in (F.sum((F.col("probability") >= t).cast("long")).alias(f"n{t}"), F.sum(F.when(F.col("probability") >= t, F.col("correct"))).alias(f"h{t}"))]
    wide = spans.groupBy(*of).agg(F.count(F.lit(1)).alias("_n"), *kept)
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"`n{t}`").alias("calls"), F.col(f"`h{t}`").alias("_h")) for t in THRESHOLDS])
    coverage = wide.select(*of, "_n", F.explode(rows).alias("x")).select(
        *of, "x.threshold", "x.calls", (F.col("x.calls") / F.col("_n")).alias("coverage"), (F.col("x._h") / F.nullif(F.col("x.calls"), F.lit(0))).alias("accuracy"))
    bootstrap = bootstrap_metrics(long, "probability", "correct", block=block, reps=reps, seed=seed, by=m)
    return {"comparison": comparison, "reliability": reliability, "slices": slices, "coverage": coverage, "bootstrap": bootstrap,
            "decision": decide(comparison, coverage, models=models, min_auc=min_auc, min_gain=min_gain)}


def decide(comparison: DataFrame, coverage: DataFrame, *, models: list[str], min_auc: float, min_gain: float) -> DataFrame:
    """Per individual method: its gates, and whether it may be released as a probability of single calls."""
    flat = comparison.where("method = 'global_cohort'").select(*models, F.col("brier").alias("_base"))
    w = Window.partitionBy(*models, "method", "window").orderBy("threshold")
    steps = coverage.where("window <> 'all' and accuracy is not null").withColumn("_before", F.lag("accuracy").over(w))
    stable = steps.groupBy(*models, "method").agg(F.min(F.coalesce(truth(F.col("accuracy") >= F.col("_before")) | F.col("_before").isNull(), F.lit(True)).cast("int")).alias("_ok"))
    j = comparison.where(F.col("method").isin(*INDIVIDUAL)).join(flat, models, "left").join(stable, [*models, "method"], "left")
    gates = {"auc_gate": truth(F.col("auc") >= min_auc), "brier_gate": truth(F.col("_base") - F.col("brier") >= min_gain), "coverage_gate": truth(F.col("_ok") == 1)}
    j = j.withColumns(gates).withColumn("released", reduce(lambda a, b: a & b, [F.col(g) for g in gates]))
    return j.select(*models, "method", "auc", "brier", (F.col("_base") - F.col("brier")).alias("brier_gain"), *gates, "released")
