"""Evidence tables: what external answers are worth, what single components of a score are worth, and how high the signal reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import BY, div, truth
from ..operators import audit as A
from ..operators import metrics as I
from ..operators import resample as J
from ..operators import select as H
from ..operators import targets as T


def _hits(calls: DataFrame, by) -> DataFrame:
    return I.with_correct(calls).where("correct is not null").groupBy(*by, "position").agg(F.sum("correct").alias("hits"), F.count(F.lit(1)).alias("calls"))


def score(universe: DataFrame, answers: DataFrame, production: DataFrame, market: DataFrame, *, hi: int, block: int = 6, reps: int = 500, seed: int = 1, by=BY) -> DataFrame:
    """One row per panel and use of the answers, each at production's number of calls per month.

    up_only: the highest answers, all Up; direction_free: the surest answers in their own direction; flip: production with all
    directions turned in months whose market answer (p_broad_down) is 0.5 or more. Each with hits, difference to production,
    its moving-block bootstrap, and beside them the AUC that belongs to the use: of the answer for direction (up_only), of the
    answer for the direction that production chose for its being right (direction_free), of the market answer (flip).
    universe: labelled rows with `ready`; answers: keys, p_up; market: panel, position, p_broad_down. Rows without an answer
    take no part; `missing_answers` of the operators lists them.
    """
    by = list(by)
    keys = [*by, "position", "series_id"]
    live = I.with_correct(production).where("correct is not null")
    rows = universe.where("y_true is not null").join(answers.select(*keys, F.col("p_up").alias("p_answer")).where("p_answer is not null"), keys).withColumn("ready", F.lit(True))
    size = live.groupBy(*by, "position").agg(F.count(F.lit(1)).alias("_k"))
    base = _hits(live, by).select(*by, "position", F.col("hits").alias("production_hits"))
    up = H.top_k(rows.join(size, [*by, "position"]), "p_answer", "_k", hi=hi, by=by)
    free = H.matched(rows, live, hi=hi, p="p_answer", by=by)
    turned = live.join(market.select(*by, "position", "p_broad_down"), [*by, "position"]).withColumn(
        "direction", F.when(F.col("p_broad_down") >= 0.5, F.when(F.col("direction") == "Up", "Down").otherwise("Up")).otherwise(F.col("direction")))
    uses = None
    for name, calls in (("up_only", up), ("direction_free", free), ("flip", turned)):
        part = _hits(calls, by).withColumn("use", F.lit(name))
        uses = part if uses is None else uses.unionByName(part)
    names = base.withColumn("use", F.explode(F.array(F.lit("up_only"), F.lit("direction_free"), F.lit("flip"))))
    m = names.join(uses, [*by, "position", "use"], "left").fillna(0, ["hits", "calls"]).withColumn("delta", F.col("hits") - F.col("production_hits"))
    of = [*by, "use"]
    boot = J.block_bootstrap(m, F.sum("delta"), qs=(0.05, 0.5, 0.95), block=block, reps=reps, seed=seed, scheme="moving", by=of)
    s = m.groupBy(*of).agg(F.sum("calls").alias("calls"), F.sum("hits").cast("bigint").alias("hits"), F.sum("production_hits").cast("bigint").alias("production_hits"), F.sum("delta").alias("hit_delta"))
    chosen = live.join(rows.select(*keys, "p_answer"), keys).withColumn("p_chosen", F.when(F.col("direction") == "Up", F.col("p_answer")).otherwise(1 - F.col("p_answer")))
    broad = T.broad_down(universe, by).select(*by, "position", F.col("broad_down").cast("double").alias("fell")).join(market.select(*by, "position", "p_broad_down"), [*by, "position"])
    broad = broad.join(size.select(*by, "position"), [*by, "position"])
    a = None
    for name, df, p, y in (("up_only", rows, "p_answer", "y_true"), ("direction_free", chosen, "p_chosen", "correct"), ("flip", broad, "p_broad_down", "fell")):
        part = I.auc(df, p, y, by).withColumn("use", F.lit(name))
        a = part if a is None else a.unionByName(part)
    return s.withColumn("accuracy", div(F.col("hits"), F.col("calls"))).join(boot.select(*of, "p05", "p50", "p95"), of).join(a, of, "left")


def interpret(scored: DataFrame, *, timing_auc: float = 0.60, reliability_auc: float = 0.55, by=BY) -> DataFrame:
    """One verdict per panel from the rows of `score`: worth a forward test if the Up-only use gains hits beyond its 5 % quantile, or the
    market answer tells broad falls and turning gains hits, or the answers tell production's right calls from its wrong ones."""
    by = list(by)
    pick = lambda use, c: F.max(F.when(F.col("use") == use, F.col(c)))
    w = scored.groupBy(*by).agg(*[pick(u, c).alias(f"{u}_{c}") for u in ("up_only", "direction_free", "flip") for c in ("hit_delta", "p05", "auc")])
    c = F.col
    signals = {"gains_hits": truth((c("up_only_hit_delta") > 0) & (c("up_only_p05") > 0)), "times_market": truth((c("flip_auc") >= timing_auc) & (c("flip_hit_delta") > 0)),
               "tells_right_calls": truth(c("direction_free_auc") >= reliability_auc)}
    w = w.select(*by, *[e.alias(n) for n, e in signals.items()])
    return w.withColumn("verdict", F.when(c("gains_hits") | c("times_market") | c("tells_right_calls"), "worth a forward test on new months").otherwise("no evidence of added signal"))


def components(rows: DataFrame, cols: list[str], y: str, *, edges=None, by=BY) -> tuple[DataFrame, DataFrame]:
    """(summary, reliability) of every component of a score, read as a probability of `y`: metrics, mean and 95 % quantile, and observed rates per bucket."""
    by = list(by)
    items = F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).cast("double").alias("p")) for c in cols])
    long = rows.where(F.col(y).isNotNull()).select(*by, F.col(y).cast("double").alias("outcome"), F.explode(items).alias("x")).select(*by, "outcome", "x.*").where("p is not null")
    of = [*by, "component"]
    from ..functions.ordering import group_quantiles

    s = I.metrics(long, "p", "outcome", of).select(*of, "n", "auc", "brier", "ece", F.col("mean_probability").alias("mean"), "base_rate").join(group_quantiles(long, of, "p", {"p95": 0.95}), of)
    r = I.reliability(long, "p", "outcome", of, edges or [0.0, 0.5, 0.6, 0.65, 0.7, 0.8, 1.0])
    return s, r.withColumn("gap", F.col("mean_probability") - F.col("observed"))


def ceiling(calls: DataFrame, windows: dict[str, tuple[int, int]], bands: dict[str, tuple[int, int]], *, thresholds=(0.62, 0.65), target: float = 0.65, share: float = 0.9, block: int = 6,
            reps: int = 500, seed: int = 1, by=BY) -> dict[str, DataFrame]:
    """Tables on how high the selection's accuracy reaches.

    baselines: the calls, the same calls all Up, and rank bands; ranks: accuracy per rank; drift: monthly accuracy and its trailing
    means; windows; bootstrap of the mean monthly accuracy with the share of replicates at each threshold; summary: stable only if at
    least `share` of them reach `target`, else inconclusive; and what cannot be told, with the reason.
    """
    by = list(by)
    live = I.with_correct(calls).where("correct is not null")
    banded = [F.when(F.col("rank").between(lo, hi), F.lit(n)) for n, (lo, hi) in bands.items()]
    tagged = live.select(*by, "position", "correct", "y_true", F.explode(F.array_compact(F.array(F.lit("all_calls"), *banded))).alias("slice"))
    up = live.select(*by, "position", F.col("y_true").alias("correct"), "y_true", F.lit("same_calls_all_up").alias("slice"))
    of = [*by, "slice"]
    baselines = tagged.unionByName(up.select(*tagged.columns)).groupBy(*of).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("correct").cast("bigint").alias("hits"), F.avg("correct").alias("accuracy"), F.count_distinct("position").alias("months"))
    baselines = baselines.withColumn("calls_per_month", F.col("calls") / F.col("months"))
    ranks = live.groupBy(*by, "rank").agg(F.count(F.lit(1)).alias("calls"), F.sum("correct").cast("bigint").alias("hits"), F.avg("correct").alias("accuracy"))
    spans = I.summarize(T.in_windows(calls, windows), [*by, "window"])
    boot = J.block_bootstrap(I.monthly(calls, by), F.avg("accuracy"), qs=(0.1, 0.5, 0.9, 0.95), thresholds=thresholds, block=block, reps=reps, seed=seed, scheme="moving", by=by)
    reach = F.col(f"share_ge_{int(round(target * 100))}")
    summary = baselines.where("slice = 'all_calls'").select(*by, "months", "calls", "hits", "accuracy").join(boot.select(*by, "p10", "p90", reach.alias("share_at_target")), by)
    summary = summary.withColumn("classification", F.when(F.col("share_at_target") >= share, "stable").otherwise("inconclusive"))
    wanted = calls.select(*by).distinct().withColumn("statistic", F.explode(F.array(*[F.lit(x) for x in ("learning_curve", "error_overlap", "causal_meta_selector", "null_permutation")])))
    none = wanted.limit(0).withColumn("value", F.lit(None).cast("double"))
    missing = A.or_unavailable(wanted, none, [*by, "statistic"], "needs predictions that were fixed before the audit")
    return {"baselines": baselines, "ranks": ranks, "drift": I.drift(calls, by=by), "windows": spans, "bootstrap": boot, "summary": summary, "missing": missing}
