"""Audits: where did a difference between two selections come from, and what was ignored?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import BY, UNB, correct, div, flag, truth
from ..functions.ordering import group_quantiles


def ledger(candidate: DataFrame, production: DataFrame, by=BY) -> DataFrame:
    """One row per replacement with what the displaced call was worth under its own direction."""
    keys = [*by, "position"]
    v = production.select(*keys, F.col("series_id").alias("victim_id"), correct().alias("victim_worth"), F.col("direction").alias("victim_direction"))
    e = candidate.where("victim_id is not null").select(*keys, "series_id", "source", "victim_id", correct().alias("new_worth"))
    return e.join(v, [*keys, "victim_id"], "left").withColumn("delta", F.col("new_worth") - F.col("victim_worth"))


def reconcile(candidate: DataFrame, production: DataFrame, by=BY) -> DataFrame:
    """Per origin: hits by set of calls (kept, redirected, added, removed) and the residual, which must be zero."""
    keys = [*by, "position", "series_id"]
    a = candidate.select(*keys, F.col("direction").alias("_da"), F.coalesce(correct(), F.lit(0.0)).alias("_ha"))
    b = production.select(*keys, F.col("direction").alias("_db"), F.coalesce(correct(), F.lit(0.0)).alias("_hb"))
    j = a.join(b, keys, "full_outer")
    kind = F.when(F.col("_db").isNull(), "added").when(F.col("_da").isNull(), "removed").when(F.col("_da") == F.col("_db"), "kept").otherwise("redirected")
    d = F.coalesce("_ha", F.lit(0.0)) - F.coalesce("_hb", F.lit(0.0))
    j = j.withColumns({"_k": kind, "_d": d})
    part = lambda k: F.sum(F.when(F.col("_k") == k, F.col("_d")).otherwise(0.0))
    g = j.groupBy(*by, "position").agg(
        *[part(k).alias(f"{k}_delta") for k in ("kept", "redirected", "added", "removed")],
        F.coalesce(F.sum("_ha"), F.lit(0.0)).alias("candidate_hits"), F.coalesce(F.sum("_hb"), F.lit(0.0)).alias("production_hits"))
    known = F.col("redirected_delta") + F.col("added_delta") + F.col("removed_delta")
    return g.withColumn("hit_delta", F.col("candidate_hits") - F.col("production_hits")).withColumn("residual", F.col("hit_delta") - known)


def pool_probe(calls: DataFrame, pool: DataFrame, by=BY) -> DataFrame:
    """Per origin: calls inside and outside the Up pool."""
    keys = [*by, "position", "series_id"]
    p = pool.select(*keys, F.lit(1).alias("_in"))
    return calls.join(p, keys, "left").groupBy(*by, "position").agg(
        F.count(F.lit(1)).alias("calls"), F.count("_in").alias("in_pool"), (F.count(F.lit(1)) - F.count("_in")).alias("outside_pool"))


def ignored(scores: DataFrame, calls: DataFrame, edges: list[float], *, score: str = "p_down", by=BY) -> DataFrame:
    """How often ready but uncalled series fell, by bucket of their Down score."""
    keys = [*by, "position", "series_id"]
    d = scores.where(truth(F.col("ready")) & F.col("y_true").isNotNull()).join(calls.select(*keys), keys, "left_anti")
    b = sum(((F.col(score) >= e).cast("int") for e in edges), F.lit(0))
    return d.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"), F.avg(score).alias("mean_score"), F.avg(1 - F.col("y_true")).alias("down_rate"))


def by_regime(df: DataFrame, market: DataFrame, col: str, n: int = 3, *, p: str = "p_up", by=BY) -> DataFrame:
    """AUC and base rate by quantile bucket of a market quantity; edges are over origins."""
    from .metrics import auc

    q = group_quantiles(market, list(by), col, {f"_q{i}": i / n for i in range(1, n)}, buckets=4)
    m = market.select(*by, "position", F.col(col).alias("_c")).join(q, list(by))
    b = sum(((F.col("_c") > F.col(f"_q{i}")).cast("int") for i in range(1, n)), F.lit(0))
    m = m.where("_c is not null").select(*by, "position", b.alias("bucket"))
    d = df.where(F.col("y_true").isNotNull() & F.col(p).isNotNull()).join(m, [*by, "position"])
    g = d.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.avg("y_true").alias("up_rate"))
    return g.join(auc(d, p, "y_true", ["bucket"]), "bucket", "left")


def training_audit(targets: DataFrame, *, lag: int = 2, min_rows: int = 48, min_class: int = 8, by=BY) -> DataFrame:
    """Rows, class balance and series with enough history for a model of their own, per origin."""
    w = Window.partitionBy(*by, "series_id").orderBy("position").rangeBetween(UNB, -lag)
    n, u = F.count("y_true").over(w), F.coalesce(F.sum("y_true").over(w), F.lit(0.0))
    s = targets.select(*by, "position", n.alias("_n"), u.alias("_u"))
    ok = (F.col("_n") >= min_rows) & (F.least(F.col("_u"), F.col("_n") - F.col("_u")) >= min_class)
    return s.groupBy(*by, "position").agg(F.sum("_n").alias("rows"), div(F.sum("_u"), F.sum("_n")).alias("up_share"),
                                          F.sum(ok.cast("int")).alias("series_ready"))


def coef_stability(coefficients: DataFrame, keys=(*BY, "term")) -> DataFrame:
    return coefficients.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fits"), F.avg("coefficient").alias("mean"), F.stddev_samp("coefficient").alias("std"),
        F.greatest(F.avg((F.col("coefficient") > 0).cast("double")), F.avg((F.col("coefficient") < 0).cast("double"))).alias("sign_agreement"))


def reach(scores: DataFrame, calls: DataFrame, a: str, b: str, by=BY) -> DataFrame:
    """Per series: gain of one score over another, and whether the series is ever called."""
    d = scores.where("y_true is not null")
    hit = lambda c: flag((F.col(c) >= 0.5) == (F.col("y_true") == 1))
    g = d.groupBy("series_id").agg((F.avg(hit(a)) - F.avg(hit(b))).alias("gain"))
    n = calls.groupBy("series_id").agg(F.count(F.lit(1)).alias("calls"))
    return g.join(n, "series_id", "left").withColumn("calls", F.coalesce("calls", F.lit(0)))


def tail_check(months: DataFrame, signal: str, y: str, q: float, keys: list[str]) -> DataFrame:
    """Hindsight: rate of ``y`` in the months whose signal lies in the window's own upper tail."""
    e = group_quantiles(months, keys, signal, {"_thr": 1 - q}, buckets=4)
    d = months.join(e, keys)
    tail = F.col(signal) >= F.col("_thr")
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("months"), F.sum(tail.cast("int")).alias("tail_months"),
                                F.avg(F.when(tail, F.col(y).cast("double"))).alias("tail_rate"), F.avg(F.col(y).cast("double")).alias("rate"))


def or_unavailable(keys: DataFrame, evidence: DataFrame, on: list[str], reason: str) -> DataFrame:
    """Evidence where it exists, otherwise a row that says why it does not."""
    j = keys.join(evidence.withColumn("available", F.lit(True)), on, "left")
    return j.withColumns({"available": F.coalesce("available", F.lit(False)), "reason": F.when(F.col("available"), F.lit(None)).otherwise(F.lit(reason))})


def score_answers(universe: DataFrame, answers: DataFrame, production: DataFrame, *, hi: int, by=BY) -> DataFrame:
    """Hits per period of externally supplied probabilities at the production call counts."""
    from .select import matched

    keys = [*by, "position", "series_id"]
    d = universe.join(answers.select(*keys, F.col("p_up").alias("p_answer")), keys, "left")
    c = matched(d.where("p_answer is not null"), production, hi=hi, p="p_answer", by=by)
    a = c.groupBy(*by, "position").agg(F.count(F.lit(1)).alias("calls"), F.sum(correct()).alias("answer_hits"))
    b = production.groupBy(*by, "position").agg(F.sum(correct()).alias("production_hits"))
    return a.join(b, [*by, "position"], "left")


def missing_answers(universe: DataFrame, answers: DataFrame, by=BY) -> DataFrame:
    keys = [*by, "position", "series_id"]
    return universe.select(*keys).join(answers.select(*keys), keys, "left_anti")
