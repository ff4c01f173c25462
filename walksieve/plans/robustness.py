"""Robustness of the regime-adaptive policy: Down rules x replacement budgets x windows x regimes.

A budget only decides how many of the weakest pool rows give way to how many of the best outside Down calls. So each
period keeps running sums along both ranks, up to the largest budget, and any budget's result is a difference of two
of them: rows are ranked once per Down rule, budgets cost periods and not rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import BY, div, truth
from ..operators import select as H
from ..operators import targets as T

#: What is added up along the ranks.
MEASURES = ("calls", "hits", "down_calls", "down_hits", "sudden_down_calls", "sudden_down_hits", "candidates")


def _measured(calls: DataFrame, outcomes: DataFrame, marked: DataFrame, keys: list[str], by) -> DataFrame:
    """Each call with its measures as numbers."""
    ids = [*by, "position", "series_id"]
    j = calls.select(*keys, "series_id", "y_true", "direction").join(outcomes.select(*ids, truth(F.col("label_valid") & F.col("sudden_drop")).alias("_shock")), ids, "left")
    j = j.join(marked.select(*keys, "series_id", "_sel", "p_down_adj", "_cand"), [*keys, "series_id"])
    y, sel = F.col("y_true"), F.col("y_true").isNotNull()
    down = sel & (F.col("direction") == "Down")
    hit = sel & (F.when(F.col("direction") == "Down", y == 0).otherwise(y == 1))
    shock = F.coalesce("_shock", F.lit(False))
    flags = (sel, hit, down, down & (y == 0), down & shock, down & shock & (y == 0), F.col("_cand"))
    return j.withColumns({m: truth(f).cast("int") for m, f in zip(MEASURES, flags)})


def _running(df: DataFrame, keys: list[str], order, upto: int, name: str) -> DataFrame:
    """Per period an array of running sums of the measures along an order: entry r holds the first r rows, r = 0 .. at most `upto`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= upto)
    d = d.select(*keys, "_r", F.struct(*[F.sum(m).over(run).alias(m) for m in MEASURES]).alias("_x"))
    zero = F.struct(*[F.lit(0).cast("bigint").alias(m) for m in MEASURES])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_r", "_x"))), lambda e: e["_x"])
    return d.groupBy(*keys).agg(F.concat(F.array(zero), ordered).alias(name))  # at most upto entries


def study(scores: DataFrame, outcomes: DataFrame, policies: dict[str, tuple[float, float]], windows: dict[str, tuple[int, int]], *, max_budget: int, cap, hi: int,
          by=BY, **fixed) -> DataFrame:
    """One row per policy (Down threshold, margin), replacement budget 0..max_budget, window and regime ("all" and each label).

    Counts of months, calls and hits, of Down calls and of sudden drops, shares of them, replacements, and Down candidates
    that were left alone. Equals the policy run once per budget.
    """
    by = list(by)
    items = F.array(*[F.struct(F.lit(n).alias("policy"), F.lit(float(t)).alias("down_threshold"), F.lit(float(m)).alias("down_margin")) for n, (t, m) in policies.items()])
    rows = scores.withColumn("_p", F.explode(items)).select("*", "_p.policy", "_p.down_threshold", "_p.down_margin").drop("_p")
    byp = [*by, "policy"]
    keys = [*byp, "position"]
    args = {**fixed, "down_threshold": F.col("down_threshold"), "down_margin": F.col("down_margin")}
    marked = H.down_candidates(rows, **{k: v for k, v in args.items() if k in ("down_threshold", "down_margin", "stress_trigger", "regime_bonus", "shock_bonus", "hard_threshold")})
    pool = H.regime_adaptive(rows, cap=cap, hi=hi, by=byp, **{**args, "max_replacements": 0})
    full = H.regime_adaptive(rows, cap=cap, hi=hi, by=byp, **{**args, "max_replacements": max_budget})
    sid = F.col("series_id").asc()
    weak = _measured(pool, outcomes, marked, keys, by)
    new = _measured(full.where("replacement"), outcomes, marked, keys, by)
    size = weak.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("_size"), F.struct(*[F.sum(m).alias(m) for m in MEASURES]).alias("_all"))
    per = size.join(_running(weak, keys, [F.col("_sel").asc(), sid], max_budget, "_weak"), keys).join(
        _running(new, keys, [F.col("p_down_adj").desc(), sid], max_budget, "_new"), keys, "left")
    found = marked.groupBy(*keys).agg(F.sum(F.col("_cand").cast("int")).alias("_cands"))
    shock = scores.join(outcomes.select(*by, "position", "series_id", truth(F.col("label_valid") & F.col("sudden_drop")).alias("_shock")), [*by, "position", "series_id"], "left")
    whole = shock.groupBy(*by, "position", "regime_label").agg(F.sum(truth(F.col("y_true") == 0).cast("int")).alias("_downs"), F.sum(F.coalesce("_shock", F.lit(False)).cast("int")).alias("_drops"))
    budgets = per.withColumn("budget", F.explode(F.sequence(F.lit(0), F.lit(max_budget))))
    r = F.least(F.col("budget"), F.coalesce(F.size("_new") - 1, F.lit(0)), F.col("_size"))
    budgets = budgets.withColumn("_k", r).withColumns({"_out": F.get("_weak", F.col("_k")), "_in": F.get("_new", F.col("_k"))})
    value = {m: F.col(f"_all.{m}") - F.col(f"_out.{m}") + F.coalesce(F.col(f"_in.{m}"), F.lit(0)) for m in MEASURES}
    monthly = budgets.select(*keys, "budget", "_k", *[v.alias(m) for m, v in value.items()]).join(found, keys, "left")
    # periods without a call count with their events too
    grid = whole.withColumn("policy", F.explode(F.array(*[F.lit(n) for n in policies]))).withColumn("budget", F.explode(F.sequence(F.lit(0), F.lit(max_budget))))
    j = grid.join(monthly, [*keys, "budget"], "left").fillna(0, [*MEASURES, "_k", "_cands"])
    g = T.in_windows(j, windows).rollup(*byp, "budget", "window", "regime_label").agg(
        F.grouping("window").alias("_gw"), F.grouping("regime_label").alias("_g"), F.sum((F.col("calls") > 0).cast("int")).alias("months"),
        *[F.sum(m).alias(m) for m in MEASURES], F.sum("_downs").alias("_downs"), F.sum("_drops").alias("sudden_drops"), F.sum("_k").alias("replacements"), F.sum("_cands").alias("_cands"))
    g = g.where("_gw = 0")
    return g.select(*byp, "budget", "window", F.when(F.col("_g") == 1, "all").otherwise(F.col("regime_label")).alias("regime"), "months", "calls", "hits", div(F.col("hits"), F.col("calls")).alias("accuracy"),
                    "down_calls", "down_hits", div(F.col("down_hits"), F.col("down_calls")).alias("down_precision"), div(F.col("down_hits"), F.col("_downs")).alias("down_recall"),
                    "sudden_drops", "sudden_down_calls", div(F.col("sudden_down_hits"), F.col("sudden_down_calls")).alias("sudden_down_precision"),
                    div(F.col("sudden_down_calls"), F.col("sudden_drops")).alias("sudden_drop_recall"), "replacements", (F.col("_cands") - F.col("candidates")).alias("abstained"))
