"""Feature-family ablation from models to ledger rows: every family is a configuration of one fit, a value of one key from there on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import BY, truth
from ..operators import graph as E
from ..operators import metrics as I
from ..operators import priors as G
from ..operators import resample as J
from ..operators import select as H
from ..operators import targets as T
from ..operators.varying import Config

BYC = ("panel_id", "config")
BANDS = {"core": (1, 15), "middle": (16, 17), "tail": (18, 20)}


def family_models(base: list[str], families: dict[str, list[str]], **kw) -> list[Config]:
    """The base model, it with each family, with all, and with all but each (names base, add_*, full, drop_*), and each family alone (only_*)."""
    every = [c for cols in families.values() for c in cols]
    sets = {"base": base, "full": [*base, *every]}
    sets |= {f"add_{f}": [*base, *cols] for f, cols in families.items()}
    sets |= {f"drop_{f}": [*base, *[c for c in every if c not in cols]] for f, cols in families.items()}
    sets |= {f"only_{f}": list(cols) for f, cols in families.items()}
    return [Config(n, tuple(dict.fromkeys(cols)), **kw) for n, cols in sets.items()]


def rescored(scores: DataFrame, models: DataFrame, edges: DataFrame, names: list[str], *, p: str = "p", alpha: float = 0.35, w_prior: float = 0.5,
             w_group: float = 0.25) -> DataFrame:
    """The scored panel once per configuration of `names` with its model score, spread over the graph, blended with the prior and the group signal."""
    keys = [*BY, "position", "series_id"]
    kept = scores.drop("p_up_raw", "p_graph", "p_up", "p_select", "base_up_rank", "accepted", "ready")
    d = models.select(*keys, "config", F.col(p).alias("_p")).join(kept, keys)
    d = E.propagate(d.where(F.col("config").isin(names)), edges, p="_p", alpha=alpha, out="p_up_raw", by=BYC).withColumn("p_graph", F.col("p_up_raw"))
    d = G.logit_add(G.prior_blend(d, w=w_prior), p="p_up", signal="group_relative_logit", w=w_group, out="p_select")
    return d.withColumn("ready", F.col("prior").isNotNull() & F.col("p_up_raw").isNotNull()).drop("_p")


def _beside(summary: DataFrame, windows: list[str], baseline: str) -> DataFrame:
    """Per configuration: whether no window has fewer hits or a lower accuracy than the baseline."""
    base = summary.where(F.col("config") == baseline).select("panel_id", "window", F.col("hits").alias("_h"), F.col("accuracy").alias("_a"))
    j = summary.where(F.col("window").isin(windows)).join(base, ["panel_id", "window"])
    ok = truth((F.col("hits") >= F.col("_h")) & (F.col("accuracy") >= F.col("_a")))
    return j.groupBy(*BYC).agg((F.min(ok.cast("int")) == 1).alias("ok"), F.count(F.lit(1)).alias("_n")).select(*BYC, (F.col("ok") & (F.col("_n") == len(windows))).alias("ok"))


def study(scored: DataFrame, windows: dict[str, tuple[int, int]], gates: list[str], *, k: int, cap, adapt: dict, baseline: str = "base", paired: str = "validation",
          block: int = 6, reps: int = 500, seed: int = 1, bands: dict[str, tuple[int, int]] = BANDS) -> DataFrame:
    """One ledger row per panel and configuration.

    Base calls are the k best Up scores, adaptive calls those of the regime-adaptive selector. A configuration is
    accepted if, against the baseline, neither has fewer hits or a lower accuracy in any of the `gates` windows and
    the 10 % quantile of the paired monthly hit difference in the `paired` window is not below zero.
    """
    ready = scored.where("ready")
    top = H.top_k(ready, "p_up", k, by=BYC)
    calls = H.regime_adaptive(ready, cap=cap, by=BYC, **adapt)
    of = [*BYC, "window"]
    base, live = (I.summarize(T.in_windows(c, windows), of) for c in (top, calls))
    lo, hi = windows[paired]
    month = F.col("position").between(lo, hi)
    others = calls.select("panel_id", "config").distinct()
    rival = calls.where((F.col("config") == baseline) & month).drop("config").join(others, "panel_id")
    deltas = J.paired_months(calls.where(month), rival, by=BYC)
    pair = J.block_bootstrap(deltas, F.avg("hit_delta"), qs=(0.1, 0.9), block=block, reps=reps, seed=seed, by=BYC)
    own = J.block_bootstrap(I.monthly(calls.where(month), BYC), F.sum("hits") / F.sum("calls"), qs=(0.1, 0.9), block=block, reps=reps, seed=seed, by=BYC)
    total = I.summarize(calls, list(BYC))
    wide = live.groupBy(*BYC).agg(*[F.max(F.when(F.col("window") == w, F.col(c))).alias(f"{w}_{c}") for w in windows for c in ("calls", "hits", "accuracy")])
    placed = I.rank_bands(calls, bands, list(BYC)).groupBy(*BYC).agg(*[F.max(F.when(F.col("band") == b, F.col(c))).alias(f"{b}_{c}") for b in bands for c in ("calls", "hits", "accuracy")])
    caps = calls.groupBy(*BYC, "position").agg(F.count(F.lit(1)).alias("size")).groupBy(*BYC, "size").agg(F.count(F.lit(1)).alias("months"))
    caps = caps.groupBy(*BYC).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("size").cast("string"), "months"))))).alias("cap_distribution"))
    j = total.join(wide, list(BYC)).join(placed, list(BYC), "left").join(caps, list(BYC))
    j = j.join(_beside(base, gates, baseline).withColumnRenamed("ok", "base_gate"), list(BYC), "left")
    j = j.join(_beside(live, gates, baseline).withColumnRenamed("ok", "adaptive_gate"), list(BYC), "left")
    j = j.join(pair.select(*BYC, F.col("p10").alias("paired_p10"), F.col("p90").alias("paired_p90")), list(BYC), "left")
    j = j.join(own.select(*BYC, F.col("p10").alias("bootstrap_p10"), F.col("p90").alias("bootstrap_p90")), list(BYC), "left")
    j = j.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("base_gate", "adaptive_gate")}).withColumn("paired_gate", truth(F.col("paired_p10") >= 0))
    why = [F.when(~F.col(c), F.lit(c)) for c in ("base_gate", "adaptive_gate", "paired_gate")]
    return j.withColumns({"accepted": F.col("base_gate") & F.col("adaptive_gate") & F.col("paired_gate"), "rejection_reason": F.concat_ws("|", *why),
                          "experiment_id": F.concat_ws("/", "panel_id", "config")})
