"""Seasonal priors: do they exist, and would they have changed the selection's hits?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import BY, div, truth
from ..operators import priors as G
from ..operators import resample as J
from ..operators import select as H
from ..operators import targets as T


def candidate_scores(scores: DataFrame, targets: DataFrame, *, n: int = 48, w: float = 0.5, ensemble=(12, 24, 36, 48), min_labels: int = 24, by=BY) -> tuple[DataFrame, dict[str, str]]:
    """The scored panel with every seasonal candidate's score, and their names: production's score with the shrunk and the raw seasonal
    deviation, the prior with it, the prior alone, shrunk rates, and the mean rank of several windows."""
    keys = [*by, "position", "series_id"]
    d = scores.join(G.seasonal_dev(targets, min_labels=min_labels, by=by).select(*keys, "seasonal_tau2", "seasonal_shrunk", "seasonal_raw"), keys, "left")
    base = G.calendar_rate(targets, n=n, min_labels=min_labels, out="_prior", by=by).select(*keys, "_prior", F.col("_prior_rows").alias("_rows"))
    d = G.eb_rate(d.join(base, keys, "left"), rate="_prior", rows="_rows", out="eb_base", by=by)
    for m in ensemble:
        d = d.join(G.calendar_rate(targets, n=m, min_labels=min(min_labels, m), out=f"_e{m}", by=by).select(*keys, f"_e{m}"), keys, "left")
    d = G.rank_ensemble(d, [f"_e{m}" for m in ensemble], min_present=min(3, len(ensemble)), by=by)
    d = d.withColumns({"overlay": F.col("p_select") + w * F.coalesce("seasonal_shrunk", F.lit(0.0)), "raw_overlay": F.col("p_select") + w * F.coalesce("seasonal_raw", F.lit(0.0)),
                       "seasonal_prior": F.col("_prior") + F.coalesce("seasonal_shrunk", F.lit(0.0)), "prior_only": F.col("_prior")})
    names = ("overlay", "raw_overlay", "seasonal_prior", "prior_only", "eb_base", "window_ensemble")
    return d, {c: c for c in names}


def study(scores: DataFrame, calls: DataFrame, targets: DataFrame, windows: dict[str, tuple[int, int]], *, hi: int, primary: str = "overlay", block: int = 6, reps: int = 500,
          seed: int = 1, by=BY, **kw) -> tuple[DataFrame, DataFrame]:
    """(summary, gate): every candidate at production's number of calls per month, against production's hits.

    A pick counts as Up unless production calls the same row Down. summary: hits, calls, overlap, difference and moving-block
    bootstrap of its sum, per candidate and window. gate: no loss in tuning and confirmation, a gain in validation that
    the bootstrap's 10 % quantile does not undo.
    """
    by = list(by)
    keys = [*by, "position", "series_id"]
    live = calls.where("y_true is not null")
    mine = live.select(*keys, F.col("direction").alias("_live"))
    size = live.groupBy(*by, "position").agg(F.count(F.lit(1)).cast("int").alias("_k"),
                                             F.sum(F.when(F.col("direction") == "Down", 1 - F.col("y_true")).otherwise(F.col("y_true"))).alias("production_hits"))
    rows, names = candidate_scores(scores.where("ready and y_true is not null"), targets, by=by, **kw)
    picks = H.candidate_scores(rows.join(size, [*by, "position"]), names, "_k", hi=hi, by=by).select(*keys, "candidate", "y_true").join(mine, keys, "left")
    down = truth(F.col("_live") == "Down")
    per = picks.groupBy(*by, "candidate", "position").agg(F.sum(F.when(down, 1 - F.col("y_true")).otherwise(F.col("y_true"))).alias("hits"), F.count(F.lit(1)).alias("calls"), F.count("_live").alias("overlap"))
    # a month in which a candidate has no score has no hits
    every = size.withColumn("candidate", F.explode(F.array(*[F.lit(n) for n in names])))
    per = every.join(per, [*by, "candidate", "position"], "left").fillna(0, ["hits", "calls", "overlap"]).withColumn("delta", F.col("hits") - F.col("production_hits"))
    of = [*by, "candidate", "window"]
    w = T.in_windows(per, windows)
    s = w.groupBy(*of).agg(F.sum("hits").cast("bigint").alias("hits"), F.sum("calls").alias("calls"), F.sum("overlap").alias("overlap"), F.sum("production_hits").cast("bigint").alias("production_hits"), F.sum("delta").alias("delta"))
    b = J.block_bootstrap(w, F.sum("delta"), block=block, reps=reps, seed=seed, scheme="moving", by=of)
    s = s.withColumn("accuracy", div(F.col("hits"), F.col("calls"))).join(b.select(*of, "p10", "p50", "p90"), of)
    p = s.where(F.col("candidate") == primary).groupBy(*by).agg(*[F.max(F.when(F.col("window") == x, F.col(c))).alias(f"{x}_{c}") for x in windows for c in ("delta", "p10")])
    gates = {"tuning_not_worse": truth(F.col("tuning_delta") >= 0), "validation_better": truth(F.col("validation_delta") > 0), "validation_stable": truth(F.col("validation_p10") >= 0),
             "confirmation_not_worse": truth(F.col("confirmation_delta") >= 0)}
    g = p.withColumns(gates)
    passed = F.lit(True)
    for name in gates:
        passed = passed & F.col(name)
    return s, g.withColumn("passed", passed)
