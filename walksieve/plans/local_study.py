"""Global, local, shrunk and interaction models compared: five families, tuned on one window and then frozen.

A global model; B local models; C both, mixed by a fixed weight; D mixed by a weight that grows with a series' history;
E pooled models with series' own slopes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import BY, clip
from ..operators import graph as E
from ..operators import metrics as I
from ..operators import priors as G
from ..operators import resample as J
from ..operators import select as H
from ..operators import targets as T

FAMILIES = {"A": "global", "B": "pure_local", "C": "fixed_shrinkage", "D": "sample_aware", "E": "interaction"}


def _mixed(df: DataFrame, w) -> DataFrame:
    """p = w local + (1 - w) global, the global score alone where there is no local one."""
    none = F.col("p_local").isNull() | (F.col("local_rows") < F.col("min_rows"))
    return df.withColumns({"fallback_used": none, "p": F.when(none, F.col("p_global")).otherwise(clip(w * F.col("p_local") + (1.0 - w) * F.col("p_global"), 1e-6, 1 - 1e-6))})


def selected(scored: DataFrame, edges: DataFrame, prior: DataFrame, *, k: int, alpha: float = 0.35, w_prior: float = 0.5, by=(*BY, "candidate")) -> DataFrame:
    """Calls of every candidate: its score spread over the graph, blended with the prior, the k best per period."""
    by = list(by)
    g = E.propagate(scored, edges, p="p", alpha=alpha, out="p_up_raw", by=by)
    keys = [*[c for c in by if c in prior.columns], "position", "series_id"]
    b = G.prior_blend(g.join(prior, keys, "left"), w=w_prior)
    return H.top_k(b.withColumn("ready", F.col("prior").isNotNull()), "p_up", k, by=by)


def _summary(calls: DataFrame, window, keys) -> DataFrame:
    return I.summarize(calls.where(F.col("position").between(*window)), keys).select(*keys, "calls", "hits", "accuracy")


def _best(table: DataFrame, order, by) -> DataFrame:
    w = Window.partitionBy(*by, "family").orderBy(*order)
    return table.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def tune(global_: DataFrame, local: DataFrame, interaction: DataFrame, edges: DataFrame, prior: DataFrame, *, window: tuple[int, int], min_rows: list[int], weights: list[float],
         references: list[int], k: int, by=BY, **kw) -> tuple[DataFrame, DataFrame]:
    """(search, frozen): all candidates' tuning results, and the best of each family.

    global_: keys, y_true, p_global; local: keys, feature_set, c, p_local, local_rows; interaction: keys, c, p. Ties go to the
    stronger penalty, the lower history, the smaller weight. The sample-aware family keeps the fixed one's features,
    penalty and history and searches the largest weight and the history at which it is reached.
    """
    by = list(by)
    keys = [*by, "position", "series_id"]
    # selection in the window needs its periods only
    inside = lambda df: df.where(F.col("position").between(*window))
    base = inside(global_).select(*keys, "y_true", "p_global")
    grid = F.array(*[F.struct(F.lit(m).alias("min_rows"), F.lit(float(w)).alias("weight")) for m in min_rows for w in sorted({1.0, *weights})])
    loc = _mixed(base.join(inside(local), keys).withColumn("_g", F.explode(grid)).select("*", "_g.min_rows", "_g.weight").drop("_g"), F.col("weight"))
    loc = loc.withColumn("family", F.when(F.col("weight") == 1.0, "pure_local").otherwise("fixed_shrinkage"))
    inter = base.join(inside(interaction).select(*keys, "c", "p"), keys).select(
        *keys, "y_true", "p", "c", F.lit("").alias("feature_set"), F.lit(0).alias("min_rows"), F.lit(None).cast("double").alias("weight"), F.lit("interaction").alias("family"))
    spec = ["family", "feature_set", "c", "min_rows", "weight"]
    every = loc.select(*keys, "y_true", "p", *spec).unionByName(inter.select(*keys, "y_true", "p", *spec))
    every = every.withColumn("candidate", F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in spec]))
    calls = selected(every, edges, prior, k=k, by=(*by, "candidate"), **kw)
    result = _summary(calls, window, [*by, "candidate", *spec])
    order = [F.col("accuracy").desc_nulls_last(), "c", "min_rows", "weight", "feature_set"]
    best = _best(result, order, by)
    fixed = best.where("family = 'fixed_shrinkage'").select(*by, "feature_set", "c", "min_rows")
    aware = F.array(*[F.struct(F.lit(float(w)).alias("weight"), F.lit(r).alias("reference")) for w in weights for r in references])
    a = base.join(inside(local).join(F.broadcast(fixed), [*by, "feature_set", "c"]), keys).withColumn("_g", F.explode(aware)).select("*", "_g.weight", "_g.reference").drop("_g").where("reference > min_rows")
    a = _mixed(a, _ramp()).withColumn("family", F.lit("sample_aware"))
    a = a.withColumn("candidate", F.concat_ws("/", "family", F.col("weight").cast("string"), F.col("reference").cast("string")))
    aspec = [*spec, "reference"]
    mine = _summary(selected(a.select(*keys, "y_true", "p", "candidate", *aspec), edges, prior, k=k, by=(*by, "candidate"), **kw), window, [*by, "candidate", *aspec])
    search = result.withColumn("reference", F.lit(None).cast("int")).unionByName(mine.select(*result.columns, "reference"))
    frozen = best.withColumn("reference", F.lit(None).cast("int")).unionByName(_best(mine, [F.col("accuracy").desc_nulls_last(), "weight", "reference"], by).select(*best.columns, "reference"))
    return search, frozen


def _ramp():
    n, lo, hi = F.col("local_rows"), F.col("min_rows"), F.col("reference")
    return F.col("weight") * clip((n - lo) / (hi - lo).cast("double"), 0.0, 1.0)


def families(global_: DataFrame, local: DataFrame, interaction: DataFrame, frozen: DataFrame, by=BY) -> DataFrame:
    """Keys, y_true, family A..E and p: every row under every frozen family."""
    by = list(by)
    keys = [*by, "position", "series_id"]
    base = global_.select(*keys, "y_true", "p_global")
    f = frozen.select(*by, "family", "feature_set", "c", "min_rows", "weight", "reference")
    loc = base.join(local.join(F.broadcast(f.where("family <> 'interaction'")), [*by, "feature_set", "c"]), keys)  # three rows per panel
    loc = _mixed(loc, F.when(F.col("family") == "sample_aware", _ramp()).otherwise(F.col("weight")))
    inter = base.join(interaction.select(*keys, "c", "p").join(F.broadcast(f.where("family = 'interaction'").select(*by, "c")), [*by, "c"]), keys)
    letter = F.create_map(*[F.lit(v) for k, n in FAMILIES.items() for v in (n, k)])
    out = [base.select(*keys, "y_true", F.lit("A").alias("candidate"), F.col("p_global").alias("p")), loc.select(*keys, "y_true", letter[F.col("family")].alias("candidate"), "p"),
           inter.select(*keys, "y_true", F.lit("E").alias("candidate"), "p")]
    return out[0].unionByName(out[1]).unionByName(out[2])


def evaluate(scored: DataFrame, edges: DataFrame, prior: DataFrame, windows: dict[str, tuple[int, int]], *, k: int, block: int = 6, reps: int = 500, seed: int = 1, by=BY, **kw) -> DataFrame:
    """Per family and window: calls, hits, months' mean and median accuracy, overlap with A, and the paired circular bootstrap of the monthly hit difference to A."""
    by = list(by)
    byc = [*by, "candidate"]
    calls = selected(scored, edges, prior, k=k, by=byc, **kw)
    w = T.in_windows(calls, windows)
    of = [*byc, "window"]
    main = I.summarize(w, of).select(*of, "months", "calls", "hits", "accuracy").join(I.monthly_stats(w, of), of)
    ids = [*by, "position", "series_id"]
    ref = calls.where("candidate = 'A'").select(*ids).withColumn("_in", F.lit(1))
    shared = w.join(ref, ids, "left").groupBy(*of).agg(F.count("_in").alias("shared_with_global"))
    rival = calls.where("candidate = 'A'").drop("candidate").join(F.broadcast(calls.select(*byc).distinct()), by)
    pairs = T.in_windows(J.paired_months(calls, rival, by=byc), windows)
    boot = J.block_bootstrap(pairs, F.avg("hit_delta"), block=block, reps=reps, seed=seed, by=of).select(*of, F.col("observed").alias("mean_hit_delta"), "p10", "p50", "p90")
    names = F.create_map(*[F.lit(v) for a, n in FAMILIES.items() for v in (a, n)])
    return main.join(shared, of).join(boot, of, "left").withColumn("family", names[F.col("candidate")])
