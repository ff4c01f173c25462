"""Accuracy, probability and comparison metrics, grouped by any keys."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (
    BY, Z_ONE_SIDED_95, Z_TWO_SIDED_95, clip, correct, div, flag, logit, market_window, roll, truth, wilson_bounds,
)
from ..functions.ordering import average_rank, group_quantiles, pct_rank, top_k, value_ranks


def _rows():
    """Count of rows; columns need a session, which importing this module must not."""
    return F.count(F.lit(1))


def with_correct(calls: DataFrame, direction: str = "direction") -> DataFrame:
    return calls.withColumn("correct", correct(direction))


def summarize(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Months, calls, hits, accuracy and the Down side, per key; unlabelled calls are left out."""
    c = with_correct(calls).where("correct is not null")
    down = F.col("direction") == "Down"
    return c.groupBy(*keys).agg(
        F.count_distinct("position").alias("months"), _rows().alias("calls"), F.sum("correct").cast("bigint").alias("hits"),
        F.avg("correct").alias("accuracy"), F.sum((~down).cast("int")).alias("up_calls"), F.sum(down.cast("int")).alias("down_calls"),
        F.coalesce(F.sum(F.when(down, F.col("correct"))), F.lit(0.0)).cast("bigint").alias("down_hits"),
        F.avg(F.when(down, F.col("correct"))).alias("down_precision"))


def monthly(calls: DataFrame, keys=BY) -> DataFrame:
    c = with_correct(calls).where("correct is not null")
    return c.groupBy(*keys, "position").agg(_rows().alias("calls"), F.sum("correct").alias("hits"), F.avg("correct").alias("accuracy"))


def monthly_stats(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, median and spread of the monthly accuracy; the months of a key are few."""
    m = monthly(calls, keys)
    return m.groupBy(*keys).agg(F.avg("accuracy").alias("monthly_mean"), F.percentile("accuracy", F.lit(0.5)).alias("monthly_median"),
                                F.coalesce(F.stddev_samp("accuracy"), F.lit(0.0)).alias("monthly_std"))


def auc(df: DataFrame, score: str, y: str, keys: list[str], out: str = "auc") -> DataFrame:
    """Tie-corrected area under the ROC curve; null with a single class."""
    d = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    pos = d.groupBy(*keys, score).agg(F.sum(F.col(y)).alias("_p"))
    r = value_ranks(d, keys, score).join(pos, [*keys, score])
    a = r.groupBy(*keys).agg(F.sum(average_rank() * F.col("_p")).alias("_s"), F.sum("_p").alias("_np"), F.max("n_all").alias("_n"))
    p, n = F.col("_np"), F.col("_n") - F.col("_np")
    return a.select(*keys, div(F.col("_s") - p * (p + 1) / 2.0, p * n).alias(out))


def avg_precision(df: DataFrame, score: str, y: str, keys: list[str], out: str = "average_precision") -> DataFrame:
    """Sum over score levels of recall gain times precision, equal scores taken together."""
    d = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).withColumn("_neg", -F.col(score))
    lv = d.groupBy(*keys, "_neg").agg(F.sum(F.col(y)).alias("_p"))
    ranks = value_ranks(d, keys, "_neg")
    # positives at or above a level: the same prefix, counted over the positive rows
    pos = value_ranks(d.where(F.col(y) == 1), keys, "_neg").select(*keys, "_neg", (F.col("n_below") + F.col("n_eq")).alias("_tp"), F.col("n_all").alias("_all"))
    j = ranks.join(lv, [*keys, "_neg"]).join(pos, [*keys, "_neg"])
    return j.groupBy(*keys).agg(F.sum(F.col("_p") / F.col("_all") * F.col("_tp") / (F.col("n_below") + F.col("n_eq"))).alias(out))


def brier(p, y):
    return F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y)))


def log_loss(p, y, eps: float = 1e-6):
    q = clip(p, eps, 1 - eps)
    return F.avg(-(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q)))


def ece(df: DataFrame, p: str, y: str, keys: list[str], *, bins: int = 10, out: str = "ece") -> DataFrame:
    d = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).withColumn("_b", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)))
    b = d.groupBy(*keys, "_b").agg(_rows().alias("_n"), F.avg(p).alias("_p"), F.avg(y).alias("_y"))
    return b.groupBy(*keys).agg((F.sum(F.col("_n") * F.abs(F.col("_p") - F.col("_y"))) / F.sum("_n")).alias(out))


def ece_quantile(df: DataFrame, p: str, y: str, keys: list[str], *, bins: int = 10, out: str = "ece_quantile") -> DataFrame:
    """ECE on quantile edges; a key without spread falls into one bucket."""
    d = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    e = group_quantiles(d, keys, p, {f"_q{i}": i / bins for i in range(1, bins)})
    b = sum(((F.col(p) > F.col(f"_q{i}")).cast("int") for i in range(1, bins)), F.lit(0))
    d = d.join(e, keys).withColumn("_b", b).groupBy(*keys, "_b").agg(_rows().alias("_n"), F.avg(p).alias("_p"), F.avg(y).alias("_y"))
    return d.groupBy(*keys).agg((F.sum(F.col("_n") * F.abs(F.col("_p") - F.col("_y"))) / F.sum("_n")).alias(out))


def metrics(df: DataFrame, p: str, y: str, keys: list[str]) -> DataFrame:
    """Rows, accuracy, balanced accuracy, Brier, log loss, AUC, ECE and Spearman per key."""
    d = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    up = F.col(p) >= 0.5
    hit = flag(up == (F.col(y) == 1.0))
    base = d.groupBy(*keys).agg(
        _rows().alias("n"), F.sum(hit).cast("bigint").alias("hits"), F.avg(hit).alias("accuracy"),
        ((F.avg(F.when(F.col(y) == 1.0, hit)) + F.avg(F.when(F.col(y) == 0.0, hit))) / 2.0).alias("balanced_accuracy"),
        brier(p, y).alias("brier"), log_loss(p, y).alias("log_loss"), F.avg(p).alias("mean_probability"), F.avg(y).alias("base_rate"))
    return base.join(auc(d, p, y, keys), keys, "left").join(ece(d, p, y, keys), keys, "left").join(spearman(d, p, y, keys), keys, "left")


def spearman(df, a: str, b: str, keys: list[str], out: str = "spearman") -> DataFrame:
    ids = [*keys]
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ra = value_ranks(d, ids, a).select(*ids, a, average_rank().alias("_ra"))
    rb = value_ranks(d, ids, b).select(*ids, b, average_rank().alias("_rb"))
    # the correlation of ranks needs each pair of values once, with its multiplicity
    c = d.groupBy(*ids, a, b).agg(_rows().alias("_c")).join(ra, [*ids, a]).join(rb, [*ids, b])
    w, x, z = F.col("_c"), F.col("_ra"), F.col("_rb")
    s = c.groupBy(*ids).agg(F.sum(w).alias("n"), F.sum(w * x).alias("sx"), F.sum(w * z).alias("sz"), F.sum(w * x * x).alias("sxx"),
                            F.sum(w * z * z).alias("szz"), F.sum(w * x * z).alias("sxz"))
    n = F.col("n")
    num = F.col("sxz") - F.col("sx") * F.col("sz") / n
    den = F.sqrt((F.col("sxx") - F.col("sx") * F.col("sx") / n) * (F.col("szz") - F.col("sz") * F.col("sz") / n))
    return s.select(*ids, div(num, den).alias(out))


def wilson(df: DataFrame, hits: str, calls: str, *, z: float = Z_TWO_SIDED_95, prefix: str = "wilson") -> DataFrame:
    lo, hi = wilson_bounds(hits, calls, z)
    return df.withColumns({f"{prefix}_low": lo, f"{prefix}_high": hi})


def cohort(calls: DataFrame, *, min_months: int = 12, lag: int = 2, by=BY) -> DataFrame:
    """Causal Laplace-smoothed hit rate of earlier calls with a one-sided Wilson bound, per period."""
    c = with_correct(calls)
    m = c.groupBy(*by, "position").agg(F.sum("correct").alias("_h"), F.count("correct").alias("_n"))
    w = Window.partitionBy(*by).orderBy("position").rangeBetween(Window.unboundedPreceding, -lag)
    has = F.col("_n") > 0
    m = m.select(*by, "position", F.coalesce(F.sum("_h").over(w), F.lit(0.0)).alias("_h"),
                 F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("history_calls"),
                 F.sum(has.cast("int")).over(w).alias("_m"), F.max(F.when(has, F.col("position"))).over(w).alias("_last"))
    ok = F.coalesce("_m", F.lit(0)) >= min_months
    h, n = F.col("_h") + 1.0, F.col("history_calls") + 2.0
    lo, _ = wilson_bounds(h, n, Z_ONE_SIDED_95)
    return m.select(*by, "position", "history_calls", F.coalesce("_m", F.lit(0)).alias("history_months"),
                    F.when(ok, h / n).alias("cohort_probability"), F.when(ok, lo).alias("cohort_lcb"), F.when(ok, F.col("_last")).alias("fit_through"))


def _bucket(p, edges):
    """Number of interior edges not above the value: left-closed buckets."""
    return sum(((F.col(p) >= e).cast("int") for e in edges[1:-1]), F.lit(0))


RELIABILITY_EDGES = [0.0, 0.55, 0.60, 0.65, 0.70, 0.75, 1.0]


def reliability(df: DataFrame, p: str, y: str, keys: list[str], edges=None) -> DataFrame:
    edges = edges or RELIABILITY_EDGES
    d = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).withColumn("bucket", _bucket(p, edges))
    a = d.groupBy(*keys, "bucket").agg(_rows().alias("calls"), F.avg(p).alias("mean_probability"), F.avg(y).alias("observed"), F.sum(y).alias("_h"))
    a = wilson(a, "_h", "calls")
    return a.withColumn("wilson_lcb", wilson_bounds("_h", "calls", Z_ONE_SIDED_95)[0]).drop("_h")


def qcut_table(df: DataFrame, p: str, y: str, keys: list[str], n: int = 5) -> DataFrame:
    """Right-closed quantile buckets; equal edges merge."""
    d = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    q = group_quantiles(d, keys, p, {f"_q{i}": i / n for i in range(n + 1)})
    edges = F.array_sort(F.array_distinct(F.array(*[F.col(f"_q{i}") for i in range(1, n)])))
    d = d.join(q.select(*keys, edges.alias("_e"), F.col("_q0"), F.col(f"_q{n}")), keys)
    d = d.withColumn("bucket", F.size(F.filter("_e", lambda e: (F.col(p) > e) & (e > F.col("_q0")))) + 1)
    return d.groupBy(*keys, "bucket").agg(_rows().alias("calls"), F.avg(p).alias("mean_score"), F.avg(y).alias("observed"))


def slices(calls: DataFrame, cols: list[str]) -> DataFrame:
    """The summary metrics once per value of each slicing column (grouping sets)."""
    c = with_correct(calls).where("correct is not null")
    sets = [[F.col(x)] for x in cols]
    g = c.groupingSets(sets, *[F.col(x) for x in cols]).agg(_rows().alias("calls"), F.avg("correct").alias("accuracy"),
                                                            *[F.grouping(x).alias(f"_g_{x}") for x in cols])
    name = F.coalesce(*[F.when(F.col(f"_g_{x}") == 0, F.concat(F.lit(f"{x}:"), F.coalesce(F.col(x).cast("string"), F.lit("null")))) for x in cols])
    return g.select(name.alias("slice"), "calls", "accuracy")


def coverage_curve(df: DataFrame, p: str, y: str, keys: list[str], thresholds=(0.5, 0.55, 0.6, 0.65, 0.7, 0.75)) -> DataFrame:
    d = df.where(F.col(p).isNotNull())
    exprs, items = [], []
    for i, t in enumerate(thresholds):
        keep = F.col(p) >= t
        exprs += [F.sum(keep.cast("int")).alias(f"_n{i}"), F.avg(F.when(keep, F.col(y))).alias(f"_a{i}")]
        items.append(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_n{i}").cast("bigint").alias("calls"),
                              (F.col(f"_n{i}") / F.col("_all")).alias("coverage"), F.col(f"_a{i}").alias("accuracy")))
    return d.groupBy(*keys).agg(_rows().alias("_all"), *exprs).select(*keys, F.explode(F.array(*items)).alias("x")).select(*keys, "x.*")


def diversity(df: DataFrame, a: str, b: str, y: str, keys: list[str]) -> DataFrame:
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(y).isNotNull())
    ca, cb = (F.col(a) >= 0.5) == (F.col(y) == 1), (F.col(b) >= 0.5) == (F.col(y) == 1)
    dis = (F.col(a) >= 0.5) != (F.col(b) >= 0.5)
    one = lambda c: F.sum(c.cast("int"))
    m = d.groupBy(*keys).agg(
        _rows().alias("n"), F.corr(a, b).alias("pearson"), one(dis).alias("disagreements"), F.avg(F.when(dis, ca.cast("double"))).alias("a_accuracy_on_disagreements"),
        F.avg(F.when(dis, cb.cast("double"))).alias("b_accuracy_on_disagreements"), one(~cb & ca).alias("b_wrong_a_right"), one(~ca & ~cb).alias("double_faults"))
    return m.join(spearman(d, a, b, keys), keys, "left")


def top_n(scores: DataFrame, score: str, y: str, ns: list[int], keys: list[str], by=BY) -> DataFrame:
    """Precision of the best N rows of every period for several N."""
    c = top_k(scores.where(F.col(score).isNotNull()), [*by, "position"], [F.col(score).desc(), F.col("series_id").asc()], max(ns))
    c = c.withColumn("n", F.explode(F.filter(F.array(*[F.lit(n) for n in ns]), lambda n: F.col("rank") <= n)))
    return c.groupBy(*keys, "n").agg(F.count(y).alias("calls"), F.avg(y).alias("precision"))


def rank_bands(calls: DataFrame, bands: dict[str, tuple[int, int]], keys: list[str]) -> DataFrame:
    c = with_correct(calls).where("correct is not null")
    hits = F.array_compact(F.array(*[F.when(F.col("rank").between(lo, hi), F.lit(n)) for n, (lo, hi) in bands.items()]))
    return c.withColumn("band", F.explode(hits)).groupBy(*keys, "band").agg(_rows().alias("calls"), F.sum("correct").cast("bigint").alias("hits"), F.avg("correct").alias("accuracy"))


def drift(calls: DataFrame, *, k: int = 12, m: int = 6, by=BY) -> DataFrame:
    c = with_correct(calls).where("correct is not null")
    g = c.groupBy(*by, "position").agg(_rows().alias("calls"), F.avg("correct").alias("accuracy"), F.avg("y_true").alias("prevalence"))
    return g.withColumn("rolling_accuracy", roll(F.avg, "accuracy", k, m, market_window, by))


def overlap(a: DataFrame, b: DataFrame, by=BY) -> DataFrame:
    """Per period: shared, added and removed calls and what they were worth (as Up calls)."""
    keys = [*by, "position"]
    x = a.select(*keys, "series_id", F.col("y_true").alias("_ya"), F.lit(True).alias("_a"))
    z = b.select(*keys, "series_id", F.col("y_true").alias("_yb"), F.lit(True).alias("_b"))
    j = x.join(z, [*keys, "series_id"], "full_outer")
    ina, inb = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    names = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("series_id")))), ",")
    return j.groupBy(*keys).agg(
        F.sum(ina.cast("int")).alias("baseline_calls"), F.sum(inb.cast("int")).alias("candidate_calls"), F.sum((ina & inb).cast("int")).alias("overlap"),
        names(inb & ~ina).alias("added"), names(ina & ~inb).alias("removed"),
        (F.coalesce(F.sum(F.when(inb & ~ina, F.col("_yb"))), F.lit(0.0)) - F.coalesce(F.sum(F.when(ina & ~inb, F.col("_ya"))), F.lit(0.0))).alias("net_hit_change"))


def per_series(scores: DataFrame, selections: dict[str, DataFrame], probabilities: dict[str, str]) -> DataFrame:
    d = scores.where("y_true is not null")
    t = d.groupBy("series_id").agg(_rows().alias("rows"), F.avg("y_true").alias("up_rate"), *[
        F.avg(flag((F.col(c) >= 0.5) == (F.col("y_true") == 1))).alias(f"raw_accuracy_{n}") for n, c in probabilities.items()])
    for n, c in selections.items():
        s = with_correct(c).where("correct is not null").groupBy("series_id").agg(_rows().alias(f"selected_{n}"), F.avg("correct").alias(f"selected_accuracy_{n}"))
        t = t.join(s, "series_id", "left")
    return t


def scenarios(scores: DataFrame, calls: DataFrame, outcomes: DataFrame, keys: list[str], by=BY) -> DataFrame:
    """Window metrics for each regime and for all regimes together (rollup)."""
    ids = [*by, "position", "series_id"]
    c = calls.select(*ids, F.col("direction").alias("_d"))
    d = scores.drop("direction").join(c, ids, "left").join(outcomes.select(*ids, "label_valid", "sudden_drop"), ids, "left")
    y, sel = F.col("y_true"), F.col("_d").isNotNull() & F.col("y_true").isNotNull()
    down = sel & (F.col("_d") == "Down")
    shock = truth(F.col("label_valid") & F.col("sudden_drop"))
    n = lambda x: F.sum(truth(x).cast("int"))
    hit = correct("_d")
    g = d.rollup(*keys, "regime_label").agg(
        *[F.grouping(k).alias(f"_g_{k}") for k in keys], F.grouping("regime_label").alias("_g"),
        F.count_distinct(F.when(sel, F.col("position"))).alias("months"), n(sel).alias("calls"), F.coalesce(F.sum(hit), F.lit(0.0)).cast("bigint").alias("hits"),
        F.avg(hit).alias("accuracy"), n(down).alias("down_calls"), n(down & (y == 0)).alias("down_hits"), n(y == 0).alias("_down_all"),
        n(shock).alias("sudden_drops"), n(down & shock).alias("sudden_down_calls"))
    g = g.where(" and ".join(f"_g_{k} = 0" for k in keys))
    return g.select(*keys, F.when(F.col("_g") == 1, "all").otherwise(F.col("regime_label")).alias("regime"), "months", "calls", "hits", "accuracy",
                    "down_calls", "down_hits", div(F.col("down_hits"), F.col("down_calls")).alias("down_precision"),
                    div(F.col("down_hits"), F.col("_down_all")).alias("down_recall"), "sudden_drops", "sudden_down_calls",
                    div(F.col("sudden_down_calls"), F.col("sudden_drops")).alias("sudden_drop_recall"))


def policy_delta(calls: DataFrame, keys: list[str], a: str = "direction", b: str = "policy_direction") -> DataFrame:
    down = F.col(b) == "Down"
    g = calls.where("y_true is not null").groupBy(*keys).agg(
        F.count_distinct("position").alias("months"), _rows().alias("calls"), F.sum(correct(a)).cast("bigint").alias("hits_baseline"),
        F.sum(correct(b)).cast("bigint").alias("hits_policy"), F.sum(down.cast("int")).alias("down_calls"),
        F.sum((down & (F.col("y_true") == 0)).cast("int")).alias("down_hits"))
    return g.withColumns({"delta_hits": F.col("hits_policy") - F.col("hits_baseline"),
                          "accuracy_delta_pp": 100.0 * (F.col("hits_policy") - F.col("hits_baseline")) / F.col("calls"),
                          "down_precision": div(F.col("down_hits"), F.col("down_calls"))})


def replacement(calls: DataFrame, keys: list[str]) -> DataFrame:
    """What recorded replacements gained, and the sources of Down calls."""
    ev = F.col("victim_correct").isNotNull()
    src = lambda s: F.sum(((F.col("direction") == "Down") & (F.col("source") == s)).cast("int"))
    return calls.groupBy(*keys).agg(
        _rows().alias("calls"), F.sum("call_correct").cast("bigint").alias("hits"), F.sum((F.col("direction") == "Down").cast("int")).alias("final_down_calls"),
        src("external_insert").alias("external_inserts"), src("overlay_flip").alias("overlay_flips"), src("up").alias("retained_downs"),
        F.coalesce(F.sum(F.when(ev, F.col("call_correct") - F.col("victim_correct"))), F.lit(0.0)).cast("bigint").alias("replacement_delta"))


def down_distribution(calls: DataFrame, keys: list[str], by=BY) -> DataFrame:
    """Map from the number of Down calls of a period to how many periods had it."""
    m = calls.groupBy(*by, *keys, "position").agg(F.sum((F.col("direction") == "Down").cast("int")).alias("_d"))
    h = m.groupBy(*keys, "_d").agg(_rows().alias("_n"))
    return h.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_d", "_n")))).alias("down_distribution"))


def cap_distribution(calls: DataFrame, by=BY) -> DataFrame:
    m = calls.groupBy(*by, "position").agg(_rows().alias("cap"))
    return m.groupBy("cap").agg(_rows().alias("months"))


def expansion_only(calls: DataFrame, base: int, keys: list[str]) -> DataFrame:
    """Hits of the ranks beyond the base that were not inserted as replacements."""
    c = with_correct(calls).where((F.col("rank") > base) & ~F.col("replacement") & F.col("correct").isNotNull())
    return c.groupBy(*keys).agg(_rows().alias("calls"), F.sum("correct").cast("bigint").alias("hits"))
