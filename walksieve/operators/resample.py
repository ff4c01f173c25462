"""Block bootstraps and permutation tests; replicates are rows, all drawn in one job.

Random numbers come from an integer recurrence of (replicate, draw, seed), so a
lost task redraws the same numbers and SQL can repeat them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import BY, div
from ..functions.ordering import group_quantiles

MULTIPLIER, INCREMENT, MODULUS = 1103515245, 12345, 2147483647  # fixed values of the generator


def draw(rep, k, seed: int, n):
    """Integer in 0..n-1 for draw ``k`` of a replicate."""
    return F.pmod(F.pmod(rep * F.lit(MULTIPLIER).cast("bigint") + k * F.lit(INCREMENT).cast("bigint") + F.lit(seed).cast("bigint"), F.lit(MODULUS).cast("bigint")), n)


def _numbered(months: DataFrame, by) -> DataFrame:
    """Monthly rows with a 0-based index and the number of months (one row per period)."""
    w = Window.partitionBy(*by)
    return months.withColumns({"_i": (F.row_number().over(w.orderBy("position")) - 1).cast("bigint"), "_n": F.count(F.lit(1)).over(w)})


def block_draws(months: DataFrame, *, block: int, reps: int, seed: int, scheme: str, by=BY) -> DataFrame:
    """(by, rep, _i): which months each replicate holds, repeats included."""
    spark = months.sparkSession
    n = months.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 0")
    b = F.least(F.lit(block).cast("bigint"), F.col("_n"))
    r = n.crossJoin(spark.range(reps).withColumnRenamed("id", "rep"))
    blocks = F.ceil(F.col("_n") / b)
    r = r.withColumn("_b", b).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    if scheme == "circular":
        start = draw(F.col("rep"), F.col("_k"), seed, F.col("_n"))
    elif scheme == "moving":
        start = draw(F.col("rep"), F.col("_k"), seed, F.col("_n") - F.col("_b") + 1)
    elif scheme == "fixed":
        start = draw(F.col("rep"), F.col("_k"), seed, blocks) * F.col("_b")
    else:
        raise ValueError(f"unknown scheme {scheme}")
    r = r.withColumn("_s", start).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_b") - 1)))
    if scheme == "fixed":
        return r.where(F.col("_s") + F.col("_o") < F.col("_n")).select(*by, "rep", (F.col("_s") + F.col("_o")).alias("_i"))
    r = r.where(F.col("_k") * F.col("_b") + F.col("_o") < F.col("_n"))
    return r.select(*by, "rep", F.pmod(F.col("_s") + F.col("_o"), F.col("_n")).alias("_i"))


def replicates(months: DataFrame, stats: dict, *, block: int = 6, reps: int = 500, seed: int = 1, scheme: str = "circular", by=BY) -> DataFrame:
    """One row per replicate with the aggregates ``stats`` over its months."""
    d = block_draws(months, block=block, reps=reps, seed=seed, scheme=scheme, by=by)
    j = d.join(_numbered(months, by), [*by, "_i"])
    return j.groupBy(*by, "rep").agg(*[e.alias(n) for n, e in stats.items()])


def block_bootstrap(months: DataFrame, stat, *, qs=(0.1, 0.5, 0.9), thresholds=(), by=BY, **kw) -> DataFrame:
    """Observed statistic, bootstrap quantiles and shares of replicates at or above thresholds."""
    r = replicates(months, {"v": stat}, by=by, **kw)
    obs = months.groupBy(*by).agg(stat.alias("observed"), F.count(F.lit(1)).alias("months"))
    name = lambda q: f"p{int(round(q * 100)):02d}"
    aggs = [F.percentile("v", F.lit(float(q))).alias(name(q)) for q in qs]
    aggs += [F.avg((F.col("v") >= t).cast("double")).alias(f"share_ge_{int(round(t * 100))}") for t in thresholds]
    aggs.append(F.avg((F.col("v") > 0).cast("double")).alias("share_positive"))
    return obs.join(r.groupBy(*by).agg(*aggs), list(by))


def paired_months(candidate: DataFrame, baseline: DataFrame, *, common: bool = False, by=BY) -> DataFrame:
    """Monthly accuracies and hits of two selections side by side.

    ``common`` keeps only months present on both sides; otherwise a month one side
    lacks counts as no hits there.
    """
    from .metrics import monthly

    keys = [*by, "position"]
    a = monthly(candidate, by).select(*keys, F.col("hits").alias("c_hits"), F.col("accuracy").alias("c_acc"), F.col("calls").alias("c_calls"))
    b = monthly(baseline, by).select(*keys, F.col("hits").alias("b_hits"), F.col("accuracy").alias("b_acc"), F.col("calls").alias("b_calls"))
    j = a.join(b, keys, "inner" if common else "full_outer")
    return j.withColumns({"hit_delta": F.coalesce("c_hits", F.lit(0.0)) - F.coalesce("b_hits", F.lit(0.0)),
                          "accuracy_delta": F.coalesce("c_acc", F.lit(0.0)) - F.coalesce("b_acc", F.lit(0.0))})


def metric_bootstrap(df: DataFrame, p: str, y: str, *, block: int = 6, reps: int = 200, seed: int = 1, by=BY) -> DataFrame:
    """Intervals of AUC, Brier and ECE over resampled months.

    A replicate holds the rows of each month as often as the month is drawn, so the work is rows times replicates.
    """
    from .metrics import auc, ece

    d = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    months = d.select(*by, "position").distinct()
    draws = block_draws(months, block=block, reps=reps, seed=seed, scheme="circular", by=by).join(_numbered(months, by), [*by, "_i"])
    times = draws.groupBy(*by, "rep", "position").agg(F.count(F.lit(1)).alias("_t"))
    # repeat each month's rows as often as it was drawn
    x = times.join(d.select(*by, "position", p, y), [*by, "position"]).withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_t").cast("int"))))
    keys = [*by, "rep"]
    b = x.groupBy(*keys).agg(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"))
    r = b.join(auc(x, p, y, keys), keys, "left").join(ece(x, p, y, keys), keys, "left")
    q = lambda c, v: F.percentile(c, F.lit(v)).alias(f"{c}_p{int(v * 100):02d}")
    return r.groupBy(*by).agg(*[q(c, v) for c in ("auc", "brier", "ece") for v in (0.05, 0.95)])


def shift_permutation(months: DataFrame, score: str, y: str, *, reps: int = 2000, min_shift: int = 6, seed: int = 1, by=BY) -> DataFrame:
    """p-value of the AUC of a monthly score against circular shifts of itself.

    There are only as many different shifts as months, so each shift is computed
    once and weighted by how often it is drawn.
    """
    from .metrics import auc

    m = _numbered(months.where(F.col(score).isNotNull() & F.col(y).isNotNull()), by)
    n = m.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 2 * min_shift)
    reps_ = months.sparkSession.range(reps).withColumnRenamed("id", "rep")
    shifts = n.crossJoin(reps_).select(*by, (min_shift + draw(F.col("rep"), F.lit(0).cast("bigint"), seed, F.col("_n") - 2 * min_shift + 1)).alias("shift"))
    weight = shifts.groupBy(*by, "shift").agg(F.count(F.lit(1)).alias("_w"))
    zero = n.select(*by, F.lit(0).cast("bigint").alias("shift"), F.lit(0).cast("bigint").alias("_w"))
    all_s = weight.unionByName(zero)
    a = m.select(*by, "_i", "_n", F.col(score).alias("_x")).join(all_s, list(by)).withColumn("_j", F.pmod(F.col("_i") + F.col("shift"), F.col("_n")))
    b = m.select(*by, F.col("_i").alias("_j"), F.col(y).cast("double").alias("_y"))
    v = auc(a.join(b, [*by, "_j"]), "_x", "_y", [*by, "shift"]).join(all_s, [*by, "shift"])
    obs = v.where("shift = 0").select(*by, F.col("auc").alias("observed"))
    return v.where("_w > 0").join(obs, list(by)).groupBy(*by, "observed").agg(
        ((1 + F.sum(F.when(F.col("auc") >= F.col("observed"), F.col("_w")).otherwise(0))) / F.lit(1.0 + reps)).alias("p_value"))


def label_permutation(targets: DataFrame, *, reps: int = 200, seed: int = 1, min_cell: int = 3, by=BY) -> DataFrame:
    """Is the Up-rate seasonal?  Calendar months are permuted over positions, jointly for all series.

    Returns the observed heterogeneity statistic and its permutation p-value.
    """
    t = targets.where("y_true is not null").withColumn("_m", F.month(F.add_months("month", 1)))
    cal = t.select(*by, "position", "_m").distinct()
    num = _numbered(cal, by)
    r = targets.sparkSession.range(reps + 1).withColumnRenamed("id", "rep")
    # replicate 0 keeps the calendar; the others order positions by a pseudo-random key
    key = F.when(F.col("rep") == 0, F.col("_i")).otherwise(draw(F.col("rep") * 7919, F.col("_i") * 104729, seed, F.lit(MODULUS).cast("bigint")))
    p = num.crossJoin(r).withColumn("_j", (F.row_number().over(Window.partitionBy(*by, "rep").orderBy(key, "_i")) - 1).cast("bigint"))
    perm = p.select(*by, "rep", "_j", F.col("_m").alias("cell")).join(num.select(*by, F.col("_i").alias("_j"), "position"), [*by, "_j"])
    base = t.groupBy(*by, "series_id").agg(F.avg("y_true").alias("_b"))
    cells = t.select(*by, "series_id", "position", "y_true").join(perm, [*by, "position"]).groupBy(*by, "rep", "series_id", "cell").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("y_true").alias("_r")).join(base, [*by, "series_id"])
    pq = F.col("_b") * (1 - F.col("_b"))
    d = F.col("_r") - F.col("_b")
    s = cells.where((F.col("_n") >= min_cell) & (pq > 0)).groupBy(*by, "rep").agg(F.sum(F.col("_n") * d * d / pq).alias("stat"))
    obs = s.where("rep = 0").select(*by, F.col("stat").alias("observed"))
    return s.where("rep > 0").join(obs, list(by)).groupBy(*by, "observed").agg(
        F.percentile("stat", F.lit(0.5)).alias("null_median"),
        ((1 + F.sum((F.col("stat") >= F.col("observed")).cast("int"))) / (1.0 + F.count(F.lit(1)))).alias("p_value"))


def spread_null(df: DataFrame, a: str, b: str, *, reps: int = 500, seed: int = 1, by=BY) -> DataFrame:
    """Spread over series of the accuracy difference a - b, against fair coins on the rows where they disagree.

    All labelled rows and all series count. Under the null each disagreeing row goes to a with probability one half;
    a series then differs by (coins - disagreements where b is right) / rows. Coins of a series are one integer draw
    per disagreement from the generator that SQL can repeat, numbered in the order of positions.
    """
    right = lambda p: ((F.col(p) >= 0.5) == (F.col("y_true") == 1)).cast("int")
    d = df.where(F.col("y_true").isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()).withColumns({"_a": right(a), "_b": right(b)})
    per = d.groupBy(*by, "series_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum((F.col("_a") != F.col("_b")).cast("int")).alias("_k"),
        F.sum((F.col("_b") > F.col("_a")).cast("int")).alias("_lost"), F.avg(F.col("_a") - F.col("_b")).alias("_w"))
    obs = per.groupBy(*by).agg(F.stddev_samp("_w").alias("observed"), F.count(F.lit(1)).alias("series"))
    # replicates lie in an array beside each series: sums of coins, no row per replicate before the series are added up
    code = F.conv(F.substring(F.md5(F.col("series_id").cast("binary")), 1, 8), 16, 10).cast("bigint")
    coins = lambda rep: F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.col("_k").cast("bigint")), F.lit(0).cast("bigint"),
                                    lambda x, i: x + F.when(i == 0, F.lit(0)).otherwise(draw(rep * 7919 + i * 31, code, seed, F.lit(2).cast("bigint"))))
    sums = F.transform(F.sequence(F.lit(0), F.lit(reps - 1)), lambda r: coins(r.cast("bigint")))
    s = per.select(*by, "_n", "_lost", F.posexplode(sums).alias("rep", "_c"))
    null = s.groupBy(*by, "rep").agg(F.stddev_samp((F.col("_c") - F.col("_lost")) / F.col("_n")).alias("v")).join(obs, list(by))
    return null.groupBy(*by, "observed", "series").agg(
        F.percentile("v", F.lit(0.5)).alias("null_median"), F.percentile("v", F.lit(0.95)).alias("null_p95"),
        F.avg((F.col("v") >= F.col("observed")).cast("double")).alias("p_value"))


def shuffle_within(df: DataFrame, col: str, *, seed: int = 1, out: str = "shuffled", by=BY) -> DataFrame:
    """Give each series the value of another series of the same period, by a pseudo-random pairing."""
    keys = [*by, "position"]
    from ..functions.ordering import ordinal_rank

    # the position is hashed too: every period has a pairing of its own
    k = df.withColumns({f"_k{i + 1}": F.xxhash64("series_id", "position", F.lit(seed + i)).cast("double") for i in (0, 1)})
    a = ordinal_rank(k.select(*keys, "series_id", "_k1"), keys, "_k1", "_r").drop("_k1")
    b = ordinal_rank(k.select(*keys, "series_id", "_k2", col), keys, "_k2", "_r").select(*keys, "_r", F.col(col).alias(out))
    return df.join(a, [*keys, "series_id"]).join(b, [*keys, "_r"]).drop("_r")
