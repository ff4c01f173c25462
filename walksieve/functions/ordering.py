"""Order statistics inside a group that stay spread over many tasks.

A cross-section (all series of one period) or an evaluation window can hold a
large share of all rows, so none of these helpers sorts a whole group in one
task.  They collapse equal values first, cut each group into value buckets from
a small sample chosen by hash, order inside ``(group, bucket)`` and shift by the
bucket totals.  The sample only decides where the cuts are; the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import col

BUCKETS = 32
#: Sampled values per bucket at most.
SAMPLE = 16


def cut_points(values: DataFrame, keys: list[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """Array `_edges` per group that cuts its distinct values into buckets of similar size.

    Values are dealt into classes by hash and the one with the smallest hash stands for its class, so the sample and the
    cuts are the same in whatever order rows arrive: several branches of a plan may compute them on their own.
    """
    h = F.xxhash64(value)
    sample = values.groupBy(*keys, F.pmod(h, F.lit(SAMPLE * buckets)).alias("_class")).agg(F.min_by(value, h).alias("_v"))
    ordered = sample.groupBy(*keys).agg(F.array_sort(F.collect_list("_v")).alias("_s"))
    at = F.sequence(F.lit(1), F.lit(buckets - 1))
    return ordered.select(*keys, F.array_distinct(F.transform(at, lambda i: F.get("_s", F.floor(i * F.size("_s") / F.lit(buckets)).cast("int")))).alias("_edges"))


def value_ranks(df: DataFrame, keys: list[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """One row per distinct non-null value: ``n_eq`` copies, ``n_below`` smaller rows, ``n_all``."""
    counts = (
        df.where(col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n_eq"))
    )
    edges = cut_points(counts, keys, value, buckets)
    bucketed = counts.join(edges, keys).withColumn(
        "_b", F.size(F.filter("_edges", lambda e: e < F.col(value)))
    ).drop("_edges")
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(
        Window.unboundedPreceding, -1
    )
    local = bucketed.withColumn("_in", F.coalesce(F.sum("n_eq").over(inside), F.lit(0)))
    # one row per (group, bucket): at most `buckets` rows per group
    totals = bucketed.groupBy(*keys, "_b").agg(F.sum("n_eq").alias("_bn"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_b",
        F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_off"),
        F.sum("_bn").over(Window.partitionBy(*keys)).alias("n_all"),
    )
    return local.join(offsets, [*keys, "_b"]).select(
        *keys, value, "n_eq", (F.col("_off") + F.col("_in")).alias("n_below"), "n_all"
    )


def average_rank() -> Column:
    """1-based rank with ties averaged, from the columns of ``value_ranks``."""
    return F.col("n_below") + (F.col("n_eq") + 1) / F.lit(2.0)


def with_average_rank(df, keys, value, out, *, pct=False, descending=False, buckets=BUCKETS):
    """Add the average-tie rank of ``value`` (or its share of the non-null count)."""
    r = average_rank()
    if descending:
        r = F.col("n_all") + 1 - r
    ranks = value_ranks(df, keys, value, buckets).select(
        *keys, value, (r / F.col("n_all") if pct else r).alias(out)
    )
    return _rejoin(df, ranks, keys, value).select(*df.columns, out)


def _rejoin(df, ranks, keys, value):
    """Left join of rows with their value's rank. Rows without a value match nothing and are dealt out over many tasks."""
    rest = [c for c in df.columns if c not in (*keys, value)]
    salt = F.when(F.col(value).isNull(), F.pmod(F.xxhash64(*rest), F.lit(256)) if rest else F.lit(0)).otherwise(F.lit(-1))
    return df.withColumn("_salt", salt.cast("int")).join(ranks.withColumn("_salt", F.lit(-1)), [*keys, value, "_salt"], "left").drop("_salt")


def pct_rank(df, keys, value, out, buckets: int = BUCKETS):
    return with_average_rank(df, keys, value, out, pct=True, buckets=buckets)


def group_quantiles(df, keys, value, qs: dict[str, float], buckets: int = BUCKETS) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per entry of ``qs``."""
    ranks = value_ranks(df, keys, value, buckets)
    picks = {}
    for name, q in qs.items():
        h = (F.col("n_all") - 1) * F.lit(float(q))
        lo, hi = F.floor(h), F.ceil(h)
        holds = lambda k: (F.col("n_below") <= k) & (k < F.col("n_below") + F.col("n_eq"))
        picks[f"_lo_{name}"] = F.max(F.when(holds(lo), F.col(value)))
        picks[f"_hi_{name}"] = F.max(F.when(holds(hi), F.col(value)))
        picks[f"_f_{name}"] = F.max(h - lo)
    agg = ranks.groupBy(*keys).agg(*[e.alias(n) for n, e in picks.items()])
    return agg.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in qs
        ],
    )


def top_k(df: DataFrame, keys, order: list, k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per group.

    The literal bound lets Spark keep only ``k`` rows per group in every map task
    before the shuffle, so a huge group never meets in one place.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= F.lit(int(k)))


def score_order(score: str, *, descending: bool = True) -> list:
    """The ranking contract: score first, equal scores by series id ascending."""
    s = F.col(score)
    return [s.desc_nulls_last() if descending else s.asc_nulls_last(), F.col("series_id").asc()]


def ordinal_rank(df: DataFrame, keys, score: str, out: str, buckets: int = BUCKETS) -> DataFrame:
    """Full 1-based ranking by score descending, equal scores by series id.

    The number of better rows comes from ``value_ranks``; only rows with the same
    score are ordered among themselves.
    """
    ranks = value_ranks(df, keys, score, buckets).select(
        *keys, score, (F.col("n_all") - F.col("n_below") - F.col("n_eq")).alias("_better")
    )
    # only values that several rows share are ordered by series; rows without a score are in no order
    shared = F.when(F.col(score).isNull(), F.xxhash64("series_id")).otherwise(F.lit(0))
    tie = Window.partitionBy(*keys, score, shared).orderBy(F.col("series_id").asc())
    d = _rejoin(df.withColumn("_t", F.row_number().over(tie)), ranks, keys, score)
    return d.select(*df.columns, (F.col("_better") + F.col("_t")).alias(out))
