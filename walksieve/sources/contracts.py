"""Table contracts: each check returns the offending rows, an empty result is a pass."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import BY


class ContractError(ValueError):
    """A contract on columns (metadata only) is broken."""


def check_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    return df


def check_names(df: DataFrame, prefix: str) -> DataFrame:
    """Columns other than the first must be prefix1..prefixN without a gap."""
    names = df.columns[1:]
    numbers = {int(m.group(1)) for n in names if (m := re.fullmatch(re.escape(prefix) + r"(\d+)", n))}
    wanted = set(range(1, len(names) + 1))
    bad = [(n, "not numbered") for n in names if not re.fullmatch(re.escape(prefix) + r"\d+", n)]
    bad += [(f"{prefix}{i}", "missing") for i in sorted(wanted - numbers)]
    return df.sparkSession.createDataFrame(bad, "name string, problem string")


def check_calendar(df: DataFrame, time: str = "month", keys: list[str] | None = None) -> DataFrame:
    """Duplicate, mid-month-free and missing months per key.

    A gap is found from the previous month of the same key, so the calendar is
    never joined; a gap of many months is still one row with its length.
    """
    keys = list(keys or [])
    month = F.trunc(F.col(time), "month")
    per = df.groupBy(*keys, month.alias("month")).agg(F.count(F.lit(1)).alias("n"))
    part = keys or [F.lit(0)]
    w = Window.partitionBy(*part).orderBy("month")
    prev = F.lag("month").over(w)
    gap = (F.months_between("month", prev) - 1).cast("bigint")
    marked = per.withColumn("gap", F.coalesce(gap, F.lit(0)))
    return (
        marked.select(
            *keys,
            "month",
            F.explode(
                F.array_compact(F.array(
                    F.when(F.col("n") > 1, F.struct(F.lit("duplicate").alias("problem"), (F.col("n") - 1).alias("amount"))),
                    F.when(F.col("gap") > 0, F.struct(F.lit("gap_before").alias("problem"), F.col("gap").alias("amount"))),
                ))
            ).alias("v"),
        ).select(*keys, "month", "v.problem", "v.amount")
    )


def check_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-null cells per column that are not numbers."""
    bad = [
        F.sum(F.when(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` as double)").isNull(), 1).otherwise(0))
        .cast("bigint").alias(c)
        for c in columns
    ]
    return df.agg(*bad).unpivot([], columns, "column_name", "bad_cells").where("bad_cells > 0")


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def check_leakage(df: DataFrame, fit_col: str, lag: int = 1) -> DataFrame:
    """Rows whose model or statistic saw labels newer than position - lag - 1."""
    return df.where(F.col(fit_col) > F.col("position") - lag - 1)


def check_coverage(df: DataFrame, lo: int, hi: int, by=BY) -> DataFrame:
    """Positions of lo..hi that are absent and positions outside that are present."""
    have = df.select(*by, "position").distinct()
    want = have.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("position"))
    keys = [*by, "position"]
    missing = want.join(have, keys, "left_anti").withColumn("problem", F.lit("missing"))
    extra = have.where(~F.col("position").between(lo, hi)).withColumn("problem", F.lit("extra"))
    return missing.unionByName(extra)


def calls_per_period(calls: DataFrame, lo: int, hi: int, by=BY) -> DataFrame:
    """Periods whose number of calls leaves lo..hi or that repeat a series."""
    n = calls.groupBy(*by, "position").agg(
        F.count(F.lit(1)).alias("calls"), F.count_distinct("series_id").alias("series")
    )
    return n.where(~F.col("calls").between(lo, hi) | (F.col("calls") != F.col("series")))


def split_outcomes(scores: DataFrame, inputs: list[str], outcomes: list[str], score: str, by=BY):
    """Cut a table into label-free inputs (with the rank of the Up score) and labels.

    Only ready rows are ranked; equal scores are ranked by series id.
    """
    keys = [*by, "position", "series_id"]
    from ..functions.ordering import ordinal_rank

    clash = set(inputs) & set(outcomes)
    if clash:
        raise ContractError(f"outcome columns allowed as inputs: {sorted(clash)}")
    pool = scores.where(F.col("ready") & F.col(score).isNotNull()).select(*keys, score)
    ranked = ordinal_rank(pool, [*by, "position"], score, "base_up_rank").drop(score)
    left = scores.select(*keys, *inputs).join(ranked, keys, "left")
    return left, scores.select(*keys, *outcomes)


def attach_outcomes(inputs: DataFrame, outcomes: DataFrame, by=BY) -> tuple[DataFrame, DataFrame]:
    """(joined table, key mismatches); inputs must not carry outcome columns."""
    keys = [*by, "position", "series_id"]
    carried = [c for c in outcomes.columns if c not in keys and c in inputs.columns]
    if carried:
        raise ContractError(f"inputs already carry outcomes: {carried}")
    a = inputs.select(*keys, F.lit(1).alias("_a"))
    b = outcomes.select(*keys, F.lit(1).alias("_b"))
    audit = a.join(b, keys, "full_outer").where(F.col("_a").isNull() | F.col("_b").isNull()).select(
        *keys, F.when(F.col("_a").isNull(), "no_input").otherwise("no_outcome").alias("problem")
    )
    return inputs.join(outcomes, keys), audit


def assert_equal(a: DataFrame, b: DataFrame, keys: list[str], *, tol: float = 0.0) -> DataFrame:
    """Rows where two tables disagree: missing on a side, or a value beyond ``tol``."""
    values = [c for c in a.columns if c not in keys]
    kinds = dict(a.dtypes)
    x = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in values], F.lit(1).alias("_a"))
    y = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in values], F.lit(1).alias("_b"))
    j = x.join(y, keys, "full_outer")
    tests = []
    for c in values:
        p, q = F.col(f"a_{c}"), F.col(f"b_{c}")
        same = p.eqNullSafe(q)
        if kinds[c] in ("double", "float"):
            same = same | F.coalesce(F.abs(p - q) <= tol, F.lit(False))
        tests.append(F.when(~same, F.lit(c)))
    side = F.when(F.col("_a").isNull(), "left").when(F.col("_b").isNull(), "right")
    out = j.select(
        *keys,
        side.alias("missing_side"),
        F.array_join(F.array_compact(F.array(*tests)), ",").alias("differing"),
    )
    return out.where(F.col("missing_side").isNotNull() | (F.col("differing") != ""))
