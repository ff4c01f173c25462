"""Parameter search, qualification and promotion gates.

A grid is a table of candidates; selectors replay it by carrying candidate_id in
their keys, so the whole search is one job.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import BY, const_frame, truth


def grid_frame(spark, grid: dict[str, list]) -> DataFrame:
    names = list(grid)
    rows = [(i, *map(float, v)) for i, v in enumerate(product(*grid.values()))]
    return const_frame(spark, rows, "candidate_id int, " + ", ".join(f"{n} double" for n in names))


def with_grid(scores: DataFrame, grid: DataFrame) -> DataFrame:
    """Every row once per candidate; the grid is a parameter list written by the caller."""
    return scores.crossJoin(F.broadcast(grid))


def grid_search(summary: DataFrame, order_by: list[str], out: str = "place") -> DataFrame:
    """Rank candidates by a declared order; a leading minus means descending."""
    order = [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in order_by]
    return summary.withColumn(out, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def pivot_windows(summary: DataFrame, key: str, windows: list[str], values: list[str]) -> DataFrame:
    return summary.groupBy(key).agg(*[
        F.max(F.when(F.col("window") == w, F.col(v))).alias(f"{w}_{v}") for w in windows for v in values])


def qualify(candidates: DataFrame, rules: dict[str, str], out: str = "qualifying") -> DataFrame:
    """Named boolean rules (SQL text over the candidate columns) and their conjunction."""
    d = candidates.withColumns({n: truth(F.expr(e)) for n, e in rules.items()})
    allof = F.lit(True)
    for n in rules:
        allof = allof & F.col(n)
    return d.withColumn(out, allof)


gate = qualify


def best_weight(df: DataFrame, a: str, b: str, y: str, weights, keys=BY) -> DataFrame:
    """Blend weight of ``a`` with the lowest Brier score; ties go to the larger weight."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(y).isNotNull())
    cand = [F.struct(F.lit(float(w)).alias("weight"), F.col(f"_b{i}").alias("brier")) for i, w in enumerate(weights)]
    p = lambda w: w * F.col(a) + (1.0 - w) * F.col(b) - F.col(y)
    agg = d.groupBy(*keys).agg(*[F.avg(p(float(w)) * p(float(w))).alias(f"_b{i}") for i, w in enumerate(weights)])
    return agg.select(*keys, F.explode(F.array(*cand)).alias("x")).groupBy(*keys).agg(
        F.min_by(F.col("x.weight"), F.struct(F.col("x.brier"), -F.col("x.weight"))).alias("weight"), F.min("x.brier").alias("brier"))


def best_variant(summary: DataFrame, stable: str, order_by: list[str]) -> DataFrame:
    return grid_search(summary.where(truth(F.expr(stable))), order_by).where("place = 1")


def family_configs(families: dict[str, list[str]], mode: str) -> dict[str, list[str]]:
    """Feature lists to compare: each family alone, each left out, or everything."""
    every = [c for cols in families.values() for c in cols]
    if mode == "only":
        return {f"only_{f}": list(cols) for f, cols in families.items()}
    if mode == "drop":
        return {f"drop_{f}": [c for c in every if c not in cols] for f, cols in families.items()}
    if mode == "full":
        return {"full": every}
    raise ValueError(f"unknown ablation mode {mode}")
