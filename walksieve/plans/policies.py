"""Search of a policy's parameters, choice on stability rules, and the chosen policy's evaluation, for any selector whose numbers may be columns."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import BY
from ..operators import metrics as I
from ..operators import resample as J
from ..operators import search as K
from ..operators import targets as T
from .adaptive import choose

#: policy(rows with its parameters as columns, keys) -> calls with position, series_id, y_true and direction
Policy = Callable[[DataFrame, tuple], DataFrame]
MEASURES = ("calls", "hits", "accuracy", "down_calls", "down_precision")


def search(scores: DataFrame, grid: DataFrame, policy: Policy, baseline: DataFrame, windows: dict[str, tuple[int, int]], *, rules: dict[str, str], order: list[str], by=BY) -> DataFrame:
    """One row per panel and candidate: parameters, measures and hit difference to the baseline per window, each rule, development_qualifying and place.

    rules are conditions over the columns <window>_<measure> and <window>_hit_delta; order lists columns, a leading minus for falling.
    """
    by = list(by)
    keys = [*by, "candidate_id"]
    mine = I.summarize(T.in_windows(policy(K.with_grid(scores, grid), tuple(keys)), windows), [*keys, "window"])
    ref = I.summarize(T.in_windows(baseline, windows), [*by, "window"]).select(*by, "window", F.col("hits").alias("_base"))
    j = mine.join(ref, [*by, "window"], "left").withColumn("hit_delta", F.col("hits") - F.coalesce("_base", F.lit(0)))
    wide = j.groupBy(*keys).agg(*[F.max(F.when(F.col("window") == w, F.col(c))).alias(f"{w}_{c}") for w in windows for c in (*MEASURES, "hit_delta")])
    judged = K.qualify(wide, rules, "development_qualifying")
    by_order = [F.col("development_qualifying").desc()] + [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in (*order, "candidate_id")]
    placed = judged.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*by_order)))  # as many rows as candidates
    return placed.join(F.broadcast(grid), "candidate_id")


def apply_chosen(scores: DataFrame, searched: DataFrame, grid: DataFrame, policy: Policy, fallback: dict[str, float], by=BY) -> DataFrame:
    """Calls of the first qualifying candidate, else of the one with the fallback parameters, with candidate_id and selection_mode."""
    by = list(by)
    picked = choose(searched, fallback, by=by).select(*by, "candidate_id", "selection_mode", *[c for c in grid.columns if c != "candidate_id"])
    rows = scores.join(F.broadcast(picked), by)  # one row per panel
    return policy(rows, tuple(by)).drop("selection_mode", "candidate_id").join(F.broadcast(picked.select(*by, "candidate_id", "selection_mode")), by)


def evaluate(calls: DataFrame, baseline: DataFrame, windows: dict[str, tuple[int, int]], *, block: int = 6, reps: int = 500, seed: int = 1, by=BY) -> DataFrame:
    """Per window: the calls' measures, the baseline's hits, and the paired circular bootstrap of the monthly hit difference."""
    by = list(by)
    of = [*by, "window"]
    s = I.summarize(T.in_windows(calls, windows), of).select(*of, "months", *MEASURES)
    b = I.summarize(T.in_windows(baseline, windows), of).select(*of, F.col("hits").alias("baseline_hits"), F.col("calls").alias("baseline_calls"))
    pairs = T.in_windows(J.paired_months(calls, baseline, by=by), windows)
    boot = J.block_bootstrap(pairs, F.avg("hit_delta"), block=block, reps=reps, seed=seed, by=of).select(*of, F.col("observed").alias("mean_hit_delta"), "p10", "p50", "p90")
    return s.join(b, of, "left").join(boot, of, "left")
