"""The regime-adaptive study: grid, qualification, choice or fallback, and the chosen policy's calls, without a decision on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import BY, truth
from ..operators import metrics as I
from ..operators import search as K
from ..operators import select as H
from ..operators import targets as T

PARAMETERS = ("down_threshold", "down_margin", "stress_trigger", "max_down_share", "regime_bonus", "shock_bonus", "replacement_margin", "max_replacements")
#: Order of candidates: qualification first, then the worst internal window, then tuning.
ORDER = ["-development_qualifying", "-stable_qualifying", "-qualifying", "-worst_internal_hit_delta", "-tuning_accuracy", "-tuning_down_precision", "-tuning_down_calls", "candidate_id"]


def _policy(rows: DataFrame, cap, hi: int, replacement_hi: int, by, allow=True, **fixed) -> DataFrame:
    named = {c: F.col(c) for c in PARAMETERS if c in rows.columns}
    return H.regime_adaptive(rows, cap=cap, hi=hi, replacement_hi=replacement_hi, allow_down=allow, by=by, **{**fixed, **named})


def search(scores: DataFrame, grid: DataFrame, windows: dict[str, tuple[int, int]], internal: list[str], *, cap, hi: int, replacement_hi: int, min_down_calls: int,
           min_down_precision: float, min_internal_calls: int, min_internal_precision: float, by=BY, **fixed) -> DataFrame:
    """One row per panel and candidate: parameters, summaries per window, qualification and place.

    qualifying: enough precise Down calls in tuning. stable_qualifying: that, and in every internal window enough precise
    Down calls and no fewer hits than the Up-only base. development_qualifying: that, and no fewer hits in validation.
    """
    keys = [*by, "candidate_id"]
    calls = _policy(K.with_grid(scores, grid), cap, hi, replacement_hi, keys, **fixed)
    base = H.dynamic_cap(scores.where("ready"), cap, hi, by=by)
    mine = I.summarize(T.in_windows(calls, windows), [*keys, "window"])
    ref = I.summarize(T.in_windows(base, windows), [*by, "window"]).select(*by, "window", F.col("hits").alias("base_hits"))
    j = mine.join(ref, [*by, "window"], "left").withColumn("hit_delta", F.col("hits") - F.coalesce("base_hits", F.lit(0)))
    wide = j.groupBy(*keys).agg(*[F.max(F.when(F.col("window") == w, F.col(c))).alias(f"{w}_{c}") for w in windows
                                  for c in ("hits", "accuracy", "hit_delta", "down_calls", "down_precision")])
    c = F.col
    enough = truth((c("tuning_down_calls") >= min_down_calls) & (c("tuning_down_precision") >= min_down_precision))
    inside = [truth((c(f"{w}_down_calls") >= min_internal_calls) & (c(f"{w}_down_precision") >= min_internal_precision) & (c(f"{w}_hit_delta") >= 0)) for w in internal]
    wide = wide.withColumn("qualifying", enough).withColumn("stable_qualifying", reduce(lambda a, b: a & b, inside, c("qualifying")))
    wide = wide.withColumns({"development_qualifying": c("stable_qualifying") & truth(c("validation_hit_delta") >= 0),
                             "worst_internal_hit_delta": F.least(*[c(f"{w}_hit_delta") for w in internal]) if len(internal) > 1 else c(f"{internal[0]}_hit_delta")})
    order = [F.col(x[1:]).desc_nulls_last() if x.startswith("-") else F.col(x).asc_nulls_last() for x in ORDER]
    from pyspark.sql import Window

    placed = wide.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))  # as many rows as candidates
    return placed.join(F.broadcast(grid), "candidate_id")


def choose(searched: DataFrame, fallback: dict[str, float], *, allow_down: bool = True, by=BY) -> DataFrame:
    """One row per panel: the first candidate that qualifies in development, else the one with the fallback parameters; with its mode.

    A grid without the fallback parameters gives an error where the fallback is needed.
    """
    fits = reduce(lambda a, b: a & b, [F.col(k) == float(v) for k, v in fallback.items()], F.lit(True))
    pick = searched.groupBy(*by).agg(
        F.min_by("candidate_id", F.when(F.col("development_qualifying"), F.col("place"))).alias("_first"),
        F.max("development_qualifying").alias("_any"),
        F.min_by("candidate_id", F.when(fits, F.col("place"))).alias("_back"), F.max(fits).alias("_has"))
    back = F.when(F.col("_has"), F.col("_back")).otherwise(F.raise_error(F.lit("the fallback parameters are not in the grid")))
    mode = F.when(F.col("_any"), "stable_candidate").otherwise("bidirectional_fallback" if allow_down else "conservative_fallback")
    pick = pick.select(*by, F.when(F.col("_any"), F.col("_first")).otherwise(back).alias("candidate_id"), mode.alias("selection_mode"),
                       (F.col("_any") | F.lit(allow_down)).alias("allow_down"))
    return searched.join(pick, [*by, "candidate_id"])


def apply_chosen(scores: DataFrame, chosen: DataFrame, *, cap, hi: int, replacement_hi: int, by=BY, **fixed) -> DataFrame:
    """Calls of the chosen policy of each panel."""
    cols = [c for c in PARAMETERS if c in chosen.columns]
    rows = scores.join(F.broadcast(chosen.select(*by, "candidate_id", "selection_mode", "allow_down", *cols)), list(by))  # one row per panel
    calls = _policy(rows, cap, hi, replacement_hi, by, allow=F.col("allow_down"), **fixed)
    return calls.join(F.broadcast(chosen.select(*by, "candidate_id", "selection_mode")), list(by))
