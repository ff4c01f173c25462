"""Quality rules: robust multivariate outliers by minimum covariance determinants, in Spark columns alone.

Every text gives a vector of transformed statistics in fixed point, so sums are exact and alike
whatever the order of rows. Each group (language and source) gets the mean and covariance of the
share `alpha` of its rows whose covariance determinant is least. Many elemental starts, of six vectors each, take
two concentration steps (distances from the current estimate, then the nearest rows anew) on a pool of about
`pool` rows per group; those with the least determinants go on with all rows, and the one that ends with the least
wins. So one clean start among many is enough, however the rest is mixed, up to the share 1 - alpha of outliers.
The pool only judges starts: a vector that w of n rows have enters it floor(w pool / n + u) times, u from its hash.
Rows beyond a cut-off of the squared Mahalanobis distance are outliers. Groups too small for an estimate use their
language's, or else that of all rows.

A step is one aggregation of rows per group, start and distance step (1/32 octave): sums up to
the step that holds the share are the next estimate. Groups are added up map-side first, so a
source that has a third of all rows costs no task more than others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged
from .textstats import base_counts

UNIT = 1024
#: Statistic, and the least standard deviation that its estimate may have. Beside texts without any repetition, one of 50 words
#: with one repeated triple (6 words, x4 = 0.35) and one line that stands twice (2 lines, x3 = 0.2) is just within the cut.
STATISTICS = {
    "x1": (lambda: F.log(F.col("word_chars") / F.col("n_words")), 0.09),
    "x2": (lambda: F.sqrt(F.col("n_symbols") / F.col("n_words")), 0.10),
    "x3": (lambda: F.sqrt(F.col("n_dup_lines") / F.col("n_words")), 0.06),
    "x4": (lambda: F.sqrt(F.col("n_repeat_words") / F.col("n_words")), 0.10),
}
_X = list(STATISTICS)
_PAIRS = [(a, b) for i, a in enumerate(_X) for b in _X[:i + 1]]
#: Fixed values of the chi-square distribution with four degrees of freedom: median and 0.9999 quantile.
CHI2_MEDIAN, CHI2_CUT = 3.35669, 23.5127


def _key(level: int) -> Column:
    """Group of a level: 1 language and source, 2 language, 3 all rows. Nulls are a group of their own."""
    def part(c):
        return F.concat(F.coalesce(F.char_length(c), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(F.col(c), F.lit("")))
    return F.concat(F.lit(f"{level}/"), *[part(c) for c in ("lang", "source")[:3 - level]])


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _sums() -> list[Column]:
    """Sums over vectors that stand for w rows each."""
    w = F.col("w")
    return ([F.sum("w").alias("n")] + [F.sum(_wide(w * F.col(a))).alias(f"s_{a}") for a in _X]
            + [F.sum(_wide(w * F.col(a) * F.col(b))).alias(f"s_{a}{b}") for a, b in _PAIRS])


_NAMES = ["n", *(f"s_{a}" for a in _X), *(f"s_{a}{b}" for a, b in _PAIRS)]


def _factored(sums: DataFrame) -> DataFrame:
    """Mean m_*, unit lower triangle l_*, diagonal d_* of the covariance, and log_det, from sums."""
    n = F.col("n")
    cols: dict[str, Column] = {f"m_{a}": F.col(f"s_{a}").cast("double") / n for a in _X}
    for a, b in _PAIRS:
        centred = (F.col(f"s_{a}{b}") * _wide(n) - F.col(f"s_{a}") * F.col(f"s_{b}")).cast("double") / n / n
        cols[f"c_{a}{b}"] = centred + ((STATISTICS[a][1] * UNIT) ** 2 if a == b else 0.0)
    df = sums.withColumns(cols)
    for i, a in enumerate(_X):
        for j, b in enumerate(_X[:i]):
            rest = F.col(f"c_{a}{b}")
            for k in _X[:j]:
                rest = rest - F.col(f"l_{a}{k}") * F.col(f"l_{b}{k}") * F.col(f"d_{k}")
            df = df.withColumn(f"l_{a}{b}", rest / F.col(f"d_{b}"))
        rest = F.col(f"c_{a}{a}")
        for k in _X[:i]:
            rest = rest - F.col(f"l_{a}{k}") * F.col(f"l_{a}{k}") * F.col(f"d_{k}")
        # the floors keep it positive; rounding must not
        df = df.withColumn(f"d_{a}", F.greatest(rest, F.lit(1e-6)))
    log_det = F.lit(0.0)
    for a in _X:
        log_det = log_det + F.log(f"d_{a}")
    return df.withColumn("log_det", log_det)


_PARAMETERS = [*(f"m_{a}" for a in _X), *(f"l_{a}{b}" for a, b in _PAIRS if a != b), *(f"d_{a}" for a in _X)]


def _with_distance(df: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance from the parameters beside each row, by forward substitution."""
    total = F.lit(0.0)
    for i, a in enumerate(_X):
        z = F.col(a) - F.col(f"m_{a}")
        for b in _X[:i]:
            z = z - F.col(f"l_{a}{b}") * F.col(f"z_{b}")
        df = df.withColumn(f"z_{a}", z)
        total = total + F.col(f"z_{a}") * F.col(f"z_{a}") / F.col(f"d_{a}")
    return df.withColumn("distance", total).drop(*(f"z_{a}" for a in _X))


def _step(c: Column) -> Column:
    return F.floor(32 * F.log2(c + 1e-9)).cast("int")


def _beside(rows: DataFrame, small: DataFrame, keys: list[str], broadcast_rows: int, how: str = "inner") -> DataFrame:
    """Join with a table of groups: sent to every task while it has few rows, else by shuffle with adaptive splits."""
    return rows.join(F.broadcast(small) if small.count() <= broadcast_rows else small, keys, how)


def _concentrated(vectors: DataFrame, state: DataFrame, alpha: float, broadcast_rows: int) -> DataFrame:
    """One step: the estimates from the nearest share alpha of each group's rows, by the estimates in `state`."""
    by = W.partitionBy("key", "start").orderBy("step")
    near = _with_distance(_beside(vectors, state.drop("log_det"), ["key"], broadcast_rows))
    binned = near.withColumn("step", _step(F.col("distance"))).groupBy("key", "start", "size", "step").agg(*_sums())
    before = F.coalesce(F.sum("n").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = binned.withColumn("before", before).where(F.col("before") < F.ceil(F.col("size") * alpha))
    added = inside.groupBy("key", "start").agg(*[F.sum(c).cast("long" if c == "n" else "decimal(38,0)").alias(c) for c in _NAMES])
    return staged(_factored(added).select("key", "start", *_PARAMETERS, "log_det"), "state")


def elemental_starts(vectors: DataFrame, *, alpha: float, pool: int, starts: int, steps: int, few: int, size: int = 6, broadcast_rows: int = 10_000) -> DataFrame:
    """The `few` best of many elemental starts of each group, after `steps` steps on its pool."""
    uniform = lambda *c: (F.pmod(F.xxhash64(*c), F.lit(1 << 30)) + 0.5) / (1 << 30)
    share = F.least(F.lit(1.0), pool / F.col("size"))
    times = F.floor(F.col("w") * share + F.when(share < 1, uniform("key", *_X)).otherwise(0.0)).cast("long")
    drawn = vectors.withColumn("w", times).where("w > 0")
    drawn = drawn.join(drawn.groupBy("key").agg(F.sum("w").alias("pooled")), "key").withColumn("size", F.col("pooled")).drop("pooled")
    drawn = staged(drawn, "pool")
    # a race that vectors win in proportion to their rows; a group's pool is bounded
    raced = drawn.withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(starts)))).withColumn("race", -F.log(uniform(*_X, "start")) / F.col("w"))
    first = raced.withColumn("place", F.row_number().over(W.partitionBy("key", "start").orderBy("race", *_X))).where(F.col("place") <= size)
    state = staged(_factored(first.withColumn("w", F.lit(1)).groupBy("key", "start").agg(*_sums())).select("key", "start", *_PARAMETERS, "log_det"), "state")
    for _ in range(steps):
        state = _concentrated(drawn, state, alpha, broadcast_rows)
    best = state.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy("log_det", "start"))).where(F.col("place") <= few)
    return staged(best.drop("place"), "starts")


def estimates(rows: DataFrame, *, alpha: float, min_rows: int, starts: int, steps: int, broadcast_rows: int, pool: int = 1000, few: int = 4) -> DataFrame:
    """key and parameters of each group with at least min_rows rows; `scale` lifts distances' median to what chi-square has."""
    alike = rows.groupBy("lang", "source", *_X).agg(F.count(F.lit(1)).alias("w"))
    keyed = alike.select(F.explode(F.array(_key(1), _key(2), _key(3))).alias("key"), *_X, "w").groupBy("key", *_X).agg(F.sum("w").alias("w"))
    keyed = staged(keyed, "vectors")
    sizes = staged(keyed.groupBy("key").agg(F.sum("w").alias("size")).where(F.col("size") >= min_rows), "groups")
    keyed = _beside(keyed, sizes, ["key"], broadcast_rows)
    # start 0 has all rows
    state = _factored(keyed.withColumn("start", F.lit(0)).groupBy("key", "start").agg(*_sums())).select("key", "start", *_PARAMETERS, "log_det")
    if starts > 1:
        state = state.unionByName(elemental_starts(keyed, alpha=alpha, pool=pool, starts=starts - 1, steps=2, few=few, broadcast_rows=broadcast_rows))
    state = staged(state, "state")
    for _ in range(steps):
        state = _concentrated(keyed, state, alpha, broadcast_rows)
    best = state.groupBy("key").agg(F.min_by(F.struct("start", *_PARAMETERS), F.struct("log_det", "start")).alias("b")).select("key", "b.*")
    best = staged(best, "best")
    final = _with_distance(_beside(keyed, best, ["key"], broadcast_rows)).groupBy("key", "size", _step(F.col("distance")).alias("step")).agg(F.sum("w").alias("n"))
    upto = F.sum("n").over(W.partitionBy("key").orderBy("step"))
    median = final.withColumn("upto", upto).where(F.col("upto") * 2 >= F.col("size")).groupBy("key").agg(F.min("step").alias("step"))
    scale = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.col("step") + 1) / 32) / CHI2_MEDIAN)
    return staged(best.join(median, "key").select("key", *_PARAMETERS, scale.alias("scale")), "estimates")


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Base counts, base_failed and the fixed-point vector of each row (null where there is no word)."""
    df = base_counts(df, text)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    df = df.withColumn("base_failed", failed)
    return df.withColumns({k: F.when(F.col("n_words") > 0, F.round(f() * UNIT).cast("long")) for k, (f, _) in STATISTICS.items()})


def judge(df: DataFrame, *, text: str = "text", keep=("doc_id",), alpha: float = 0.75, min_rows: int = 200, starts: int = 48, steps: int = 5,
          cut: float = CHI2_CUT, broadcast_rows: int = 10_000) -> DataFrame:
    """One row per row of `df`: the `keep` columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    distance (squared, scaled; null without an estimate) and kept.

    Rows that fail the base rules are not kept and take no part in the estimates. Null and empty texts fail. Null
    languages and sources are groups of their own. With fewer than min_rows rows in all there is no estimate, and
    rows that pass the base rules are kept. Ties and repeated rows count each time. A step takes rows by distance steps of
    1/32 octave and takes the last one whole, so rows that tie at the edge may lift a subset above its share.
    """
    rows = df.select(*keep, F.col("lang"), F.col("source"), F.col(text).alias("_text"))
    made = statistics(rows, "_text")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    held = [c for c in dict.fromkeys([*keep, "lang", "source"])]
    made = staged(made.select(*held, *counts, "base_failed", *_X), "statistics")
    found = estimates(made.where("not base_failed"), alpha=alpha, min_rows=min_rows, starts=starts, steps=steps, broadcast_rows=broadcast_rows)
    # every (language, source) gets the finest estimate there is
    groups = made.select("lang", "source").distinct()
    for level in (1, 2):
        groups = groups.withColumn("key", _key(level)).join(found.select("key", F.struct(*_PARAMETERS, "scale").alias(f"e{level}")), "key", "left").drop("key")
    rest = found.where(F.col("key") == _key(3)).first()  # one row of parameters
    whole = F.struct(*[F.lit(None if rest is None else rest[c]).cast("double").alias(c) for c in (*_PARAMETERS, "scale")])
    params = groups.select(_key(1).alias("group"), F.coalesce("e1", "e2", whole).alias("e")).select("group", "e.*")
    params = staged(params, "parameters")
    out = _with_distance(_beside(made.withColumn("group", _key(1)), params, ["group"], broadcast_rows, "left"))
    distance = F.col("distance") / F.col("scale")
    kept = ~F.col("base_failed") & F.coalesce(distance <= cut, F.lit(True))
    return out.select(*keep, *counts, "base_failed", F.round(distance, 6).alias("distance"), kept.alias("kept"))
