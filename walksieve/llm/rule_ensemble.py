"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

A small forest is grown on a bounded sample of labelled rows; every path from a root to a node is
a conjunction of comparisons. A lasso logistic regression weighs these rules, most of which get
weight 0, and the rest is compiled into one Spark column, so scoring any number of rows runs no Python.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .textstats import base_counts, occurrences

Rule = tuple[tuple[str, str, float], ...]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _per(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


#: Statistics that rules compare, all from the text alone.
FEATURES = {
    "log_words": lambda: F.log1p("n_words"),
    "mean_word": lambda: _per("word_chars", "n_words"),
    "symbol_rate": lambda: _per("n_symbols", "n_words"),
    "dup_line_share": lambda: _per("n_dup_lines", "n_lines"),
    "repeat_share": lambda: _per("n_repeat_words", "n_words"),
    "distinct_share": lambda: _per("n_distinct", "n_words"),
    "upper_share": lambda: _per("n_upper", "word_chars"),
    "digit_share": lambda: _per("n_digits", "word_chars"),
    "stop_rate": lambda: _per("n_stops", "n_words"),
    "shout_rate": lambda: _per("n_shouts", "n_words"),
    "line_words": lambda: _per("n_words", "n_lines"),
}


def statistics(df: DataFrame, *, text: str = "text") -> DataFrame:
    """`df` without the text and with one column per feature; null and empty texts have 0 everywhere."""
    kept = [c for c in df.columns if c != text]
    made = base_counts(df.select(*[F.col(c).alias(f"_in_{i}") for i, c in enumerate(kept)], F.col(text).alias("_text")), "_text")
    made = made.withColumns({
        "n_lines": F.size("lines"), "n_distinct": F.size(F.array_distinct("words")), "n_upper": occurrences(F.col("body"), _UPPER),
        "n_digits": occurrences(F.col("body"), "0123456789"), "n_stops": occurrences(F.col("body"), ".,;:"), "n_shouts": occurrences(F.col("body"), "!?")})
    return made.select(*[F.col(f"_in_{i}").alias(c) for i, c in enumerate(kept)], *[f().cast("double").alias(k) for k, f in FEATURES.items()])


@dataclass
class Model:
    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, w in self.rules:
            total = total + F.when(condition(rule), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def condition(rule: Rule) -> Column:
    made = None
    for name, op, value in rule:
        c = F.col(name) <= value if op == "<=" else F.col(name) > value
        made = c if made is None else made & c
    return made


def paths(forest: str, names: list[str]) -> list[Rule]:
    """Rules of a forest's printed trees: one per node below a root, comparisons of a feature merged, in order of first sight."""
    out: dict[Rule, None] = {}
    stack: list[tuple[int, tuple[str, str, float]]] = []
    for line in forest.splitlines():
        if "Tree" in line:
            stack = []
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+0-9.eE]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        stack = [s for s in stack if s[0] < depth] + [(depth, (names[int(m[2])], m[3], float(m[4])))]
        tight: dict[tuple[str, str], float] = {}
        for _, (name, op, value) in stack:
            old = tight.get((name, op), value)
            tight[name, op] = min(old, value) if op == "<=" else max(old, value)
        out[tuple(sorted((n, o, v) for (n, o), v in tight.items()))] = None
    return list(out)


def fit(labelled: DataFrame, *, label: str = "label", order: str = "doc_id", sample_rows: int = 20_000, trees: int = 16, depth: int = 3,
        penalty: float = 0.002, seed: int = 7) -> Model:
    """A model from rows with feature columns and a 0/1 label.

    At most sample_rows rows are used: those with the smallest hashes of `order`. They lie in one sorted partition, so
    the fit repeats. Without labels, or with one class, the model is the smoothed share of label 1.
    """
    names = list(FEATURES)
    sample = labelled.where(F.col(label).isin(0, 1)).orderBy(F.xxhash64(F.col(order).cast("string")), *names, label).limit(sample_rows)
    sample = staged(sample.select(*names, F.col(label).cast("double").alias("label")).coalesce(1), "sample")
    n, ones = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < n:
        p = (ones + 1) / (n + 2)
        return Model(math.log(p / (1 - p)))
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(sample.coalesce(1).sortWithinPartitions(*names, "label"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, seed=seed, featureSubsetStrategy="0.5").fit(rows)
    rules = paths(forest.toDebugString, names)
    if not rules:
        p = (ones + 1) / (n + 2)
        return Model(math.log(p / (1 - p)))
    columns = [condition(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)]
    hits = sample.coalesce(1).sortWithinPartitions(*names, "label").select("label", *columns)
    hits = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(hits)
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=True, maxIter=100).fit(hits)
    weights = lasso.coefficients.toArray()
    return Model(float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-9])


def classify(df: DataFrame, labels: DataFrame, training: Column, *, key: str = "doc_id", text: str = "text", label: str = "quality", keep=(), **options) -> DataFrame:
    """One row per row of `df`: key, the `keep` columns, training (boolean), score (probability of label 1), predicted (score >= 0.5).

    Labels are learned only from rows where `training` (a column over the key) holds. Statistics come from the text
    alone. A key labelled more than once counts with its largest label; repeated rows are scored each time, and null
    keys, which no label can name, are scored too.
    """
    stats = staged(statistics(df.select(*dict.fromkeys([key, *keep, text])), text=text).withColumn("_training", F.coalesce(training, F.lit(False))), "features")
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(key)).agg(F.max(label).alias("label"))
    model = fit(stats.where("_training").join(known, key), order=key, **options)
    scored = stats.withColumn("score", model.score())
    return scored.select(*dict.fromkeys([key, *keep]), F.col("_training").alias("training"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
