"""Connected components of an edge table by contraction, without gathering anything on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def _compressed(hooks: DataFrame) -> DataFrame:
    """x -> y turned into x -> root (staged): follow pointers, doubling the distance each round, until none moves."""
    before = None
    while True:
        t = hooks.select(F.col("x").alias("y"), F.col("y").alias("z"))
        step = staged(hooks.join(t, "y", "left").select("x", F.coalesce("z", "y").alias("y"), F.col("z").isNotNull().alias("moved")), "hooks")
        if before is not None:
            discard(before)
        if step.where("moved").isEmpty():
            return step
        before, hooks = step, step.select("x", "y")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node. Loops and null ends are left out.

    Each round hooks every label to its smallest neighbour, shortens the pointers and contracts the edges; labels
    that are no local minimum vanish, so few rounds are needed. Frequent labels are split by adaptive joins.
    """
    left = staged(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
                  .where(F.col("lo") != F.col("hi")).distinct(), "edges")
    labels = None
    while not left.isEmpty():
        done = _compressed(left.groupBy(F.col("hi").alias("x")).agg(F.min("lo").alias("y")))
        hooks, edges, named = done.select("x", "y"), left, labels
        if labels is None:
            roots = left.select(F.col("lo").alias("x")).distinct().join(hooks, "x", "left_anti").select("x", F.col("x").alias("y"))
            labels = staged(hooks.unionByName(roots), "labels")
        else:
            h = hooks.select(F.col("x").alias("y"), F.col("y").alias("z"))
            labels = staged(labels.join(h, "y", "left").select("x", F.coalesce("z", "y").alias("y")), "labels")
        lo = hooks.select(F.col("x").alias("lo"), F.col("y").alias("lo2"))
        hi = hooks.select(F.col("x").alias("hi"), F.col("y").alias("hi2"))
        moved = left.join(lo, "lo", "left").join(hi, "hi", "left").select(F.coalesce("lo2", "lo").alias("p"), F.coalesce("hi2", "hi").alias("q"))
        left = staged(moved.where("p != q").select(F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi")).distinct(), "edges")
        discard(done, edges, *([] if named is None else [named]))
    if labels is None:
        return left.select(F.col("lo").alias("node"), F.col("hi").alias("component"))
    return labels.select(F.col("x").alias("node"), F.col("y").alias("component"))
