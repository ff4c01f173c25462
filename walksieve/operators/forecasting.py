"""User forecasters on batches of contexts, where a bad row must not cost the good ones."""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType


def halved(run: Callable, rows: list, least: int = 1) -> list[tuple[list, object, int]]:
    """Run a batch; where it fails, its halves, down to single rows: (rows, result or exception, calls made) per part that went through or failed alone."""
    done, todo, calls = [], [rows], 0
    while todo:
        part = todo.pop()
        calls += 1
        try:
            result = run(part)
            if len(result) != len(part):
                raise ValueError(f"{len(result)} forecasts for {len(part)} contexts")
            done.append((part, result, calls))
        except Exception as e:  # noqa: BLE001 - a forecaster may raise anything
            if len(part) <= least:
                done.append((part, e, calls))
            else:
                mid = len(part) // 2
                todo += [part[mid:], part[:mid]]
    return done


def forecast_rows(contexts: DataFrame, forecaster: Callable[[list[list[float]]], list[list[float]]], *, context: str = "context", batch: int = 256,
                  max_context: int | None = None, min_context: int = 1) -> DataFrame:
    """`contexts` with quantiles, context_length, forecast_error and batch_size.

    The forecaster gets at most `batch` contexts at a time (missing values removed, the newest max_context values) and
    gives one list of quantiles each. A batch that fails is halved until the rows that fail stand alone: b bad rows of n
    cost about b log2(n) calls more, the others keep their forecasts. A bad row has null quantiles and the error's text.
    Contexts shorter than min_context are errors without a call.
    """
    schema = StructType([*contexts.schema.fields, StructField("quantiles", ArrayType(DoubleType())), StructField("context_length", IntegerType()),
                         StructField("forecast_error", StringType()), StructField("batch_size", IntegerType())])

    def clean(c):
        x = [] if c is None else [float(v) for v in c if v is not None and pd.notna(v)]
        return x if max_context is None else x[-max_context:]

    def task(frames):
        for pdf in frames:
            xs = [clean(c) for c in pdf[context]]
            quantiles, errors, sizes = [None] * len(xs), [None] * len(xs), [0] * len(xs)
            fit = [i for i, x in enumerate(xs) if len(x) >= min_context]
            for i, x in enumerate(xs):
                if len(x) < min_context:
                    errors[i] = f"context of {len(x)} values, {min_context} needed"
            for at in range(0, len(fit), batch):
                for part, result, _ in halved(lambda rows: forecaster([xs[i] for i in rows]), fit[at:at + batch]):
                    for j, i in enumerate(part):
                        sizes[i] = len(part)
                        if isinstance(result, Exception):
                            errors[i] = f"{type(result).__name__}: {result}"[:500]
                        else:
                            quantiles[i] = None if result[j] is None else [float(v) for v in result[j]]
            yield pdf.assign(quantiles=quantiles, context_length=[len(x) for x in xs], forecast_error=errors, batch_size=sizes)

    return contexts.mapInPandas(task, schema)


def drift(levels: list[float], step: int = 2) -> Callable:
    """Deterministic forecaster: last value plus drift, spread evenly around it by the standard deviation."""
    def run(batch):
        out = []
        for x in batch:
            mean = sum(x) / len(x)
            sd = (sum((v - mean) ** 2 for v in x) / len(x)) ** 0.5
            slope = (x[-1] - x[0]) / (len(x) - 1) if len(x) > 1 else 0.0
            out.append([x[-1] + slope * step + sd * 2.0 * (q - 0.5) for q in levels])
        return out
    return run


def errors_by_origin(forecasts: DataFrame, by=("panel_id",)) -> DataFrame:
    """Per origin: rows, failures and the smallest and largest batch."""
    bad = F.col("forecast_error").isNotNull().cast("int")
    return forecasts.groupBy(*by, "position").agg(F.count(F.lit(1)).alias("rows"), F.sum(bad).alias("failures"), F.min("batch_size").alias("min_batch"), F.max("batch_size").alias("max_batch"))
