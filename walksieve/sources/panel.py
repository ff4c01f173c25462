"""Panels: long tables of (panel_id, series_id, position, month, value).

``position`` is 1-based and dense per panel, so a row frame is a time frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Panel rows of one task at most, about; windows over series sort so many rows at a time.
TASK_ROWS = 500_000

PANEL_COLUMNS = ["panel_id", "series_id", "position", "month", "value"]


def _period(c, unit: str):
    t = F.date_trunc(unit, c)
    return t.cast("date") if unit == "month" else t


def _index(period, start, unit: str):
    """1-based number of ``period`` counted from ``start``."""
    if unit == "month":
        months = (F.year(period) - F.year(start)) * 12 + F.month(period) - F.month(start)
        return (months + 1).cast("int")
    step = {"day": 86400, "hour": 3600}[unit]
    return ((F.unix_timestamp(period) - F.unix_timestamp(start)) / step + 1).cast("int")


def _period_at(position, start, unit: str):
    if unit == "month":
        return F.add_months(start, position - 1)
    step = {"day": 86400, "hour": 3600}[unit]
    return F.timestamp_seconds(F.unix_timestamp(start) + (position - 1) * step)


def panel_from_facts(
    facts: DataFrame,
    *,
    time: str,
    series: str,
    value,
    unit: str = "month",
    panel_id: str = "main",
    calendar: DataFrame | None = None,
    max_position: int | None = None,
) -> DataFrame:
    """Sum a fact table to one cell per series and period, then fill the calendar.

    ``calendar`` (any table with the ``time`` column) fixes first and last period;
    it defaults to the facts.  Filling needs one shuffle by series: every observed
    cell emits itself and the empty periods up to the next one, so no
    series-by-calendar product is joined.
    """
    amount = F.col(value) if isinstance(value, str) else value
    cells = (
        facts.where(F.col(time).isNotNull() & F.col(series).isNotNull())
        .groupBy(F.col(series).cast("string").alias("series_id"), _period(F.col(time), unit).alias("_p"))
        .agg(F.sum(amount).cast("double").alias("value"))
    )
    span = (calendar if calendar is not None else facts).agg(
        _period(F.min(time), unit).alias("_lo"), _period(F.max(time), unit).alias("_hi")
    )
    return fill_calendar(cells, span, unit=unit, panel_id=panel_id, max_position=max_position, tasks=_tasks(facts, series, time, unit, max_position))


def _tasks(facts: DataFrame, series: str, time: str, unit: str, max_position: int | None) -> int | None:
    """Number of tasks over which a panel of about TASK_ROWS rows each is dealt; none for one that is smaller.

    The number follows the rows of the filled panel. Bytes of the cells before it, which adaptive execution sees, tell
    little of them: a sparse series has many more periods than cells.
    """
    found = facts.agg(F.approx_count_distinct(series).alias("n"), _index(_period(F.max(time), unit), _period(F.min(time), unit), unit).alias("periods")).first()
    rows = found["n"] * min(found["periods"] or 0, max_position or 1 << 31)
    return max(-(-rows // TASK_ROWS), facts.sparkSession.sparkContext.defaultParallelism) if rows > TASK_ROWS else None


def fill_calendar(cells, span, *, unit="month", panel_id="main", max_position=None, tasks: int | None = None) -> DataFrame:
    """Make ``(series_id, _p, value)`` cells dense over the one-row ``span``; with ``tasks``, dealt over so many by series."""
    if tasks:
        cells = cells.repartition(tasks, "series_id")
    last = _index(F.col("_hi"), F.col("_lo"), unit)
    if max_position is not None:
        last = F.least(last, F.lit(int(max_position)))
    # `span` is an ungrouped aggregate: exactly one row
    placed = cells.crossJoin(F.broadcast(span)).select(
        "series_id", "value", "_lo",
        _index(F.col("_p"), F.col("_lo"), unit).alias("_pos"),
        last.alias("_n"),
    ).where((F.col("_pos") >= 1) & (F.col("_pos") <= F.col("_n")))
    w = Window.partitionBy("series_id").orderBy("_pos")
    first = F.when(F.lag("_pos").over(w).isNull(), F.lit(1)).otherwise(F.col("_pos"))
    until = F.coalesce(F.lead("_pos").over(w) - 1, F.col("_n"))
    filled = placed.withColumns({"_from": first, "_to": until}).withColumn(
        "position", F.explode(F.sequence("_from", "_to"))
    )
    return filled.select(
        F.lit(panel_id).alias("panel_id"),
        "series_id",
        "position",
        _period_at(F.col("position"), F.col("_lo"), unit).alias("month"),
        F.when(F.col("position") == F.col("_pos"), F.nanvl("value", F.lit(None).cast("double"))).alias("value"),
    )


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.read.format(fmt).options(**options).load(path)


def read_panel(
    spark: SparkSession,
    path: str,
    *,
    time_col: str,
    series_col: str | None = None,
    value_col: str | None = None,
    fmt: str = "parquet",
    unit: str = "month",
    panel_id: str = "main",
    max_position: int | None = None,
    **options,
) -> DataFrame:
    """Scan a wide table (one column per series) or a long one into a panel.

    ``max_position`` bounds the scan itself: the cut is a literal comparison on
    ``time_col`` so later rows are skipped in the files. A cell that is no number is an error that names its column;
    facts of one series and period add up.
    """
    df = read_table(spark, path, fmt, **options)
    df = df.withColumn(time_col, F.to_timestamp(time_col))
    if series_col is None:
        names = [c for c in df.columns if c != time_col]
        df = to_long(df, time_col, names)
        series_col, value_col = "series_id", "value"
    if max_position is not None:
        start = df.agg(_period(F.min(time_col), unit)).first()[0]  # one scalar
        if start is not None:
            stop = _period_at(F.lit(max_position + 1), F.lit(start), unit)
            df = df.where(F.col(time_col) < stop)
    cell, number = F.col(f"`{value_col}`"), F.expr(f"try_cast(`{value_col}` as double)")
    bad = cell.isNotNull() & number.isNull()
    number = F.when(bad, F.raise_error(F.concat(F.lit(f"column {value_col} holds a cell that is no number: "), cell.cast("string")))).otherwise(number)
    return panel_from_facts(
        df, time=time_col, series=series_col, value=number, unit=unit, panel_id=panel_id,
        max_position=max_position,
    )


def to_long(df: DataFrame, ids, columns: list[str], name="series_id", value="value") -> DataFrame:
    """One row per (id, column)."""
    ids = [ids] if isinstance(ids, str) else list(ids)
    def number(c):
        made = F.expr(f"try_cast(`{c}` as double)")
        bad = F.col(f"`{c}`").isNotNull() & made.isNull()
        return F.when(bad, F.raise_error(F.concat(F.lit(f"column {c} holds a cell that is no number: "), F.col(f"`{c}`").cast("string")))).otherwise(made).alias(c)

    wide = df.select(*ids, *[number(c) for c in columns])
    return wide.unpivot(ids, columns, name, value)


def to_wide(df: DataFrame, by: str, values: list[str], *, key: str = "group_id", keys=("panel_id", "position")):
    """Pivot group means; ``values`` is the known list of group names."""
    return df.groupBy(*keys).pivot(key, values).agg(F.avg(by))


def read_scores(spark, path, cols: list[str], max_position: int | None = None, fmt="parquet"):
    """Projected and bounded read; both reach the scan."""
    df = spark.read.format(fmt).load(path).select(*cols)
    return df if max_position is None else df.where(F.col("position") <= max_position)
