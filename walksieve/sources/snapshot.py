"""Sinks: immutable snapshots, a manifest that is verified on load, keyed ledgers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def total_hash(h):
    """Sum of hashes modulo 2^61 - 1. The sum has 38 digits, so it holds for any number of rows."""
    return (F.sum(h.cast("decimal(38,0)")) % F.lit(2**61 - 1).cast("decimal(38,0)")).cast("bigint")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: row count, schema and an order-insensitive content hash.

    Hashes add up as decimals in every task, so nothing but one row is shuffled and no row count overflows.
    """
    cols = sorted(df.columns)
    h = F.xxhash64(*[F.col(c) for c in cols])
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(total_hash(h), F.lit(0)).cast("bigint").alias("content_hash"),
        F.coalesce(F.expr(f"bit_xor(xxhash64({','.join('`' + c + '`' for c in cols)}))"), F.lit(0)).alias("content_xor"),
    ).select(
        F.lit(",".join(f"{c}:{dict(df.dtypes)[c]}" for c in cols)).alias("schema"),
        "rows", "content_hash", "content_xor",
    )


def snapshot_manifest(df: DataFrame, params: dict) -> DataFrame:
    text = ",".join(f"{k}={params[k]}" for k in sorted(params))
    return fingerprint(df).select(
        F.sha2(F.concat_ws("|", F.lit(text), "schema", F.col("content_hash").cast("string")), 256).alias("snapshot_id"),
        F.lit(text).alias("params"), "schema", "rows", "content_hash", "content_xor",
    )


def write_snapshot(df: DataFrame, root: str, params: dict, *, fmt: str = "parquet",
                   partition_by: list[str] | None = None) -> str:
    """Write data and manifest below ``root/<key>``; an existing key is replaced as a whole."""
    key = params_key(df.sparkSession, params)
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(f"{root}/{key}/data")
    saved = _load(df.sparkSession, f"{root}/{key}/data", fmt, df.schema)
    snapshot_manifest(saved, params).coalesce(1).write.mode("overwrite").json(f"{root}/{key}/manifest")
    return key


def params_key(spark: SparkSession, params: dict) -> str:
    import hashlib

    text = ",".join(f"{k}={params[k]}" for k in sorted(params))
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def _load(spark, path, fmt, schema=None):
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", True).schema(schema)
    return r.load(path)


def read_snapshot(spark: SparkSession, root: str, params: dict, *, fmt: str = "parquet", schema=None) -> DataFrame:
    """Load a snapshot and refuse it if rows or contents changed since it was written."""
    key = params_key(spark, params)
    df = _load(spark, f"{root}/{key}/data", fmt, schema)
    want = spark.read.json(f"{root}/{key}/manifest").first()
    got = fingerprint(df).first()
    if (got["rows"], got["content_hash"], got["content_xor"]) != (want["rows"], want["content_hash"], want["content_xor"]):
        raise ValueError(f"snapshot {key} does not match its manifest")
    return df


def load_or_build(spark, root, params, build, **kw) -> DataFrame:
    """Reuse a verified snapshot, or build and publish it where there is none. One that was changed is an error."""
    try:
        return read_snapshot(spark, root, params, **kw)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    write_snapshot(build(), root, params, **{k: v for k, v in kw.items() if k == "fmt"})
    return read_snapshot(spark, root, params, **kw)


def upsert(ledger: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Replace or add rows by key and leave all other rows as they are."""
    unknown = [c for c in rows.columns if c not in ledger.columns]
    if unknown:
        raise ValueError(f"unknown ledger fields: {unknown}")
    # one row per key wins: rows carry 1, the ledger 0
    both = ledger.withColumn("_new", F.lit(0)).unionByName(
        rows.withColumn("_new", F.lit(1)), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy(F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")


def profile(panel: DataFrame, by=("panel_id",)) -> DataFrame:
    """Per series: observations, leading and inner gaps, unchanged moves, first and last month."""
    from ..functions.columns import series_window

    w = series_window(by=by)
    p = panel.withColumn("_next", F.lead("value").over(w))
    seen = F.col("value").isNotNull()
    agg = p.groupBy(*by, "series_id").agg(
        F.count("value").alias("observations"),
        F.min(F.when(seen, F.col("position"))).alias("_first"),
        F.max(F.when(seen, F.col("position"))).alias("_last"),
        F.min("position").alias("_lo"),
        F.sum(F.when(F.col("_next") == F.col("value"), 1).otherwise(0)).alias("zero_changes"),
        F.sum(F.when(seen & F.col("_next").isNotNull(), 1).otherwise(0)).alias("target_rows"),
        F.min(F.when(seen, F.col("month"))).alias("first_month"),
        F.max(F.when(seen, F.col("month"))).alias("last_month"),
    )
    return agg.select(
        *by, "series_id", "observations",
        (F.col("_first") - F.col("_lo")).alias("leading_missing"),
        (F.col("_last") - F.col("_first") + 1 - F.col("observations")).alias("internal_missing"),
        "zero_changes", "target_rows", "first_month", "last_month",
    )


def nest_forecast(calls: DataFrame, keys=("panel_id", "horizon", "month")) -> DataFrame:
    """One document per forecast month holding its ranked selections (bounded by the cap)."""
    item = F.struct("rank", "series_id", "direction", "score")
    return calls.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("selections"))


def stamp_active(scores: DataFrame, meta: dict[str, str]) -> DataFrame:
    return scores.withColumns({f"active_{k}": F.lit(v) for k, v in meta.items()})
