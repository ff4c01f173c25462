"""What the operators of this package share: shared folders, staged tables and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: space and the ASCII controls tab to carriage return.
SPACE_RE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees, as the cluster names it in spark.checkpoint.dir.

    Where that is unset, as in tests, one temporary folder per local application; a cluster without one is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        base = _OWN[context.applicationId]
    return base.rstrip("/") + "/walksieve-llm"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: later plans start from files that outlive any executor."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._staged_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again: every reader has been staged itself."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key, parts: int):
    """crc32 of the key as text, modulo `parts`; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(parts)).cast("int")


def slices(batches, max_bytes: int, max_rows: int, column: str):
    """Cut Arrow batches into runs of rows whose `column` holds about max_bytes; a longer value stands alone."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        start = size = 0
        lens = pa.compute.binary_length(col).fill_null(0).to_pylist()
        for i, n in enumerate(lens):
            if i > start and (size + n > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < len(lens):
            yield batch.slice(start)
