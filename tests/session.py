import os
import tempfile

from pyspark.sql import SparkSession


def make_session(cores: str = "8"):
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("walksieve")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", scratch)
        .config("spark.sql.warehouse.dir", scratch + "/wh")
        .config("spark.checkpoint.dir", scratch + "/ck")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
