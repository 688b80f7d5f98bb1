"""Session settings the library relies on, and the shared work folder."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a table that a task takes at most: a row may stand for thousands of events or chunks.
TASK_ROWS = 20_000
# A scan with tasks of so many rows may take so many times as long as one that keeps all cores busy.
_WORTH, _IDLE = 5_000, 1.5
# JSON objects with a repeated key keep the last value.
_SETTINGS = {
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Batches for Python are bounded by bytes, as one of long texts would be by rows alone.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8388608",
    # Ids named in a filter are looked up in a row group's bounds and dictionary, up to this many.
    "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to ``spark`` and return it."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder stands in, but only in local mode:
    on a cluster a machine-local folder would be lost with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="sparrowline-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for a table below the shared folder; never reused."""
    return f"{checkpoint_root(spark)}/sparrowline/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on whatever file system it names."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(jvm_path))


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table lies at ``path``: what a killed job has left is none."""
    return path_exists(spark, f"{path}/_SUCCESS")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage so that a lost executor does not bring the work back, and
    lets Catalyst plan with the real size of the result.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of steps that have ended deleted, once their tables are written.

    Spark deletes them when the driver collects its garbage, which one with room in its heap
    puts off while they pile up on the disks.
    """
    gc.collect()
    spark._jvm.System.gc()


def spread(scan: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """Rebalance a table scan whose tasks are fewer than there are cores, or uneven, or large.

    A file is split between its row groups only, so a few groups of text make a few long
    tasks, however many splits are planned. The footers tell the rows of each split: the scan is
    left as it is where no split has over ``rows``, and all cores are in use most of the time: a
    few splits more than there are cores would keep one core busy while the others wait.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    splits = scan.groupBy(F.spark_partition_id().alias("split")).count()
    found = splits.agg(F.count("*").alias("used"), F.max("count").alias("most"), F.sum("count").alias("all")).first()
    total, rounds = found["all"] or 0, math.ceil(found.used / cores)
    even = total and (found.most <= _WORTH or rounds * found.most * cores <= _IDLE * total)
    if found.used >= cores and found.most <= rows and even:
        return scan
    return scan.repartition(cores * max(1, math.ceil(total / (rows * cores))))
