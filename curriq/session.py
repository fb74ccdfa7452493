"""Table reads, and the shared folder in which loops cut their lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROWS_A_TASK = 1_500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(rows: DataFrame) -> DataFrame:
    """Keep Arrow batches small, so that a Python worker's memory depends on a batch's bytes and not on 10,000 texts of any length."""
    conf = rows.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return rows


def dealt(rows: DataFrame, *keys: str, count: int | None = None) -> DataFrame:
    """rows of a table, dealt by keys to tasks of about ROWS_A_TASK rows, so that what a task sorts doesn't grow with the table.

    The rows are counted first, which takes no column of a Parquet file; count: about how many they are, where that is known.
    """
    tasks = -(-(rows.count() if count is None else count) // ROWS_A_TASK)
    return rows.repartition(max(tasks, rows.sparkSession.sparkContext.defaultParallelism), *keys)


def loop_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset on one machine (tests), under a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="curriq-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/curriq-{uuid.uuid4().hex}"


def cut(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write df and read it back, so that a loop's plan stays short and outlives executors."""
    path, schema = f"{folder}/{name}", df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


@contextmanager
def sparing(spark: SparkSession) -> Iterator[None]:
    """Within it, `cut` packs its tables tightly, and the shuffle files of a `cut` go once it is done, not when the driver collects garbage."""
    conf = {"spark.sql.parquet.compression.codec": "zstd", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {key: spark.conf.get(key, None) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def forget(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete what `cut` wrote, once no later plan reads it."""
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
