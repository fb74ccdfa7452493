"""New deliveries as a stream: each micro-batch of files is decoded and validated, and written below its batch id.

A batch that is run again after a failure overwrites its own folder, so every file's rows are there once. Readers see the
tables as a whole: `batch` is a partition column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from curriq.sources.wire import read_nodes


def take_batch(batch: DataFrame, number: int, nodes_out: str, findings_out: str) -> None:
    """Decode the files that a batch names (path) and write its part of both tables."""
    paths = [r[0] for r in batch.toLocalIterator()]  # names of a micro-batch's files
    if paths:
        for rows, out in zip(read_nodes(batch.sparkSession, paths), (nodes_out, findings_out), strict=True):
            rows.write.mode("overwrite").parquet(f"{out}/batch={number}")


def watch_nodes(spark: SparkSession, folder: str, nodes_out: str, findings_out: str, checkpoint: str) -> StreamingQuery:
    """Decode node files that appear in a folder, each once; ends when all that are there are done."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.jsonl").load(folder).select("path")  # names alone: contents aren't read here
    return files.writeStream.foreachBatch(lambda batch, number: take_batch(batch, number, nodes_out, findings_out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
