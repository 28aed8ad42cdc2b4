"""Media that arrive in a landing folder, moderated in micro-batches.

Each batch sees the hash lists as the batches before it left them, so that what one batch learned the next one
matches; within a batch the lists are a snapshot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mediasift.functions.columns import is_image_path

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_files(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """New image files of a folder as a stream, with their contents."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", most_files).load(folder)
    return files.filter(is_image_path(F.col("path"))).withColumnRenamed("path", "media_id")


def moderate_stream(files: DataFrame, moderate: Callable[[DataFrame], DataFrame], verdicts: str, checkpoint: str, learn: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Write the verdicts of every batch below `verdicts` (a folder a batch, so a repeated batch overwrites itself), then learn from them."""

    def step(batch: DataFrame, number: int) -> None:
        path = f"{verdicts}/batch={number}"
        moderate(batch).write.mode("overwrite").parquet(path)
        if learn:
            learn(batch.sparkSession.read.parquet(path))

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
