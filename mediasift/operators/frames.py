"""Choosing frames of a media item: even samples, first and last, first k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def even_sample(frames: DataFrame, media: str, index: str, sample: int) -> DataFrame:
    """Frames at evenly spaced places (half-even rounding), first and last included; all of them if few or sample <= 1."""
    counts = frames.groupBy(media).agg(F.count("*").alias("_n"))
    if sample <= 1:
        return frames
    steps = F.transform(F.sequence(F.lit(0), F.lit(sample - 1)), lambda j: F.rint(j * (F.col("_n") - 1) / F.lit(sample - 1)).cast("bigint"))
    wanted = F.when(F.col("_n") <= sample, F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).otherwise(F.array_distinct(steps))
    picked = counts.select(media, F.explode(wanted).alias(index))
    return frames.join(picked, [media, index], "left_semi")


def first_and_last(frames: DataFrame, media: str, position: str, value: str) -> DataFrame:
    """value at the lowest and highest position of each item; single: they are one frame."""
    return frames.groupBy(media).agg(
        F.min_by(value, position).alias("first"),
        F.max_by(value, position).alias("last"),
        (F.min(position) == F.max(position)).alias("single"),
    )


def first_k(frames: DataFrame, media: str, position: str, k: int) -> DataFrame:
    """The first k frames of each item; one if k is not positive."""
    rank = F.row_number().over(Window.partitionBy(media).orderBy(position))
    return frames.withColumn("_rank", rank).filter(F.col("_rank") <= max(1, k)).drop("_rank")
