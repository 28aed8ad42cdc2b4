"""A result cache as a table: keys, lookups, insertion with eviction of the oldest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cache_key(model: Column, text: Column, digests: Column) -> Column:
    """sha256 over the model's name, the text and the binary digests of the frames, in order, with line breaks between."""
    joined = F.aggregate(digests, F.encode(F.lit(""), "utf-8"), lambda a, d: F.concat(a, d))
    line = F.encode(F.lit("\n"), "utf-8")
    return F.sha2(F.concat(F.encode(model, "utf-8"), line, F.encode(text, "utf-8"), line, joined), 256)


def look_up(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests that the cache answers, with its columns; requests that must be sent), by `key`."""
    return requests.join(cache, "key"), requests.join(cache.select("key"), "key", "left_anti")


def insert_and_evict(cache: DataFrame, fresh: DataFrame, most: int) -> DataFrame:
    """The newest `most` entries (key, seq, …) of cache and fresh; a key's latest entry counts, in its first place.

    An updated entry keeps its place in the order, as in an insertion-ordered map.
    """
    both = cache.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    rest = [c for c in cache.columns if c not in ("key", "seq")]
    latest = F.max_by(F.struct(*rest), F.struct("_new", "seq")).alias("_v") if rest else F.lit(None).alias("_v")
    merged = both.groupBy("key").agg(F.min("seq").alias("seq"), latest).select("key", "seq", *[F.col("_v")[c].alias(c) for c in rest])
    kept = merged.orderBy(F.desc("seq"), F.desc("key")).limit(most)
    return kept.select(*cache.columns)
