"""Helpers shared by the training-data operators: ranks, groups and components."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediasift.scratch import checkpoint_root, discard, materialise, scratch

__all__ = ["attach_groups", "bounded_parts", "checkpoint_root", "connected_components", "discard", "give_back", "in_batches", "materialise", "prefix_sums", "release_shuffles", "scratch", "strip_white", "text_or_empty", "tidy", "unused_names", "worker_cache"]

#: ASCII white space: the characters of [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
#: A group of at least so many rows is heavy: what is known of it is broadcast instead of shuffled to.
HEAVY_ROWS, HEAVY_SHARE, MOST_HEAVY = 20_000, 1024, 500_000
#: So many partitions a shuffle may have before they get larger.
MANY_PARTS = 50_000


ARROW_ROWS = 500
_LIVE: dict = {}


def worker_cache(key: object, make):
    """What a Python worker keeps between tasks: one object at a time, so that operators don't add up."""
    if key not in _LIVE:
        if _LIVE:
            _LIVE.clear()
            give_back()
        _LIVE[key] = make()
    return _LIVE[key]


def in_batches(rows: DataFrame) -> DataFrame:
    """rows, whose texts may be long: Arrow batches of this session hold at most ARROW_ROWS rows from here on."""
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ARROW_ROWS:
        conf.set(name, str(ARROW_ROWS))
    return rows


def tidy(work):
    """work (a generator of batches), after which a task gives freed memory back."""

    def run(batches):
        yield from work(batches)
        give_back()

    return run


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of data frames that nothing refers to any more; it looks at what the JVM's collector finds."""
    gc.collect()
    spark._jvm.System.gc()


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive the operator that filled them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def unused_names(df: DataFrame, names: tuple[str, ...]) -> tuple[str, ...]:
    """names, led by as many underscores as it takes for df to have none of them."""
    held, lead = {c.lower() for c in df.columns}, "_"
    while any(f"{lead}{n}".lower() in held for n in names):
        lead += "_"
    return tuple(lead + n for n in names)


def strip_white(text: Column) -> Column:
    """text without ASCII white space."""
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")


def text_or_empty(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def prefix_sums(df: DataFrame, keys: list[str], order: list[Column], value: Column, out: str, rows: int, per_bucket: int = 50_000, total: str | None = None, bucket: Column | None = None) -> DataFrame:
    """Add `out`: the sum of `value` over the rows of the same keys (none of them null) that come before this one.

    The order within a key is (bucket, *order), where the bucket is a hash of the row, so that even a key
    that holds all rows is summed by many tasks; only the sums of buckets meet per key. Ties in `order`
    are between rows that are equal in it. With `total`, each key's whole sum is added as well. With `bucket`
    (a long that ascends with `order`), the order within a key is `order` itself. At every size rows are shuffled
    once, by key and bucket, and meet the sums of their bucket there.
    """
    buckets = max(1, -(-rows // per_bucket))
    df = df.withColumn("_b", (F.pmod(F.xxhash64(*keys, *order), F.lit(buckets)) if bucket is None else bucket).cast("long")).withColumn("_v", value.cast("long"))
    local = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = df.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    sums = sums.withColumn("_before", F.sum("_s").over(before) - F.col("_s"))
    if total:
        sums = sums.withColumn(total, F.sum("_s").over(whole))
    sums = materialise(sums.drop("_s"), "sums")
    df = df.withColumn("_local", F.sum("_v").over(local) - F.col("_v"))
    return df.join(sums.hint("merge"), [*keys, "_b"]).withColumn(out, F.col("_before") + F.col("_local")).drop("_b", "_v", "_before", "_local")


def bounded_parts(total: int, each: int, largest: int) -> int:
    """How many parts of `each` a total makes; beyond MANY_PARTS the parts grow instead, up to `largest`."""
    return max(1, min(-(-total // each), max(MANY_PARTS, -(-total // largest))))


def heavy_from(total: int) -> int:
    """Rows from which a group of a table of `total` rows is heavy; at most MOST_HEAVY groups can be."""
    return max(2, min(-(-total // HEAVY_SHARE), max(HEAVY_ROWS, -(-total // MOST_HEAVY))))


def attach_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Left join rows with what is known of their groups (a written table; `size` counts a group's rows).

    Heavy groups (a bounded number) go by broadcast, all others by a shuffle join at every size, so that
    no task receives a hot group and small inputs are planned like large ones.
    """
    at = heavy_from(total)
    heavy = groups.filter(F.col(size) >= at)
    light = groups.filter(F.col(size) < at)
    extra = [c for c in groups.columns if c not in keys]
    marked = rows.join(F.broadcast(heavy.select(*keys, F.struct(*extra).alias("_heavy"))), keys, "left")
    hot = marked.filter(F.col("_heavy").isNotNull()).select(*rows.columns, *[F.col("_heavy")[c].alias(c) for c in extra])
    rest = marked.filter(F.col("_heavy").isNull()).drop("_heavy").join(light.hint("merge"), keys, "left").select(*rows.columns, *extra)
    return hot.unionByName(rest)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (u, v long): component is the smallest node reachable.

    Alternating large-star and small-star steps over written tables, until a step changes nothing. Groups are
    reduced by partial aggregation, and the edges of a hub meet its minimum by broadcast, so that
    no task receives a hub.
    """
    edges = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    spark, seen, now = edges.sparkSession, None, (edges.count(),)

    def step(pairs: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
        """Each edge with the least neighbour `m` of its u, and the minima."""
        least = materialise(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "minima")
        return attach_groups(pairs, least, ["u"], "n", total), least

    while now[0] and seen != now:
        seen = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        met, minima = step(both, 2 * now[0])
        large = met.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v").distinct()
        large = materialise(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
        met, roots = step(large, now[0])
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        after = materialise(small.unionByName(roots.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        for old in (edges, minima, large, roots):
            discard(old, spark)
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
