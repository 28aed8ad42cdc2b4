"""Operator 8: two-pass external shuffle into shards, in DataFrame operations only.

Pass 1 scatters records uniformly into memory-sized buckets by a seeded hash of the record; pass 2 shuffles each
bucket (Spark's `shuffle` is a Fisher-Yates shuffle) and lays the buckets end to end. Shards are equal ranges of
that order, so counts differ by one at most ("rows") and a bucket touches few shards.

The place of a record follows from the seed and the records alone. A bucket belongs to a partition by its number
(their count is fixed by the sizes of the input, not by settings), its records are sorted before they are
shuffled, and the shuffle is seeded by seed and partition. So neither file splits, shuffle partitions nor a
repeated task change the result. Records that are equal in all columns are interchangeable; where
there are many of them they are numbered, and the number scatters them over the buckets.

Edge cases: null texts, empty tables (no rows), repeated rows and repeated ids are ordinary records; all columns
are kept whatever they are called, except that `shard` and `slot` are replaced. A bucket is one array in
memory: BUCKET_BYTES of text, or one text if that is longer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediasift.llm.common import bounded_parts, heavy_from, materialise, prefix_sums

BUCKET_BYTES = 16 << 20
BUCKET_ROWS, BUCKETS_A_GROUP = 20_000, 1000
#: Times these sizes that a bucket may grow where there would be too many.
LARGEST = 16


def _hashable(name: str, kind: T.DataType) -> Column:
    """The column, as JSON where hashes don't take its type."""
    plain = isinstance(kind, T.AtomicType) and not isinstance(kind, T.VariantType)
    return F.col(f"`{name}`") if plain else F.to_json(F.struct(F.col(f"`{name}`")))


def _scattered(df: DataFrame, seed: int, rows: int) -> DataFrame:
    """_row (all columns of df), _h and _h2: two hashes that differ between records, also between most equal ones of a large group."""
    parts = [x for i, f in enumerate(df.schema.fields) for x in (_hashable(f.name, f.dataType), F.lit(i))]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])
    keyed = df.select(F.xxhash64(F.lit(seed), *parts).alias("_h"), F.xxhash64(F.lit(~seed), *parts).alias("_h2"), row.alias("_row"))
    many = materialise(keyed.groupBy("_h", "_h2").agg(F.count("*").alias("_n")).filter(F.col("_n") >= heavy_from(rows)), "many")  # at most HEAVY_SHARE or MOST_HEAVY rows
    if not many.limit(1).count():
        return keyed
    marked = keyed.join(F.broadcast(many), ["_h", "_h2"], "left")
    # Written with their numbers: evaluated twice, rows could come in another order the second time.
    equal = materialise(marked.filter("_n is not null").select("_h", "_h2", "_row", F.monotonically_increasing_id().alias("_at")), "equal")
    numbered = prefix_sums(equal, ["_h", "_h2"], [F.col("_at")], F.lit(1), "_copy", rows, BUCKET_ROWS)
    again = numbered.select(F.xxhash64("_h", "_copy").alias("_h"), F.xxhash64("_h2", "_copy").alias("_h2"), "_row")
    return marked.filter("_n is null").select("_h", "_h2", "_row").unionByName(again)


def external_shuffle(df: DataFrame, n_shards: int, seed: int = 17, bytes_column: str | None = "text") -> DataFrame:
    """All rows and columns of df with shard (0 to n_shards-1) and slot (0, 1, … in each shard)."""
    df = df.drop("shard", "slot")
    size = F.octet_length(F.col(bytes_column)) if bytes_column in df.columns else F.lit(0)
    rows, total = df.agg(F.count("*"), F.sum(F.coalesce(size, F.lit(0)).cast("long"))).first()
    buckets = max(bounded_parts(total or 0, BUCKET_BYTES, LARGEST * BUCKET_BYTES), bounded_parts(rows, BUCKET_ROWS, LARGEST * BUCKET_ROWS))
    placed = _scattered(df, seed, rows).withColumn("_bucket", F.pmod("_h", F.lit(buckets)))
    counts = placed.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_all", F.lit(0))
    before = prefix_sums(counts, ["_all"], [F.col("_bucket")], F.col("_n"), "_first", 0, bucket=F.floor(F.col("_bucket") / BUCKETS_A_GROUP)).select("_bucket", "_first")
    items = F.collect_list(F.struct("_h", "_h2", "_row"))
    if all(isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType) for f in df.schema.fields):
        items = F.sort_array(items)
    else:  # rows of some types can't be compared, their hashes can
        items = F.array_sort(items, lambda a, b: F.when((a["_h"] < b["_h"]) | ((a["_h"] == b["_h"]) & (a["_h2"] < b["_h2"])), -1).when((a["_h"] == b["_h"]) & (a["_h2"] == b["_h2"]), 0).otherwise(1))
    filled = placed.repartition(buckets, "_bucket").groupBy("_bucket").agg(items.alias("_rows"))
    mixed = filled.sortWithinPartitions("_bucket").select("_bucket", F.posexplode(F.shuffle("_rows", seed)).alias("_pos", "_item"))
    order = mixed.join(F.broadcast(before) if buckets <= 100_000 else before.hint("merge"), "_bucket")
    g = F.col("_first") + F.col("_pos")
    shard = F.floor(g * n_shards / F.lit(max(rows, 1))) if rows * n_shards < 2**53 else F.expr(f"cast((_first + _pos) * {n_shards} as decimal(38,0)) div {rows}")
    shard = shard.cast("int")
    first = F.floor((shard.cast("long") * rows + (n_shards - 1)) / n_shards)
    return order.select(*[F.col("_item")["_row"][f"c{i}"].alias(c) for i, c in enumerate(df.columns)], shard.alias("shard"), (g - first).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str, n_shards: int, seed: int = 17) -> DataFrame:
    """Shuffle df into shards, write them below path (one folder each) and return the written table."""
    shuffled = external_shuffle(df, n_shards, seed)
    shuffled.write.partitionBy("shard").parquet(path)
    return df.sparkSession.read.schema(shuffled.schema).parquet(path)
