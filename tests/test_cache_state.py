"""The cache as a stream's state against insert_and_evict batch by batch."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mediasift.operators.cache import insert_and_evict
from mediasift.streaming.cache_state import cache_changes, cache_of, folded, start

EVENTS = "/root/testdata/sf0.001/events.parquet"


def _updates(spark, folder):
    schema = spark.read.parquet(EVENTS).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return events.select(F.concat("event_type", F.lit("-"), F.col("user_id") % 40).alias("key"), F.col("event_id").alias("seq"), F.col("props").alias("value"), F.col("ts").cast("timestamp").alias("ts"))


def _run(spark, tmp_path, **how):
    start(cache_changes(_updates(spark, f"{tmp_path}/in"), **how), f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
    return {(r["key"], r["seq"], r["value"]) for r in cache_of(spark.read.parquet(f"{tmp_path}/out")).collect()}


def _arrive(spark, tmp_path, number, parts):
    os.makedirs(f"{tmp_path}/in", exist_ok=True)
    events = spark.read.parquet(EVENTS)
    low, high = events.agg(F.min("event_id"), F.max("event_id") + 1).first()
    part = events.filter(F.floor((F.col("event_id") - low) * parts / (high - low)) == number)  # one after the other
    file = f"{tmp_path}/in/{number}.parquet"
    part.toPandas().to_parquet(f"{file}.tmp", coerce_timestamps="us")
    os.replace(f"{file}.tmp", file)
    os.utime(file, (1_700_000_000 + number, 1_700_000_000 + number))


@pytest.mark.skipif(not os.path.exists(EVENTS), reason="needs the driver's tables")
def test_stream_agrees_with_insert_and_evict_across_a_restart(spark, tmp_path):
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    batches = []
    for number in range(3):
        _arrive(spark, tmp_path, number, 3)
        batches.append(number)
        if number == 0:
            continue
        got = _run(spark, tmp_path, most=30)  # two files first, then one more after a restart
        cache = spark.createDataFrame([], "key string, seq long, value string")
        for n in batches:
            rows = spark.read.parquet(f"{tmp_path}/in/{n}.parquet").select(F.concat("event_type", F.lit("-"), F.col("user_id") % 40).alias("key"), F.col("event_id").alias("seq"), F.col("props").alias("value"))
            cache = spark.createDataFrame(insert_and_evict(cache, rows, 30).collect(), "key string, seq long, value string")
        assert got == {tuple(r) for r in cache.collect()} and len(got) == 30
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider


@pytest.mark.skipif(not os.path.exists(EVENTS), reason="needs the driver's tables")
def test_shards_and_a_timer(spark, tmp_path):
    for number in range(2):
        _arrive(spark, tmp_path, number, 2)
    got = _run(spark, tmp_path, most=10_000, shards=4, keep_seconds=1)
    events = spark.read.parquet(EVENTS).select(F.concat("event_type", F.lit("-"), F.col("user_id") % 40).alias("key"), F.col("event_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")).collect()
    last = max(r["ms"] for r in events)
    inserted = {}
    for r in events:
        inserted.setdefault(r["key"], []).append(r["ms"])
    assert got
    gone = {r["key"] for r in spark.read.parquet(f"{tmp_path}/out").filter("gone").collect()}
    assert gone  # the second batch's watermark lies a second beyond most of the first batch's entries
    assert all(min(inserted[k]) + 1000 <= last for k in gone)


@pytest.mark.skipif(not os.path.exists(EVENTS), reason="needs the driver's tables")
def test_a_batch_of_many_keys_stores_and_tells_only_what_stays(spark, tmp_path):
    cache = spark.createDataFrame([], "key string, seq long, value string")
    for number in (2, 0, 1):  # the newest arrive first: held entries outlive later batches
        _arrive(spark, tmp_path, number, 3)
        os.utime(f"{tmp_path}/in/{number}.parquet", (1_700_000_100, 1_700_000_100))
        got = _run(spark, tmp_path, most=5)
        rows = spark.read.parquet(f"{tmp_path}/in/{number}.parquet").select(F.concat("event_type", F.lit("-"), F.col("user_id") % 40).alias("key"), F.col("event_id").alias("seq"), F.col("props").alias("value"))
        if number == 2:
            assert rows.select("key").distinct().count() > 50 and spark.read.parquet(f"{tmp_path}/out").count() == 5
        held = {r["key"]: r["seq"] for r in cache.collect()}
        cache = spark.createDataFrame([(k, held.get(k, s), v) for k, s, v in _cache(cache, rows, held)], "key string, seq long, value string")
        assert got == {tuple(r) for r in cache.collect()}


def _cache(cache, rows, held):
    """insert_and_evict where a held entry keeps its place even if the batch has an earlier one."""
    late = rows.filter(~F.col("key").isin(list(held))).unionByName(rows.filter(F.col("key").isin(list(held))).withColumn("seq", F.col("seq") + 10**9))
    return [tuple(r) for r in insert_and_evict(cache, late, 5).select("key", "seq", "value").collect()]


def test_rows_fold_to_one_a_key():
    rows = [(0, "a", 5, "a5", 50), (0, "b", 2, "b2", 20), (0, "a", 3, "a3", 30), (0, "b", 2, "b2 again", 21), (0, "a", 9, None, 90), (0, "a", 4, "a4", 40)]
    names = ["shard", "key", "seq", "value", "at"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True))]) for r in rows] + [pa.RecordBatch.from_pylist([], schema=pa.schema([(n, pa.int64()) for n in names]))]
    batches[4] = pa.RecordBatch.from_pylist([dict(zip(names, rows[4], strict=True))], schema=batches[0].schema)
    for at_once in (1, 3, 100):
        got = {tuple(r[n] for n in names) for b in folded(iter(batches), at_once) for r in b.to_pylist()}
        assert got == {(0, "a", 3, None, 30), (0, "b", 2, "b2 again", 20)}
