"""The entry store: commits, aborts, writers at the same time, compaction."""

import glob
import os
import threading

import pytest
from pyspark.sql import functions as F

from mediasift.operators.cache import insert_and_evict
from mediasift.sources.store import StoreWriter, _names, _open, add_entries, commits, compact, first_entries, read_entries

SCHEMA = "key string, scores map<string,double>, note string"


def entries(spark, low, high, note="x"):
    return spark.range(low, high).select(F.concat(F.lit("k"), "id").alias("key"), F.create_map(F.lit("a"), F.col("id") / 4).alias("scores"), F.when(F.col("id") % 2 == 0, note).alias("note"))


def test_rows_come_back_in_order_and_in_flushed_files(spark, tmp_path):
    path = f"{tmp_path}/store"
    assert read_entries(spark, path, SCHEMA).count() == 0
    add_entries(entries(spark, 0, 60).coalesce(1), path)
    add_entries(entries(spark, 60, 70).coalesce(1), path)
    got = read_entries(spark, path, SCHEMA).orderBy("seq").collect()
    assert [(r["key"], r["scores"], r["note"]) for r in got] == [(f"k{i}", {"a": i / 4}, None if i % 2 else "x") for i in range(70)]
    assert len(glob.glob(f"{path}/commit-*/*.jsonl")) == 3 + 1  # 25, 25, 10 and 10
    add_entries(entries(spark, 0, 0), path)
    assert len(commits(path)[0]) == 2 and not glob.glob(f"{path}/_staging/*")


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/store"
    add_entries(entries(spark, 0, 10), path)
    broken = entries(spark, 100, 300).repartition(4).withColumn("note", F.when(F.col("key") == "k250", F.raise_error(F.lit("killed"))).otherwise("y"))
    with pytest.raises(Exception, match="killed"):
        add_entries(broken, path, 5)
    assert read_entries(spark, path, SCHEMA).count() == 10 and not glob.glob(f"{path}/_staging/*")


def test_an_attempt_that_died_is_not_committed(spark, tmp_path):
    path = f"{tmp_path}/store"
    rows = entries(spark, 0, 90).collect()

    def dies():
        yield from rows[:30]
        raise KeyboardInterrupt

    writer = StoreWriter(path, 25, [])
    with pytest.raises(KeyboardInterrupt):
        writer.write(dies())
    assert len(glob.glob(f"{path}/_staging/*/*/*.jsonl")) == 1 and read_entries(spark, path, SCHEMA).count() == 0
    writer.commit([writer.write(iter(rows[:40])), None])  # the second attempt
    assert read_entries(spark, path, SCHEMA).count() == 40 and not glob.glob(f"{path}/_staging/*")
    left = StoreWriter(path, 25, [])
    left.write(iter(rows[40:]))  # the driver is killed before it commits
    assert read_entries(spark, path, SCHEMA).count() == 40 and _names(*_open(f"{path}/_staging")) == [left.job]
    left.abort([])
    assert _names(*_open(f"{path}/_staging")) == []
    with pytest.raises(ValueError, match="flushEvery"):
        StoreWriter(path, 0, [])


def test_two_writers_lose_nothing_and_one_wins_each_key(spark, tmp_path):
    path = f"{tmp_path}/store"
    writers = [threading.Thread(target=lambda n=n: add_entries(entries(spark, 0, 40 + n, f"w{n}").repartition(3), path, 4)) for n in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    rows = read_entries(spark, path, SCHEMA)
    assert rows.count() == 40 + 41 + 42 + 43 and len({r["seq"] for r in rows.collect()}) == rows.count()
    first = first_entries(rows, ["key"]).collect()
    assert {r["key"] for r in first} == {f"k{i}" for i in range(43)}
    winner = {r["note"] for r in first if r["note"]}
    assert len([w for w in winner if w in {"w0", "w1", "w2", "w3"}]) >= 1
    by_commit = {}
    for r in rows.collect():
        by_commit.setdefault(r["seq"] >> 37, set()).add(r["note"])
    earliest = by_commit[0] - {None}
    assert {r["note"] for r in first if r["note"] and int(r["key"][1:]) < 40} == earliest  # the first commit holds


def test_compaction_keeps_the_order_and_evicts_the_oldest(spark, tmp_path):
    path = f"{tmp_path}/store"
    for low in (0, 20, 10):
        add_entries(entries(spark, low, low + 20, f"n{low}").coalesce(1), path)
    before = read_entries(spark, path, SCHEMA)
    want = insert_and_evict(first_entries(before, ["key"]).select("key", "seq", "note"), before.select("key", "seq", "note").limit(0), 25)
    want = [(r["key"], r["note"]) for r in want.orderBy("seq").collect()]
    compact(spark, path, SCHEMA, ["key"], most=25)
    assert [(r["key"], r["note"]) for r in read_entries(spark, path, SCHEMA).orderBy("seq").collect()] == want
    assert [len(x) for x in commits(path)] == [1, 3]  # replaced commits stay for readers that began before
    add_entries(entries(spark, 99, 100), path)
    compact(spark, path, SCHEMA, ["key"])
    assert [len(x) for x in commits(path)] == [1, 2] and read_entries(spark, path, SCHEMA).count() == 26
    assert len(os.listdir(path)) >= 3
