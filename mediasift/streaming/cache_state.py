"""A result cache, or a list that grows, as the state of a stream: what one micro-batch adds the next one finds.

Entries live in Spark's state store, dealt over `shards` by their keys, so that a batch touches what it names
instead of reading the whole cache again, and a restart goes on from the checkpoint. A shard holds at most `most`
entries: a key that comes again keeps its place and takes the latest value, as in an insertion-ordered map, and the
oldest entries beyond `most` go at the end of a batch. With one shard this is `insert_and_evict` batch by batch; with
more, each shard keeps its own newest. With `keep_seconds`, a timer drops entries once the watermark is that far
beyond the time of their insertion.

Without a timer, tasks that are dealt the keys first fold a batch's rows to one a key, so that a shard's task gets each key
once. Of more than `most` keys it holds the newest only; keys that would go in the batch that brought them are never stored.

The stream's rows are changes, one a key and batch: entries put, and keys that went (`gone`). `cache_of` folds them.
Null keys are dropped. Needs Spark's RocksDB state store, which `start` sets for its own query only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import Row

CHANGES = "key string, seq bigint, value string, gone boolean"
ROWS = "shard bigint, key string, seq bigint, value string, at bigint"
#: Rows that are folded at once, or as many as there are keys so far.
FOLD_ROWS = 100_000
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _one_a_key(t: pa.Table) -> pa.Table:
    """Rows (shard, key, seq, at, last, value) with the least seq and its time, and the value of the greatest `last`, of each key."""
    t = t.append_column("code", t.column("key").combine_chunks().dictionary_encode().indices)

    def ends(by: str, side: int) -> pa.Table:
        found = t.take(pc.sort_indices(t, sort_keys=[("code", "ascending"), (by, "ascending")]))  # stable: of equals, the latest comes last
        turns = np.flatnonzero(np.diff(found.column("code").to_numpy()))
        return found.take(pa.array(np.append(turns, len(found) - 1) if side else np.append(0, turns + 1)))

    return ends("seq", 0).select(["shard", "key", "seq", "at"]).append_column("last", (late := ends("last", 1)).column("last")).append_column("value", late.column("value"))


def folded(batches: Iterator[pa.RecordBatch], fold_rows: int = FOLD_ROWS) -> Iterator[pa.RecordBatch]:
    """One row (ROWS) for each key of a task: its first place, its latest value."""
    held, fresh, n = [], [], 0
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        fresh.append(t.append_column("last", t.column("seq")).select(["shard", "key", "seq", "at", "last", "value"]))
        n += b.num_rows
        if n >= max(fold_rows, sum(map(len, held))):
            held, fresh, n = [_one_a_key(pa.concat_tables([*held, *fresh]))], [], 0
    if held or fresh:
        yield from _one_a_key(pa.concat_tables([*held, *fresh])).select(["shard", "key", "seq", "value", "at"]).to_batches(10_000)


class CacheState(StatefulProcessor):
    """Entries of one shard by key: place in the order, value, and when they were inserted (milliseconds).

    once: a batch has each key once.
    """

    def __init__(self, most: int, keep_ms: int | None, once: bool):
        self.most, self.keep_ms, self.once = most, keep_ms, once

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "seq bigint, value string, at bigint")
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        if self.once:
            some = list(islice(rows, self.most + 1))
            if len(some) > self.most:
                yield from self._take_newest(chain(some, rows))
                return
            rows = some
        first, last = {}, {}
        for r in rows:
            k = r["key"]
            if k not in first or r["seq"] < first[k][0]:
                first[k] = (r["seq"], r["at"])
            if k not in last or r["seq"] >= last[k][0]:
                last[k] = (r["seq"], r["value"])
        n = self.count.get()[0] if self.count.exists() else 0
        put = {}
        for k in first:
            held = self.entries.getValue((k,))
            n += held is None
            put[k] = (first[k][0], last[k][1], first[k][1]) if held is None else (held[0], last[k][1], held[2])
            self.entries.updateValue((k,), put[k])
        gone = self._drop_beyond(n) if n > self.most else []
        self.count.update((min(n, self.most),))
        self._set_timer()
        for k in gone:
            put.pop(k, None)
            yield Row(key=k, seq=None, value=None, gone=True)
        for k, (seq, value, _) in put.items():
            yield Row(key=k, seq=seq, value=value, gone=False)

    def _take_newest(self, rows: Iterator[Row]) -> Iterator[Row]:
        """A batch of more than `most` keys: entries held and the newest of the others contend."""
        held = dict(self._all())
        put, fresh = {}, []
        for r in rows:
            key, seq, value, at = r[1:5]
            if key in held:
                put[key] = (held[key][0], value, held[key][2])
            elif len(fresh) < self.most:
                heapq.heappush(fresh, (seq, key, value, at))
            else:
                heapq.heappushpop(fresh, (seq, key, value, at))
        put |= {key: (seq, value, at) for seq, key, value, at in fresh}
        kept = {k for _, k in heapq.nlargest(self.most, [(v[0], k) for k, v in (held | put).items()])}
        self.count.update((len(kept),))
        for k in held.keys() - kept:
            self.entries.removeKey((k,))
            yield Row(key=k, seq=None, value=None, gone=True)
        for k in put.keys() & kept:
            self.entries.updateValue((k,), put[k])
            yield Row(key=k, seq=put[k][0], value=put[k][1], gone=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        late = [k for k, (_, _, at) in self._all() if at + self.keep_ms <= expiredTimerInfo.getExpiryTimeInMs()]
        for k in late:
            self.entries.removeKey((k,))
            yield Row(key=k, seq=None, value=None, gone=True)
        self.count.update((self.count.get()[0] - len(late),))
        self._set_timer()

    def _all(self) -> list[tuple[str, tuple]]:
        return [(k[0], tuple(v)) for k, v in self.entries.iterator()]  # at most `most` and a batch

    def _drop_beyond(self, n: int) -> list[str]:
        oldest = sorted((v[0], k) for k, v in self._all())[: n - self.most]
        for _, k in oldest:
            self.entries.removeKey((k,))
        return [k for _, k in oldest]

    def _set_timer(self) -> None:
        """One timer a shard, for the entry that was inserted first."""
        if self.keep_ms is None:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        at = [v[2] for _, v in self._all()]
        if at:
            self.handle.registerTimer(min(at) + self.keep_ms)

    def close(self) -> None:
        pass


def cache_changes(updates: DataFrame, most: int, shards: int = 1, keep_seconds: int | None = None, delay: str = "0 seconds") -> DataFrame:
    """Changes of a cache that a stream of updates (key, seq, value and, to drop by time, ts) goes into."""
    timed = keep_seconds is not None
    rows = updates.withWatermark("ts", delay) if timed else updates
    at = F.unix_millis("ts") if timed else F.lit(0).cast("bigint")
    rows = rows.filter("key is not null").select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "key", F.col("seq").cast("bigint").alias("seq"), F.col("value").cast("string").alias("value"), at.alias("at"), *(["ts"] if timed else []))
    if not timed:
        rows = rows.repartition("key").mapInArrow(folded, ROWS)
    state = CacheState(most, 1000 * keep_seconds if timed else None, not timed)
    return rows.groupBy("shard").transformWithState(state, CHANGES, "Update", "EventTime" if timed else "None")


def start(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the changes of every batch below path (a folder a batch, so a repeated batch overwrites itself)."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    conf, before = changes.sparkSession.conf, changes.sparkSession.conf.get(PROVIDER[0])
    conf.set(*PROVIDER)
    try:  # a query takes the settings of the moment it starts
        return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(PROVIDER[0], before)


def cache_of(changes: DataFrame) -> DataFrame:
    """key, seq, value of the entries that are left by changes (with batch)."""
    last = changes.groupBy("key").agg(F.max_by(F.struct("seq", "value", "gone"), "batch").alias("c"))
    return last.filter("not c.gone").select("key", "c.seq", "c.value")
