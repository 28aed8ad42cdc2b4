"""Caches and lists that many jobs add to: a data source whose writes appear whole or not at all.

`spark.read/write.format("mediasift_entries")`, once `register(spark)` was called, on a folder that all executors
share (any file system of Arrow's). Rows are lines of JSON.

A task stages its rows below `_staging/JOB/TASK`, each `flushEvery` rows as a file that is written under another
name and then renamed. When all tasks are done, the driver drops what lost attempts staged and renames the job's
folder to `commit-TIME-ID`: that one rename makes the rows visible. A job that fails, or is killed at any point
before, leaves staged files that no reader looks at. Names are unique, so writers at the same time lose nothing.

Reading gives all rows of all commits, with `seq` (long, if the schema has it) in the order of commits, files and rows.
`first_entries` settles keys that several writers inserted: the earliest one holds. `compact` rewrites a store to these in one commit that names the commits
it replaces, whose folders go with the next compaction, so that readers that listed them before can end.

An empty table commits nothing; a missing folder is an empty store. Null values, maps, arrays and structs come back
as they were; columns must be strings, numbers, booleans or made of these.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
import weakref
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

FORMAT, STAGING, REPLACES, SEQ = "mediasift_entries", "_staging", "_replaces.json", "seq"
#: Fixed value: rows written between two flushes.
FLUSH_EVERY = 25
_LOCK, _KNOWN = threading.Lock(), weakref.WeakSet()
FILE_BITS, ROW_BITS, FILES_A_PARTITION = 20, 17, 256


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _names(store: fs.FileSystem, folder: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found)


def commits(path: str) -> tuple[list[str], list[str]]:
    """(folders that count, folders that later ones replace), in their order."""
    store, root = _open(path)
    found = [n for n in _names(store, root) if n.startswith("commit-")]
    gone: set[str] = set()
    for name in found:
        if store.get_file_info(f"{root}/{name}/{REPLACES}").type == fs.FileType.File:
            gone.update(json.loads(store.open_input_stream(f"{root}/{name}/{REPLACES}").read()))
    return [n for n in found if n not in gone], [n for n in found if n in gone]


@dataclass
class Files(InputPartition):
    """Files of a store, each with the first seq of its rows."""

    files: list[tuple[str, int]]


@dataclass
class Staged(WriterCommitMessage):
    task: str
    rows: int


class EntryStore(DataSource):
    """Reads and appends entries; see the module."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def reader(self, schema: StructType) -> DataSourceReader:
        return StoreReader(schema, self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("entries are appended; use compact() to rewrite a store")
        return StoreWriter(self.options["path"], int(self.options.get("flushEvery", FLUSH_EVERY)), json.loads(self.options.get("replaces", "[]")))


class StoreReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str):
        self.names, self.path = schema.fieldNames(), path

    def partitions(self) -> list[Files]:
        store, root = _open(self.path)
        found = []
        for place, commit in enumerate(commits(self.path)[0]):
            parts = [n for n in _names(store, f"{root}/{commit}") if n.endswith(".jsonl")]
            if len(parts) >> FILE_BITS:
                raise ValueError(f"{commit} has too many files; compact the store")
            found += [(f"{root}/{commit}/{n}", ((place << FILE_BITS) + i) << ROW_BITS) for i, n in enumerate(parts)]
        return [Files(found[i : i + FILES_A_PARTITION]) for i in range(0, len(found), FILES_A_PARTITION)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = _open(self.path)
        for file, first in partition.files:
            for i, line in enumerate(store.open_input_stream(file).read().splitlines()):
                row = json.loads(line)
                yield tuple(first + i if n == SEQ else row.get(n) for n in self.names)


class StoreWriter(DataSourceWriter):
    def __init__(self, path: str, flush_every: int, replaces: list[str]):
        if not 0 < flush_every < 1 << ROW_BITS:
            raise ValueError(f"flushEvery is between 1 and {(1 << ROW_BITS) - 1}")
        self.path, self.flush_every, self.replaces, self.job = path, flush_every, replaces, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Staged:
        from pyspark import TaskContext

        store, root = _open(self.path)
        context = TaskContext.get()
        task = f"{context.partitionId() if context else 0:08d}-{uuid.uuid4().hex}"
        folder, held, count = f"{root}/{STAGING}/{self.job}/{task}", [], 0
        store.create_dir(folder)

        def flush() -> None:
            name = f"{folder}/part-{task[:8]}-{count // self.flush_every:08d}.jsonl"
            with store.open_output_stream(f"{name}.tmp") as out:
                out.write("".join(held).encode())
            store.move(f"{name}.tmp", name)
            held.clear()

        for row in rows:
            held.append(json.dumps(row.asDict(recursive=True), ensure_ascii=False) + "\n")
            if len(held) == self.flush_every:
                flush()
                count += self.flush_every
        if held:
            count_now = count + len(held)
            flush()
            count = count_now
        return Staged(task, count)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = _open(self.path)
        staged = f"{root}/{STAGING}/{self.job}"
        tasks = {m.task for m in messages if m is not None}
        if not any(m.rows for m in messages if m is not None) and not self.replaces:
            return self.abort(messages)
        whole = f"{staged}/whole"
        store.create_dir(whole)
        for task in _names(store, staged):
            if task in tasks:
                for name in _names(store, f"{staged}/{task}"):
                    store.move(f"{staged}/{task}/{name}", f"{whole}/{name}")
        if self.replaces:
            with store.open_output_stream(f"{whole}/{REPLACES}") as out:
                out.write(json.dumps(self.replaces).encode())
        store.move(whole, f"{root}/commit-{time.time_ns():020d}-{self.job}")
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        store, root = _open(self.path)
        if store.get_file_info(f"{root}/{STAGING}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{STAGING}/{self.job}")


def register(spark: SparkSession) -> None:
    """Make the format known to a session, once, and the session that of this thread, where formats are looked up."""
    getattr(getattr(spark._jvm, "org.apache.spark.sql.classic.SparkSession$"), "MODULE$").setActiveSession(spark._jsparkSession)
    with _LOCK:
        if spark not in _KNOWN:
            spark.dataSource.register(EntryStore)
            _KNOWN.add(spark)


def read_entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of the store at path, in the columns of schema and seq."""
    register(spark)
    return spark.read.format(FORMAT).schema(f"{schema}, {SEQ} long").load(path)


def add_entries(rows: DataFrame, path: str, flush_every: int = FLUSH_EVERY) -> None:
    """Append rows to the store at path, all or none."""
    register(rows.sparkSession)
    rows.write.format(FORMAT).option("flushEvery", flush_every).mode("append").save(path)


def first_entries(entries: DataFrame, keys: list[str]) -> DataFrame:
    """entries (with seq) without those whose keys an earlier one has: whoever inserts first wins."""
    rest = [c for c in entries.columns if c not in keys]
    first = F.min_by(F.struct(*rest), SEQ).alias("_first")
    return entries.groupBy(*keys).agg(first).select(*[c if c in keys else F.col("_first")[c].alias(c) for c in entries.columns])


def compact(spark: SparkSession, path: str, schema: str, keys: list[str], most: int | None = None, files: int = 1) -> None:
    """Rewrite the store to the first entry of each key, of these the newest `most`, in their order."""
    live, replaced = commits(path)
    kept = first_entries(read_entries(spark, path, schema), keys)
    if most is not None:
        kept = kept.orderBy(F.desc(SEQ)).limit(most)
    ordered = kept.repartitionByRange(files, SEQ).sortWithinPartitions(SEQ).drop(SEQ)
    ordered.write.format(FORMAT).option("flushEvery", (1 << ROW_BITS) - 1).option("replaces", json.dumps(live)).mode("append").save(path)
    store, root = _open(path)
    for name in replaced:
        store.delete_dir(f"{root}/{name}")
