"""Frames of GIF animations and lossless WEBP pictures as a data source that decodes what a query asks for.

`read_frames` (format "mediasift_frames" after `register`) lists the .gif and .webp files of a folder and gives a row for each
sampled frame: media_id, n_frames, pos (in the sample), idx (in the file), width, height, pixels (RGB rows),
hash_hex, decoded (frames decoded of the file up to this row) and load_error, or as many of these as the schema names.

A sample is chosen from the file's structure, so frames outside it are decoded only where a picture depends on them.
Conditions on pos, idx and media_id reach the source where spark.sql.python.filterPushdown.enabled is on when `read_frames` is
called: frames and files that they leave out are neither decoded nor read. Without pixels, hash_hex and decoded in the schema nothing is decoded at all.

A frame that can't be decoded is left out. A file that is no animation, or none of whose sampled frames can be decoded, has
one row with a load_error (and null pos and idx). An empty or missing folder gives no rows.
"""

from __future__ import annotations

import threading
import weakref
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, In, InputPartition, LessThan
from pyspark.sql.types import StructType

from mediasift.sources.media import sample_places
from mediasift.sources.store import _open

FORMAT = "mediasift_frames"
SCHEMA = "media_id string, n_frames int, pos int, idx int, width int, height int, pixels binary, hash_hex string, decoded int, load_error string"
DECODED = ("pixels", "hash_hex", "decoded")
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
PUSHED = ("media_id", "pos", "idx")
FILES_A_PARTITION = 64
_LOCK, _KNOWN = threading.Lock(), weakref.WeakSet()


@dataclass
class Animations(InputPartition):
    paths: list[str]


def _test(f: Filter) -> Callable[[object], bool] | None:
    if isinstance(f, EqualTo):
        return lambda x: x is not None and x == f.value
    if isinstance(f, In):
        return lambda x: x is not None and x in f.value
    if isinstance(f, LessThan):
        return lambda x: x is not None and x < f.value
    if isinstance(f, GreaterThan):
        return lambda x: x is not None and x > f.value
    return None


class FrameSource(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = PushingReader if self.options.get("pushdown", "false").lower() == "true" else FrameReader
        return kind(schema, self.options["path"], int(self.options.get("sample", 12)), self.options.get("recursive", "false").lower() == "true")


class FrameReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, sample: int, recursive: bool):
        self.names, self.path, self.sample, self.recursive = schema.fieldNames(), path, sample, recursive
        self.filters: list[Filter] = []

    def _wants(self, column: str, value: object) -> bool:
        return all(_test(f)(value) for f in self.filters if f.attribute == (column,))

    def partitions(self) -> list[Animations]:
        store, root = _open(self.path)
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=self.recursive))
        paths = sorted(f.path for f in found if f.type == fs.FileType.File and f.extension.lower() in ("gif", "webp") and self._wants("media_id", f.path))
        return [Animations(paths[i : i + FILES_A_PARTITION]) for i in range(0, len(paths), FILES_A_PARTITION)] or [Animations([])]

    def read(self, partition: Animations) -> Iterator[tuple]:
        store, _ = _open(self.path)
        for path in partition.paths:
            yield from self._frames(path, store.open_input_stream(path).read())

    def _frames(self, path: str, content: bytes) -> Iterator[tuple]:
        from mediasift.functions.imagehash import hash_pixels
        from mediasift.sources.gif import Animation
        from mediasift.sources.webp import Picture

        row: dict[str, object] = {"media_id": path, "n_frames": 0}
        error, shown, asked = None, 0, False
        try:
            animation = Picture(content) if content[:4] == b"RIFF" else Animation(content)
            row |= {"n_frames": len(animation), "width": animation.width, "height": animation.height}
            for pos, idx in enumerate(sample_places(len(animation), self.sample)):
                if not (self._wants("pos", pos) and self._wants("idx", idx)):
                    continue
                asked = True
                frame = dict(row, pos=pos, idx=idx)
                if any(n in self.names for n in DECODED):
                    try:
                        pixels = animation.frame(idx)
                    except ValueError:
                        continue
                    frame |= {"pixels": pixels.tobytes(), "decoded": animation.decoded}
                    if "hash_hex" in self.names:
                        frame["hash_hex"] = hash_pixels(pixels)
                shown += 1
                yield tuple(frame.get(n) for n in self.names)
        except (ValueError, IndexError) as e:
            error = f"{type(e).__name__}: {e}"
        if not shown and (asked or not row["n_frames"]) and self._wants("pos", None) and self._wants("idx", None):
            row["load_error"] = error or "no frames"
            yield tuple(row.get(n) for n in self.names)


class PushingReader(FrameReader):
    """Takes the conditions that it can test; only where Spark's setting lets it."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if len(f.attribute) == 1 and f.attribute[0] in PUSHED and _test(f) is not None:
                self.filters.append(f)
            else:
                yield f


def register(spark: SparkSession) -> None:
    with _LOCK:
        if spark not in _KNOWN:
            spark.dataSource.register(FrameSource)
            _KNOWN.add(spark)


def read_frames(spark: SparkSession, path: str, sample: int = 12, recursive: bool = False, schema: str = SCHEMA) -> DataFrame:
    """Sampled frames of the animations below path."""
    register(spark)
    push = spark.conf.get(PUSHDOWN)
    return spark.read.format(FORMAT).schema(schema).option("pushdown", push).option("sample", sample).option("recursive", str(recursive).lower()).load(path)
