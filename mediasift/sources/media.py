"""Media scans: listing inputs, reading images, exploding animations into frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.functions.columns import IMAGE_EXTENSIONS, is_image_path
from mediasift.functions.imagehash import hash_pixels
from mediasift.sources.gif import Animation

MEDIA = "media_id string, path string, name string, source_kind string, length bigint, load_error string"
HASHES = "media_id string, n_frames int, pos int, idx int, hash_hex string, load_error string"


def _status(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(p) if fs.exists(p) else None


def list_media(spark: SparkSession, source: str, recursive: bool = False) -> DataFrame:
    """Inputs below source in order of path: a URL is itself, a folder its image files, anything else itself.

    What does not exist is a row with a load_error, not a failure of the run. Only names are read.
    """
    name = source.rstrip("/").rsplit("/", 1)[-1]
    if source.lower().startswith(("http://", "https://")):
        return spark.createDataFrame([(source, source, name, "url", None, None)], MEDIA)
    status = _status(spark, source)
    if status is None:
        return spark.createDataFrame([(source, source, name, "file", None, "FileNotFoundError")], MEDIA)
    if not status.isDirectory():
        return spark.createDataFrame([(source, source, name, "file", status.getLen(), None)], MEDIA)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(source).select("path", "length")
    files = files.filter(is_image_path(F.col("path")))
    if not recursive:
        base = status.getPath().toString().rstrip("/")
        files = files.filter(~F.substring(F.col("path"), len(base) + 2, 1 << 20).contains("/"))
    return files.select(F.regexp_replace("path", "^file:/+", "file:/").alias("media_id"), "path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.lit("file").alias("source_kind"), "length", F.lit(None).cast("string").alias("load_error")).orderBy("path")


def read_images(spark: SparkSession, source: str, recursive: bool = False) -> DataFrame:
    """Decoded stills (JPEG, PNG, GIF, BMP, TIFF; first frame) by the image source; unreadable files keep a row."""
    pattern = "*.{" + ",".join(x for e in IMAGE_EXTENSIONS for x in (e[1:], e[1:].upper())) + "}"
    rows = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(source)
    error = F.when(F.col("image.width") <= 0, "undecodable")
    # The two sources spell local paths with one slash and with three.
    origin = F.regexp_replace("image.origin", "^file:/+", "file:/")
    return rows.select(origin.alias("media_id"), "image", error.alias("load_error"))


def sample_places(n: int, sample: int) -> list[int]:
    """Places of an even sample of n frames; all of them if they are few or sample <= 1."""
    if n <= sample or sample <= 1:
        return list(range(n))
    return sorted({round(j * (n - 1) / (sample - 1)) for j in range(sample)})


def animation_hashes(files: DataFrame, sample: int = 12) -> DataFrame:
    """Hashes of sampled frames of GIF contents (media_id, content), one row a frame; unreadable ones an error row.

    Only sampled frames, and those that their pictures depend on, are decoded; sampled ones that can't be are left out.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for media_id, content in zip(frame["media_id"], frame["content"], strict=True):
                found, error = [], None
                try:
                    animation = Animation(content)
                    for pos, idx in enumerate(sample_places(len(animation), sample)):
                        try:
                            found.append((media_id, len(animation), pos, idx, hash_pixels(animation.frame(idx)), None))
                        except ValueError:
                            continue
                except (ValueError, IndexError) as e:
                    error = f"{type(e).__name__}: {e}"
                rows += found or [(media_id, 0, None, None, None, error or "no frames")]
            yield pd.DataFrame(rows, columns=["media_id", "n_frames", "pos", "idx", "hash_hex", "load_error"]).astype({"pos": "Int32", "idx": "Int32"})

    return files.select("media_id", "content").mapInPandas(decode, HASHES)
