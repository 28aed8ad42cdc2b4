"""List files: hashes with labels, and ordered text patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.functions.columns import bits_of_hex
from mediasift.operators.text import usable_patterns
from mediasift.sources.store import add_entries, first_entries, read_entries


def parse_hash_lines(lines: DataFrame, line_no: Column, text: Column, default_label: str) -> DataFrame:
    """Entries (line_no, hex, label, hex_len, bits) of `hex[,label]` lines; blanks, # lines and other text go.

    bits is null for hashes that aren't 16 digits; they never match a 16-digit hash.
    """
    t = F.trim(F.regexp_replace(text, r"[\r\n]+$", ""))
    hexed = F.lower(F.trim(F.substring_index(t, ",", 1)))
    given = F.trim(F.regexp_extract(t, r"^[^,]*,(.*)$", 1))
    rows = lines.select(line_no.alias("line_no"), t.alias("t"), hexed.alias("hex"), F.when(given != "", given).otherwise(F.lit(default_label)).alias("label"))
    rows = rows.filter((F.col("t") != "") & ~F.col("t").startswith("#") & F.col("hex").rlike("^[0-9a-f]+$"))
    return rows.select("line_no", "hex", "label", F.length("hex").alias("hex_len"), bits_of_hex(F.col("hex")).alias("bits"))


def read_hash_list(spark: SparkSession, path: str, default_label: str) -> DataFrame:
    """A list file; a missing one is an empty list."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "line_no bigint, hex string, label string, hex_len int, bits bigint")
    lines = spark.read.text(path)
    return parse_hash_lines(lines, F.monotonically_increasing_id(), F.col("value"), default_label)


def append_hashes(entries: DataFrame, path: str) -> None:
    """Insert (hex, label) rows into a list store; any number of writers at a time, the first entry of a hash holds."""
    add_entries(entries.select(F.lower("hex").alias("hex"), "label"), path, 10_000)


def read_hash_store(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a list store, as read_hash_list gives them; line_no is their order."""
    held = first_entries(read_entries(spark, path, "hex string, label string"), ["hex"])
    return held.select(F.col("seq").alias("line_no"), "hex", "label", F.length("hex").alias("hex_len"), bits_of_hex(F.col("hex")).alias("bits"))


def read_patterns(spark: SparkSession, path: str, strip_prefix: bool = False) -> list[str]:
    """Patterns of a small list file, in order, checked on the driver."""
    return usable_patterns([r["value"] for r in spark.read.text(path, wholetext=False).collect()], strip_prefix)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """A result cache in a JSON object file as (key, seq, scores); a missing or unreadable file is an empty cache."""
    schema = "key string, seq bigint, scores map<string,double>"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    entries = F.from_json("value", "map<string,struct<scores:map<string,double>>>")
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.map_entries(entries)).alias("seq", "e"))
    return rows.select(F.col("e.key").alias("key"), F.col("seq").cast("bigint").alias("seq"), F.col("e.value.scores").alias("scores"))
