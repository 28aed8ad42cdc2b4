"""Operator 4: exact deduplication by progressive refinement.

Texts are equal when identical without ASCII white space. Documents are grouped by normalised length, then
by a hash of a prefix, then by SHA-256 of the whole normalised text; the full hash is computed only for
documents that still share length and prefix with another. Only narrow signatures are shuffled to be counted; hot
groups go by broadcast of their (bounded) heads.

Edge cases: null text counts as empty; all-white texts form one group; a repeated row (same id and text) is
one more member, of which exactly one row stays; an empty table gives an empty result; extra columns are
ignored by `duplicate_groups` and kept by `drop_duplicates`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.llm.common import attach_groups, materialise, strip_white, text_or_empty

PREFIX_CHARS = 256
PAIR = ["norm_len", "prefix_hash"]
KEYS = [*PAIR, "text_sha256"]


def _normal(docs: DataFrame, *kept: Column) -> DataFrame:
    """kept columns, n_code (code points of the text), norm_len, prefix_hash and _norm, the normalised text."""
    text = text_or_empty(docs)
    rows = docs.select(*kept, strip_white(text).alias("_norm"), F.char_length(text).alias("n_code"))
    return rows.withColumn("norm_len", F.octet_length("_norm")).withColumn("prefix_hash", F.xxhash64(F.substring("_norm", 1, PREFIX_CHARS)))


def _survivors(rows: DataFrame) -> DataFrame:
    """(norm_len, prefix_hash, n) that n > 1 of `rows` share, found length first."""
    sizes = rows.groupBy("norm_len").agg(F.count("*").alias("_n")).filter("_n > 1").select("norm_len")
    pairs = rows.groupBy(*PAIR).agg(F.count("*").alias("n")).filter("n > 1")
    return materialise(pairs.join(sizes, "norm_len", "left_semi"), "dedup-pairs")


def _heads(rows: DataFrame) -> DataFrame:
    """One row per group of at least two: its size and the row that stays (head_rows: rows equal to that one)."""
    same = rows.groupBy(*KEYS, "doc_id", "n_code").agg(F.count("*").alias("n"), F.min("_at").alias("at"))
    first = F.min(F.struct((-F.col("n_code")).alias("code"), F.col("doc_id").isNull().alias("z"), "doc_id", "at", "n"))
    heads = same.groupBy(*KEYS).agg(F.sum("n").alias("group_size"), first.alias("h")).filter("group_size > 1")
    return materialise(heads.select(*KEYS, "group_size", F.col("h.doc_id").alias("head_id"), (-F.col("h.code")).alias("head_code"), F.col("h.at").alias("head_at"), F.col("h.n").alias("head_rows")), "dedup-heads")


def duplicate_groups(docs: DataFrame, digest_all: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    text_sha256 is null for documents that no other shares length and prefix with, unless digest_all, which takes
    the full hash of all texts as they are read.
    """
    digest = F.sha2(F.col("_norm"), 256)
    normal = _normal(docs, docs["doc_id"].cast("long").alias("doc_id"))
    narrow = ["doc_id", "n_code", *PAIR]
    if digest_all:
        rows = materialise(normal.select(*narrow, digest.alias("text_sha256"), F.monotonically_increasing_id().alias("_at")), "dedup-rows")
        pairs = _survivors(rows)
        shared = rows.join(pairs.drop("n"), PAIR, "left_semi")
    else:
        pairs = _survivors(materialise(normal.select(*PAIR), "dedup-signatures"))
        marked = attach_groups(normal, pairs, PAIR, "n", docs.count()).select(*narrow, F.when(F.col("n").isNotNull(), digest).alias("text_sha256"))
        rows = materialise(marked.withColumn("_at", F.monotonically_increasing_id()), "dedup-rows")
        shared = rows.filter("text_sha256 is not null")
    joined = attach_groups(rows, _heads(shared), KEYS, "group_size", rows.count())
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("head_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("head_at") == F.col("_at"))).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, all columns kept.

    Rows are shuffled once, to what is known of their length and prefix, and written; those that share both with
    another are hashed whole and meet the heads of their groups.
    """
    names = docs.columns
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("_row")
    pairs = _survivors(materialise(_normal(docs).select(*PAIR), "dedup-signatures"))
    total = docs.count()
    keyed = _normal(docs, whole, docs["doc_id"].cast("long").alias("doc_id")).drop("_norm")
    marked = attach_groups(keyed, pairs, PAIR, "n", total)
    marked = materialise(marked, "dedup-marked")
    text = F.coalesce(F.col("_row")[f"c{names.index('text')}"], F.lit(""))
    shared = marked.filter("n is not null").withColumn("text_sha256", F.sha2(strip_white(text), 256))
    heads = _heads(shared.select(*KEYS, "doc_id", "n_code", F.lit(0).alias("_at")))
    joined = attach_groups(shared, heads, KEYS, "group_size", total)
    first = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("n_code") == F.col("head_code"))
    kept = joined.filter(F.col("group_size").isNull() | first)
    if heads.filter("head_rows > 1").limit(1).count():  # the row that stays is itself repeated
        kept = kept.filter(F.coalesce("head_rows", F.lit(1)) == 1).unionByName(kept.filter("head_rows > 1").dropDuplicates(KEYS))
    out = marked.filter("n is null").select("_row").unionByName(kept.select("_row"))
    return out.select(*[F.col("_row")[f"c{i}"].alias(c) for i, c in enumerate(names)])
