"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next.

Every stage takes documents (doc_id, text, lang, source and any other columns, whatever they are called) and returns
rows of the same columns, but for the last. Null and empty texts: rejected by the first stage (no letter to tell a
language by). Rows without doc_id: kept by every stage. Repeated rows and texts that are equal but for white space:
the second stage keeps one. Rows without source: a source of their own. Very long texts are read whole by every
stage. An empty table gives no rows in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mediasift.llm import language
from mediasift.llm.common import materialise, unused_names
from mediasift.llm.exact_dedup import drop_duplicates
from mediasift.llm.mixing import ADDED, in_order, mix, written_order
from mediasift.llm.packing import pack_documents
from mediasift.llm.shingle_dedup import keep_one_similar


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the identifier, learned from the labelled rows, does not reject."""
    added = unused_names(docs, language.ADDED)
    found = language.identify(docs, language.fit(docs), added)
    return found.filter(~found[added[2]]).drop(*added)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles of Jaccard similarity 0.8 or more."""
    return keep_one_similar(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that gives every source its tempered weight all along."""
    added = unused_names(docs, ADDED)
    return in_order(mix(docs, added=added), added)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens, which are numbered in the mixture's order."""
    (place,) = unused_names(docs, ("position",))
    return pack_documents(written_order(docs, place), public_tokenizers.path("byte_bpe_50k.json"), 1024, 2, place)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("mixing", mixed),
    ("best_fit_packing", packed),
]

#: Language models and BPE can't be expressed in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
