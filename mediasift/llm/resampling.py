"""Importance resampling towards a target text collection, each distinct text weighed once.

Features of a text are all runs of one to `LONGEST` consecutive words (A-Z lower-cased; words are runs of letters,
digits and whatever is not ASCII), repeats counted, hashed into `buckets` buckets by their CRC-32. A bucket's gain is
the scaled logarithm of its smoothed share in the target against its share in the documents, a text's weight the sum
of its features' gains, and a document's score its weight plus Gumbel noise that follows from seed and doc_id. The
highest scores are then a sample without replacement in proportion to the weights.

Documents are grouped by their full text first. A text's features are computed once, counted as often as it has
copies, and weighed once; weights come back to the documents by the text's SHA-256 before the noise is added. Texts of
many copies (one may hold a third of the rows) come back by broadcast, a bounded number of them. Ranks come from one
range sort by (score, doc_id) and the sizes of its partitions.

Null and empty texts, and texts without a word: no features, weight 0. Repeated rows are documents of their own; rows
without doc_id share the noise of an empty id and come last among equal scores. Very long texts are featured whole.
Other columns are ignored, whatever they are called. An empty table gives no rows; an empty target gives gains that
follow from smoothing alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasift.llm.common import attach_groups, discard, materialise

#: Words in the longest feature, buckets, least words of a document that may be drawn.
LONGEST, BUCKETS, LEAST_WORDS = 3, 10_000, 20
#: Rows of a sorted partition; a row has five numbers.
SORT_ROWS = 4_000_000
#: Tasks that add up the counts of all others; the driver adds up theirs.
MERGE_TASKS = 32
#: Letters become lower case, other ASCII but digits becomes a space; bytes from 128 on belong to words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

FEATURES = "key binary, copies long, n_words long, n_features long, features binary"


def _bucket_type(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def feature_buckets(text: str, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """(words, the bucket of every feature) of a text."""
    words = text.encode().translate(WORD_BYTES).split()
    found = runs = list(map(crc32, words))
    spaced = [b" " + w for w in words]
    for n in range(1, LONGEST):
        runs = list(map(crc32, spaced[n:], runs))  # each run goes on with the next word
        found = found + runs
    return len(words), (np.array(found, np.uint32) % buckets).astype(_bucket_type(buckets))


def text_features(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """texts (text, copies) as key (SHA-256 of the text), copies, n_words, n_features, features (a bucket each)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                got = [feature_buckets(t.as_py(), buckets) for t in part.column(1)]
                columns = [part.column(0), part.column(2), pa.array([n for n, _ in got], pa.int64()), pa.array([len(f) for _, f in got], pa.int64()), pa.array([f.tobytes() for _, f in got], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "copies", "n_words", "n_features", "features"])

    return texts.select(F.unhex(F.sha2("text", 256)).alias("key"), "text", "copies").mapInArrow(compute, FEATURES)


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features by bucket over all copies: a row of counts a task, added up by MERGE_TASKS tasks and then here."""
    kind = _bucket_type(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            copies = b.column(0).to_numpy()
            for n in np.unique(copies):  # rows of equal copies are counted at once
                held = b.column(1).filter(pa.array(copies == n))
                total += n * np.bincount(np.frombuffer(b"".join(x.as_py() for x in held), kind), minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((np.frombuffer(x.as_py(), np.int64) for b in batches for x in b.column(0)), np.zeros(buckets, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    counted = features.select("copies", "features").mapInArrow(count, "counts binary").repartition(MERGE_TASKS).mapInArrow(add, "counts binary")
    return sum((np.frombuffer(r["counts"], np.int64) for r in counted.collect()), np.zeros(buckets, np.int64))


def bucket_gains(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The gain of each bucket, in thousandths: how much more often the target (t) has it than the documents (s)."""
    buckets, whole_s, whole_t = len(s), int(s.sum()), int(t.sum())
    ratio = ((t + 1.0) * (whole_s + buckets)) / ((s + 1.0) * (whole_t + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """key, copies, n_words, n_features and weight of each distinct text."""
    kind = _bucket_type(len(gains))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weight = [int(gains[np.frombuffer(x.as_py(), kind)].sum()) for x in b.column(4)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(weight, pa.int64())], ["key", "copies", "n_words", "n_features", "weight"])

    return features.mapInArrow(compute, "key binary, copies long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, total: int, out: str = "rank") -> DataFrame:
    """rows with their place from 1 by (score descending, doc_id): one range sort, then the sizes of its partitions.

    Written before it is numbered; rows equal in both are told apart by nothing else that they hold.
    """
    parts = max(1, min(-(-total // SORT_ROWS), 100_000))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed, "ranked").withColumn("_part", F.shiftright("_at", 33))
    sizes = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())  # a row a partition
    first = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    before = placed.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, first, strict=False)], "_part long, _before long")
    place = F.col("_before") + F.col("_at") - F.shiftleft("_part", 33) + 1
    return placed.join(F.broadcast(before), "_part").select(*rows.columns, place.alias(out))


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), seed: int = 42, least_words: int = LEAST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """Every document of docs (doc_id, text): doc_id, n_words, n_features, weight, score and rank, null where it isn't drawn.

    share (a, b) draws floor(a * N / b) of the N documents that have least_words words. target has a column text.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
    texts = rows.groupBy("text").agg(F.count("*").alias("copies"))
    features = materialise(text_features(texts, buckets), "features")
    aims = target.select(F.coalesce(target["text"].cast("string"), F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    gains = bucket_gains(bucket_counts(features, buckets), bucket_counts(text_features(aims, buckets), buckets))
    weights = materialise(weigh(features, gains), "weights")
    discard(features)
    total, drawable = weights.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("n_words") >= least_words, F.col("copies"))), F.lit(0))).first()
    keyed = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("key"))
    known = attach_groups(keyed, weights, ["key"], "copies", total)
    drawn_by = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn_by + 0.5) / 4294967296.0)))
    scored = known.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))
    scored = materialise(scored, "scores")
    discard(weights)
    may = F.col("n_words") >= least_words
    k = share[0] * drawable // share[1]
    chosen = ranked(scored.filter(may), drawable).withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return chosen.unionByName(scored.filter(~may).withColumn("rank", F.lit(None).cast("long")))
