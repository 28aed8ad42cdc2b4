"""Operator 1: best-fit packing of documents into sequences of a fixed capacity.

Bulk-synchronous best fit (decreasing) over runs. Pieces are sorted by length; equal lengths form a run, and equal
gaps form a run as well. One superstep takes one run of pieces: it looks for the smallest gap that holds them (the
successor among the runs of gaps), as many pieces as there are gaps take one each, in order of rank, those gaps shrink,
and the run goes on until it is placed; what no gap holds opens new sequences. Lengths and gaps are whole
numbers up to the capacity, so there are at most capacity runs of each however many pieces there are, and `plan` takes
the supersteps on the driver over counts alone: a superstep over rows would move all pieces and gaps for each of up to
capacity lengths. What grows with the pieces is distributed: ranks are counted by many tasks, and every piece finds its
place by a successor search in the list of rank intervals, which each task sweeps for its own rows. The
result has as many sequences as sequential best-fit-decreasing.

Pieces are ranked by a hash, or by a column that the caller names as `position`: equal lengths are then placed
in its order and sequences are numbered by the position of their first piece.

Edge cases: null and empty texts hold only the end id; a document longer than the capacity is cut into
pieces of the capacity, of which the first may be shorter; repeated rows are packed once each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasift.llm.common import in_batches, materialise, prefix_sums, tidy
from mediasift.llm.tokens import PieceEncoder, with_end

POSITION_BITS = 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RANK_BITS, ROWS_AT_ONCE = 44, 500


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, position: str | None = None) -> DataFrame:
    """Documents as pieces of at most `capacity` ids: doc_id, piece, start, length, ids_crc32 (and position, if docs' column `position` gives one)."""
    ordered = ["position"] if position else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(tokenizer)
        for b in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
            ids, at = with_end(*encoder.encode(b.column(1)), end_id)
            sizes = np.diff(at)
            short = sizes % capacity
            n = sizes // capacity + (short > 0)
            doc = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            first = np.where(short > 0, short, capacity)[doc]
            start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
            length = np.where(piece == 0, first, capacity)
            begin = at[doc] + start
            ids = ids.astype("<u4", copy=False)
            crc = np.fromiter((zlib.crc32(ids[i:j]) for i, j in zip(begin, begin + length, strict=True)), np.int64, len(doc))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc), *[b.column(2).take(pa.array(doc)) for _ in ordered]], ["doc_id", "piece", "start", "length", "ids_crc32", *ordered])

    return in_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *[docs[position].cast("long").alias(c) for c in ordered])).mapInArrow(tidy(cut), PIECES + "".join(f", {c} long" for c in ordered))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Places for `counts[length]` pieces of each length.

    Returns (length, first rank, number of ranks, first sequence, offset): ranks of a length that go to as
    many consecutive sequences, at the same offset in each.
    """
    gaps: dict[int, deque[tuple[int, int]]] = {}
    sizes: list[int] = []
    out, sequences = [], 0

    def add(size: int, first: int, n: int) -> None:
        if size <= 0 or n <= 0:
            return
        if size not in gaps:
            gaps[size] = deque()
            insort(sizes, size)
        gaps[size].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            i = bisect_left(sizes, length)
            if i == len(sizes):
                break
            size = sizes[i]
            first, n = gaps[size].popleft()
            take = min(n, left)
            if take < n:
                gaps[size].appendleft((first + take, n - take))
            if not gaps[size]:
                del gaps[size]
                sizes.pop(i)
            out.append((length, rank, take, first, capacity - size))
            add(size - length, first, take)
            rank, left = rank + take, left - take
        if left:  # no gap holds them: open sequences, each filled with as many as it holds
            per = capacity // length
            full, rest = divmod(left, per)
            for k in range(per if full else 0):
                out.append((length, rank, full, sequences, k * length))
                rank += full
            add(capacity - per * length, sequences, full)
            sequences += full
            for k in range(rest):
                out.append((length, rank, 1, sequences, k * length))
                rank += 1
            if rest:
                add(capacity - rest * length, sequences, 1)
                sequences += 1
    return out


def pack(pieces: DataFrame, capacity: int, position: str | None = None) -> DataFrame:
    """pieces (doc_id, piece, length, …) with sequence_id and offset, in the order of `position` if that is given. The input should be a written table."""
    counts = {int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    if any(size > capacity or size < 1 for size in counts):
        raise ValueError("a piece is empty or longer than the capacity")
    rows = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    key, sequence, offset = (rows[:, 0] << RANK_BITS) + rows[:, 1], rows[:, 3], rows[:, 4]
    names = pieces.columns
    order = [F.col(position or "doc_id"), F.col("piece")]
    bucket = F.shiftright(F.col(position), POSITION_BITS) if position else None
    ranked = prefix_sums(pieces, ["length"], order, F.lit(1), "_rank", sum(counts.values()), bucket=bucket).select(*names, "_rank")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column(b.num_columns - 1).to_numpy()
            length = b.column(names.index("length")).to_numpy()
            i = np.searchsorted(key, (length.astype(np.int64) << RANK_BITS) + rank, "right") - 1
            place = sequence[i] + rank - rows[i, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(place), pa.array(offset[i])], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    placed = ranked.mapInArrow(sweep, f"{fields}, sequence_id long, offset long")
    if not position:
        return placed
    placed = materialise(placed, "placed")
    heads = placed.filter("offset = 0").select("sequence_id", "piece", position, F.lit(0).alias("_all"))
    numbers = prefix_sums(heads, ["_all"], order, F.lit(1), "_number", 0, bucket=bucket).select("sequence_id", "_number")
    return placed.join(numbers.hint("merge"), "sequence_id").select(*[c for c in names if c != position], F.col("_number").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, position: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of every document."""
    return pack(materialise(token_pieces(docs, tokenizer, capacity, end_id, position), "pieces"), capacity, "position" if position else None)
