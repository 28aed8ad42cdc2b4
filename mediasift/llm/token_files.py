"""Operator 3: token ids in a compressed binary format (Re-Pair), with random access to documents.

Documents are dealt by ranges of doc_id, encoded, and written in ascending doc_id order. A shard is cut into
blocks of whole documents; each block has its own grammar. Re-Pair runs in bulk rounds: the most frequent
pairs of neighbouring symbols (never across documents) are replaced by new ones, left to right without overlap,
and the rounds repeat until no pair occurs LEAST_COUNT times; rules nest freely. A block stores its rules, the expansion length of each rule,
the symbols, and where each document starts among symbols and among ids, so one document is decoded without
the others. Blocks are rows of a table, so that any store that Spark writes can hold them.

Block layout (little-endian): b"RPT1", then as uint32 the width of a symbol in bits, the first rule
id, and the numbers of rules, documents and symbols; then rules (2 symbols each), expansion lengths (uint32),
starts among symbols (uint32, documents + 1), ids per document (uint32), symbols. Symbols are packed to bits.

Edge cases: null and empty texts hold only the end id; null doc_ids come first; repeated rows are stored once
each; an empty table gives no blocks and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.llm.common import bounded_parts, in_batches, prefix_sums, scratch
from mediasift.llm.tokens import PieceEncoder, with_end

MAGIC = b"RPT1"
BLOCK_TOKENS, ROWS_AT_ONCE, CACHED_PIECES = 2_000_000, 500, 600_000
RULES_A_ROUND, LEAST_COUNT, TABLE_BITS = 8192, 8, 20
TASK_BYTES, MOST_TASK_BYTES, SEARCHED = 24 << 20, 1 << 30, 100_000
BLOCKS = "shard int, block int, doc_ids array<bigint>, n_tokens long, payload binary"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def compress(ids: np.ndarray, at: np.ndarray, vocabulary: int, least: int = LEAST_COUNT) -> bytes:
    """One block of documents ids[at[i]:at[i+1]]; `vocabulary` is above every id."""
    symbols, starts, sizes = ids.astype(np.uint32), at.astype(np.int64), np.diff(at)
    rules: list[np.ndarray] = []
    first = vocabulary
    since = 0  # symbols from here on are in no pair that has been counted; smaller ones only in pairs that are rare
    while len(symbols) > 1:
        left, right = symbols[:-1], symbols[1:]
        edges = starts[(starts > 0) & (starts < len(symbols))] - 1
        if since:
            new = np.flatnonzero(symbols >= since)
            near = np.zeros(len(left) + 1, bool)
            near[new] = True
            near[new[new > 0] - 1] = True
            near = near[:-1]
        else:
            cell = _cells(left, right)
            count = np.bincount(cell, minlength=1 << TABLE_BITS)
            near = (count >= least)[cell]
        near[edges] = False
        some = np.flatnonzero(near).astype(np.int32)  # every pair that is frequent, and few others
        wide = first > 1 << 16
        pairs = (left[some].astype(np.uint64) << np.uint64(32)) | right[some] if wide else (left[some] << np.uint32(16)) | right[some]
        code, count = np.unique(pairs, return_counts=True)
        code, count = code[count >= least], count[count >= least]
        if not len(code):
            break
        shift = code.dtype.type(32 if wide else 16)
        chosen = np.lexsort((code, -count))[:RULES_A_ROUND]
        code = np.sort(code[chosen]) if len(some) < SEARCHED else code[chosen]
        a, b = (code >> shift).astype(np.uint32), (code & ((code.dtype.type(1) << shift) - code.dtype.type(1))).astype(np.uint32)
        whole = len(chosen) < RULES_A_ROUND
        if len(some) < SEARCHED:
            rule = np.minimum(np.searchsorted(code, pairs), len(code) - 1).astype(np.uint32)
        else:
            own = _cells(a, b)
            _, alone = np.unique(own, return_index=True)  # pairs that share a cell with a more frequent one wait for the next round
            alone.sort()
            whole &= len(alone) == len(code)
            code, a, b, own = code[alone], a[alone], b[alone], own[alone]
            table = np.zeros(1 << TABLE_BITS, np.uint32)
            table[own] = np.arange(len(code), dtype=np.uint32)
            rule = table[_cells(left[some], right[some])]
        hit = code[rule] == pairs
        place, rule = some[hit], rule[hit]
        turn = np.arange(len(place), dtype=np.int32)
        run = np.where(np.diff(place, prepend=np.int32(-2)) > 1, turn, np.int32(0))  # overlapping hits: take every other one
        take = (turn - np.maximum.accumulate(run)) % 2 == 0
        symbols[place[take]] = np.uint32(first) + rule[take]
        keep = np.ones(len(symbols), bool)
        keep[place[take] + 1] = False
        starts = np.searchsorted(np.flatnonzero(keep), starts).astype(np.int64)
        symbols = symbols[keep]
        rules.append(np.stack([a, b], 1))
        since = first if whole else 0
        first += len(code)
    grammar = np.concatenate([np.zeros((0, 2), np.uint32), *rules])
    width = max(1, (first - 1).bit_length())
    head = MAGIC + struct.pack("<5I", width, vocabulary, len(grammar), len(sizes), len(symbols))
    lengths = np.ones(len(grammar), np.int64)
    done = 0
    for r in rules:  # a round's rules are made of ids and of rules of earlier rounds
        lengths[done : done + len(r)] = np.where(r >= vocabulary, lengths[np.maximum(r.astype(np.int64) - vocabulary, 0)], 1).sum(axis=1)
        done += len(r)
    return b"".join([head, _pack(grammar, width), lengths.astype("<u4").tobytes(), starts.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), _pack(symbols, width)])


def _cells(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77)) >> np.uint32(32 - TABLE_BITS)


def _pack(symbols: np.ndarray, width: int) -> bytes:
    """The low `width` bits of each symbol, end to end."""
    return np.packbits(np.unpackbits(symbols.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little"), bitorder="little").tobytes()


def _unpack(raw: np.ndarray, width: int, n: int) -> np.ndarray:
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(raw, count=n * width, bitorder="little").reshape(n, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4")[:, 0]


def _expansions(rules: np.ndarray, first: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each rule stands for, end to end, and offsets; rules are opened level by level until ids are left."""
    at = np.concatenate([[0], np.cumsum(lengths)])
    symbols = np.arange(first, first + len(rules), dtype=np.int64)
    while (open_ := symbols >= first).any():
        n = np.where(open_, 2, 1)
        begin = np.cumsum(n) - n
        opened = np.empty(int(n.sum()), np.int64)
        opened[begin] = np.where(open_, rules[np.where(open_, symbols - first, 0), 0], symbols)
        opened[begin[open_] + 1] = rules[symbols[open_] - first, 1]
        symbols = opened
    return symbols.astype(np.uint32), at


class Block:
    """A read block; `document(i)` decodes one document, `all()` every one."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a block of this format")
        width, self.first, n_rules, self.n, n_symbols = struct.unpack_from("<5I", payload, 4)
        at, take = 24, []
        for bits, n in ((width, 2 * n_rules), (32, n_rules), (32, self.n + 1), (32, self.n), (width, n_symbols)):
            size = -(-bits * n // 8)
            raw = np.frombuffer(payload, np.uint8, size, at)
            take.append(_unpack(raw, bits, n) if bits < 32 else raw.view("<u4"))
            at += size
        rules, self.starts, self.sizes, self.symbols = take[0], *take[2:]
        self.lengths = take[1].astype(np.int64)
        self.flat, self.at = _expansions(rules.reshape(-1, 2).astype(np.int64), self.first, self.lengths)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        s = symbols.astype(np.int64)
        ruled = s >= self.first
        r = np.where(ruled, s - self.first, 0)
        size = np.where(ruled, self.lengths[r] if len(self.lengths) else 1, 1)
        ends = np.cumsum(size)
        flat = np.concatenate([self.flat, s[~ruled].astype(np.uint32)])
        begin = np.where(ruled, self.at[r], len(self.flat) + np.cumsum(~ruled) - 1)
        return flat[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols[self.starts[i] : self.starts[i + 1]])

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        return self.expand(self.symbols), np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, vocabulary: int = 50_257) -> None:
    """Encode docs in ascending doc_id order and write the blocks below path."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard, block = PieceEncoder.of(tokenizer, CACHED_PIECES), TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([x[1] for x in held])
            sizes = np.concatenate([np.diff(x[2]) for x in held])
            at = np.concatenate([[0], np.cumsum(sizes)])
            doc_ids = pa.concat_arrays([x[0] for x in held])
            lists = pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), lists, pa.array([len(ids)], pa.int64()), pa.array([compress(ids, at, vocabulary)], pa.binary())], ["shard", "block", "doc_ids", "n_tokens", "payload"])

        for b in batches:
            for i in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(i, ROWS_AT_ONCE)
                ids, at = with_end(*encoder.encode(part.column(1)), end_id)
                held.append((part.column(0), ids, at))
                tokens += len(ids)
                if tokens >= BLOCK_TOKENS:
                    yield flush()
                    held, tokens, block = [], 0, block + 1
        if held:
            yield flush()

    size = docs.agg(F.sum(F.octet_length(docs["text"].cast("string")).cast("long"))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, bounded_parts(size, TASK_BYTES, MOST_TASK_BYTES))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), F.monotonically_increasing_id().alias("_at"))
    ranged = rows.repartitionByRange(parts, "doc_id", "_at").sortWithinPartitions("doc_id", "_at").select("doc_id", "text")
    in_batches(ranged).mapInArrow(encode, BLOCKS).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files at path: doc_id, start, n_tokens, ids_crc32, decoded from the blocks."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sizes = blocks.select(F.lit(0).alias("_all"), "shard", "block", "n_tokens")
    starts = prefix_sums(sizes, ["_all"], [F.col("shard"), F.col("block")], F.col("n_tokens"), "first", 0, bucket=F.col("shard")).select("shard", "block", "first")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, at = Block(b.column(1)[i].as_py()).all()
                ids = ids.astype("<u4", copy=False)
                crc = np.fromiter((zlib.crc32(ids[j:k]) for j, k in zip(at[:-1], at[1:], strict=True)), np.int64, len(at) - 1)
                yield pa.RecordBatch.from_arrays([b.column(0)[i].values, pa.array(at[:-1] + b.column(2)[i].as_py()), pa.array(np.diff(at)), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.join(starts, ["shard", "block"]).select("doc_ids", "payload", "first").mapInArrow(decode, DOCS)


def token_documents(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write docs' token files to the shared folder and return what they hold."""
    path = scratch(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path)
