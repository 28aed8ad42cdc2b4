"""Operator 9: scoring by an interpolated modified Kneser-Ney bigram model, counted in Spark over all training text.

Words are the runs of other than ASCII white space after lower-casing A-Z; one end token closes a text and a
start context opens it. Words and word pairs are known by 64-bit hashes. Each task counts the pairs of its
documents and sends them, sorted and counted, to the shard of their context; contexts that a sample shows to
be frequent are split further by the second word, so that no shard grows with one word. A shard writes its
pairs as a sorted hash array to a file in the shared folder; counts of words, of the contexts before them
(continuation counts) and of what follows them as contexts meet by word and become files as well. The model covers all training text:
nothing is pruned.

Scoring reads each file once, however many documents there are: a batch of documents sends its distinct pairs
and words to the shards that hold them; a task maps the file of a shard into memory (reads it where the
shared folder is not a mounted file system) and answers the batches one after the other; the answers of a batch become
a file, and a second pass over the documents adds them up. So what is moved grows with the documents, not with
documents times model.

p(w|h) = max(c(hw)-D(c(hw)), 0)/c(h) + g(h) p(w);  p(w) = max(n(w)-D'(n(w)), 0)/n + g' / (V+1), where n(w)
is the number of contexts before w; D and D' are the three modified discounts from counts of counts.

Edge cases: null and empty texts hold the end token only; repeated rows count as often as they occur; without
training text every token has probability 1/(V+1) = 1; an empty table gives no rows; other columns are ignored.
Documents to score should be a scan or a written table: they are read twice and must come in the same order.
"""

from __future__ import annotations

import array
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.llm.common import discard, in_batches, materialise, release_shuffles, scratch, worker_cache

SHARD_BYTES = 16 << 20
FLUSH_TOKENS, CACHE_WORDS = 2_000_000, 100_000
HOT_SAMPLE, HOT_BYTES, HOT_WORDS, HOT_SPLIT = 500, 4000, 1024, 64
#: Counts of pairs are stored in a byte; those from here on apart.
OFTEN = 255
START = np.uint64(0x5354415254)
END = np.uint64(0x454E44)

COUNTS = "shard int, contexts binary, words binary, numbers binary"
QUESTIONS = "batch string, mark long, shard int, a binary"
PARTS = "kind int, shard int, a binary, b binary, c binary, stats array<bigint>"
SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _mix(h * np.uint64(0x9E3779B97F4A7C15) + _mix(w))


class Words(dict):
    """Hashes of words by slot; one lives in each Python worker, emptied when it holds CACHE_WORDS."""

    def __init__(self):
        from xxhash import xxh64_intdigest

        self.digest, self.hashes = xxh64_intdigest, array.array("Q")

    def __missing__(self, word: bytes) -> int:
        self[word] = slot = len(self)
        self.hashes.append(self.digest(word, 9))
        return slot

    @classmethod
    def read(cls, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(word hashes of all texts end to end, each with its end token; tokens of each text)."""
        known = worker_cache("words", cls)
        if len(known) > CACHE_WORDS:
            known.clear()
            known.hashes = array.array("Q")
        look, parts, sizes = known.__getitem__, [], []
        for t in texts:
            words = (t or "").encode().lower().split()
            parts.append(np.fromiter(map(look, words), np.int64, len(words)))
            sizes.append(len(words) + 1)
        sizes = np.array(sizes, np.int64)
        out = np.empty(int(sizes.sum()), np.uint64)
        ends = np.cumsum(sizes) - 1
        mask = np.ones(len(out), bool)
        mask[ends] = False
        out[mask] = np.frombuffer(known.hashes, np.uint64)[np.concatenate(parts)] if len(known) and parts else 0
        out[ends] = END
        return out, sizes


def _contexts(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    h = np.concatenate([[START], tokens[:-1]]).astype(np.uint64)
    h[np.cumsum(sizes) - sizes] = START
    return h


@dataclass
class Plan:
    """How pairs are dealt to shards."""

    shards: int
    flush: int = FLUSH_TOKENS
    often: int = OFTEN
    hot: np.ndarray = field(default_factory=lambda: np.array([START]))

    def shard(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.hot, h), len(self.hot) - 1)
        h = np.where(self.hot[i] == h, h + _mix(w) % np.uint64(HOT_SPLIT), h)
        return ((_mix(h) >> np.uint64(20)) % np.uint64(self.shards)).astype(np.int64)

    def word_shard(self, w: np.ndarray) -> np.ndarray:
        return ((_mix(w) >> np.uint64(20)) % np.uint64(self.shards)).astype(np.int64)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first position of each run, number of runs + 1 boundaries) of sorted keys."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return first, np.append(first, len(keys))


def _sum_pairs(h: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs with summed counts, sorted by key: key, h, w, c."""
    key = pair_keys(h, w)
    order = np.argsort(key, kind="stable")
    first, _ = _groups(key[order])
    return key[order][first], h[order][first], w[order][first], np.add.reduceat(c[order], first) if len(first) else c[:0]


def _count(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def flush() -> pa.RecordBatch:
        h, w = (np.concatenate([x[k] for x in held]) for k in range(2))
        _, h, w, c = _sum_pairs(h, w, np.ones(len(h), np.int64))
        shard = plan.shard(h, w)
        order = np.lexsort((h, shard))
        shard, h, w, c = shard[order], h[order], w[order], c[order]
        first, bounds = _groups(shard)
        out: dict[str, list] = {k: [] for k in ("shard", "contexts", "words", "numbers")}
        for i, j in zip(first.tolist(), bounds[1:].tolist(), strict=True):
            at, ends = _groups(h[i:j])
            words, of = np.unique(w[i:j], return_inverse=True)
            for k, v in zip(out, (int(shard[i]), _pack_keys(h[i:j][at]), _pack_keys(words), _slim([np.diff(ends), of, c[i:j]])), strict=True):
                out[k].append(v)
        return pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k != "shard" else pa.int32()) for k, v in out.items()], list(out))

    for b in batches:
        for i in range(0, b.num_rows, 500):
            tokens, sizes = Words.read(b.column(0).slice(i, 500).to_pylist())
            held.append((_contexts(tokens, sizes), tokens))
            n += len(tokens)
            if n >= plan.flush:
                yield flush()
                held, n = [], 0
    if held:
        yield flush()


def _width(a: np.ndarray) -> int:
    """The fewest bytes that hold every number of a."""
    return next(w for w in (1, 2, 4, 8) if w == 8 or not len(a) or a.max() < 1 << 8 * w)


def _slim(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers, each in the fewest bytes a number and compressed."""
    out = []
    for c in columns:
        raw = c.astype(f"<u{(w := _width(c))}").tobytes()
        small = pa.compress(raw, "lz4", asbytes=True) if raw else b""
        out += [np.array([w, len(c), len(small)], "<u4").tobytes(), small]
    return b"".join(out)


def _unslim(raw: bytes) -> list[np.ndarray]:
    at, out = 0, []
    while at < len(raw):
        width, n, size = np.frombuffer(raw, "<u4", 3, at).tolist()
        data = pa.decompress(raw[at + 12 : at + 12 + size], width * n, "lz4", asbytes=True) if n else b""
        out.append(np.frombuffer(data, f"<u{width}").astype(np.int64))
        at += 12 + size
    return out


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending hashes as differences of as many bits as the widest needs."""
    if not len(keys):
        return b""
    steps = np.diff(keys).astype("<u8")
    width = max(1, int(steps.max()).bit_length()) if len(steps) else 1
    bits = np.unpackbits(steps.view(np.uint8).reshape(-1, 8), axis=1, count=width, bitorder="little")
    return np.array([len(keys), width], "<u4").tobytes() + keys[:1].astype("<u8").tobytes() + np.packbits(bits, bitorder="little").tobytes()


def _unpack_keys(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    n, width = np.frombuffer(raw, "<u4", 2).tolist()
    bits = np.zeros((n - 1, 64), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(raw, np.uint8, offset=16), count=(n - 1) * width, bitorder="little").reshape(n - 1, width)
    steps = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return np.cumsum(np.concatenate([np.frombuffer(raw, "<u8", 1, 8), steps]), dtype=np.uint64)


def _store(root: str, name: str, arrays: list[np.ndarray]) -> None:
    """Write arrays to one file, first under a name of this attempt, so that a lost task leaves no half file."""
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(root)
    fs.create_dir(path, recursive=True)
    draft = f"{path}/.{name}-{uuid.uuid4().hex}"
    kept = [np.ascontiguousarray(a, f"<u{_width(a)}") for a in arrays]
    with fs.open_output_stream(draft) as out:
        out.write(np.array([len(kept), *[x for a in kept for x in (len(a), a.itemsize)]], "<i8").tobytes())
        for a in kept:
            out.write(a.data)
    fs.move(draft, f"{path}/{name}")


def _load(root: str, name: str) -> list[np.ndarray] | None:
    """The arrays of a file: mapped from a mounted file system, else read."""
    from pyarrow.fs import FileSystem, FileType, LocalFileSystem

    fs, path = FileSystem.from_uri(root)
    path = f"{path}/{name}"
    if isinstance(fs, LocalFileSystem):
        try:
            data = np.memmap(path, np.uint8, "r")
        except FileNotFoundError:
            return None
    else:
        if fs.get_file_info(path).type == FileType.NotFound:
            return None
        with fs.open_input_stream(path) as f:
            data = np.frombuffer(f.read(), np.uint8)
    n = int(data[:8].view("<i8")[0])
    shapes = data[8 : 8 + 16 * n].view("<i8").reshape(-1, 2)
    at, out = 8 + 16 * n, []
    for length, width in shapes.tolist():
        out.append(data[at : at + length * width].view(f"<u{width}"))
        at += length * width
    return out


def _shard_pairs(frame: pd.DataFrame, plan: Plan, root: str) -> pd.DataFrame:
    """Write a shard's pairs; return its words and contexts for the word shards, its counts of counts, and its parts of split contexts."""
    shard = int(frame["shard"].iloc[0])
    parts = []
    for contexts, words, numbers in zip(frame.contexts, frame.words, frame.numbers, strict=True):
        n, of, c = _unslim(numbers)
        parts.append((np.repeat(_unpack_keys(contexts), n), _unpack_keys(words)[of], c))
    key, h, w, c = _sum_pairs(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    del parts
    order = np.argsort(h, kind="stable")
    first, bounds = _groups(h[order])
    context, sorted_c = h[order][first], c[order]
    stats = [np.add.reduceat(x, first) for x in (sorted_c, (sorted_c == 1).astype(np.int64), (sorted_c == 2).astype(np.int64), (sorted_c > 2).astype(np.int64))]
    often = np.flatnonzero(c >= plan.often)
    _store(root, f"pairs-{shard}", [key, np.minimum(c, plan.often), often, c[often]])
    hot = np.isin(context, plan.hot)
    out = [(1, shard, b"", b"", b"", [int((c == k).sum()) for k in range(1, 5)])]
    out += [(2, shard, context[i : i + 1].tobytes(), b"", b"", [int(s[i]) for s in stats]) for i in np.flatnonzero(hot)]
    order = np.argsort(w, kind="stable")
    first, _ = _groups(w[order])
    word, before, times = w[order][first], np.diff(np.append(first, len(w))), np.add.reduceat(c[order], first)
    to = plan.word_shard(word)
    order = np.lexsort((word, to))
    word, before, times, to = word[order], before[order], times[order], to[order]
    first, bounds = _groups(to)
    out += [(3, int(to[i]), _pack_keys(word[i:j]), _slim([before[i:j], times[i:j]]), b"", None) for i, j in zip(first, bounds[1:], strict=True)]
    # All but START are words, and a word is a context as often as it stands: only the kinds of what follows are sent.
    context, stats, to = context[~hot], [s[~hot] for s in stats[1:]], plan.word_shard(context[~hot])
    order = np.lexsort((context, to))
    first, bounds = _groups(to[order])
    out += [(4, int(to[order[i]]), _pack_keys(context[order[i:j]]), _slim([s[order[i:j]] for s in stats]), b"", None) for i, j in zip(first, bounds[1:], strict=True)]
    return pd.DataFrame(out, columns=["kind", "shard", "a", "b", "c", "stats"])


def _shard_words(frame: pd.DataFrame, root: str) -> pd.DataFrame:
    """Write a shard's words with what is known of them as words and as contexts; return their totals."""
    of_words, of_contexts = frame[frame.kind == 3], frame[frame.kind == 4]
    w = np.concatenate([_unpack_keys(x) for x in of_words.a])
    before, times = np.concatenate([np.stack(_unslim(x)) for x in of_words.b], axis=1)
    order = np.argsort(w, kind="stable")
    first, _ = _groups(w[order])
    word, before, times = w[order][first], np.add.reduceat(before[order], first), np.add.reduceat(times[order], first)
    stats = np.zeros((3, len(word)), np.int64)
    if len(of_contexts):  # every context is a word; each comes from one shard
        stats[:, np.searchsorted(word, np.concatenate([_unpack_keys(x) for x in of_contexts.a]))] = np.concatenate([np.stack(_unslim(x)) for x in of_contexts.b], axis=1)
    _store(root, f"words-{int(frame['shard'].iloc[0])}", [word, before, times, *stats])
    return pd.DataFrame([(int(len(word)), int(times.sum()), int(before.sum()), *[int((before == k).sum()) for k in range(1, 5)])], columns=["v", "n", "contexts", "n1", "n2", "n3", "n4"])


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """The modified discounts of counts 0, 1, 2 and 3 or more; 0.5, 1, 1.5 where counts of counts are too few."""
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]).clip([0, 0.05, 0.1, 0.15], [0, 1, 2, 3])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, a place of each, and which of them stands at each place)."""
    order = np.argsort(keys).astype(np.int32)
    ascending = keys[order]
    new = np.concatenate([np.ones(min(1, len(keys)), bool), ascending[1:] != ascending[:-1]])
    of = np.empty(len(keys), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - 1
    return ascending[new], order[new], of


class Batch:
    """The distinct pairs and words of a batch of documents, each in the order of (shard, hash), and its contexts."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, plan: Plan):
        self.tokens, self.sizes = tokens, sizes
        h = _contexts(tokens, sizes)
        keys, first, self.pair_of = _distinct(pair_keys(h, tokens))
        self.of_pairs = (keys, h[first], tokens[first])
        del h
        self.words, _, self.word_of = _distinct(tokens)
        self.contexts, _, self.context_of = _distinct(self.of_pairs[1])
        shards = plan.shard(*self.of_pairs[1:]), plan.word_shard(self.words)
        self.order = [np.lexsort((k, s)) for k, s in zip((keys, self.words), shards, strict=True)]
        self.shards = [s[o] for s, o in zip(shards, self.order, strict=True)]
        self.hashes = [k[o] for k, o in zip((keys, self.words), self.order, strict=True)]
        self.shift = plan.shards

    def questions(self) -> list[tuple[int, bytes]]:
        """(shard, pairs) and, for word shards, (shards + shard, words)."""
        out = []
        for k in (0, 1):
            first, bounds = _groups(self.shards[k])
            out += [(k * self.shift + int(self.shards[k][i]), _pack_keys(self.hashes[k][i:j])) for i, j in zip(first.tolist(), bounds[1:].tolist(), strict=True)]
        return out

    def mark(self, ids: list) -> int:
        """A checksum by which the second pass knows that it sees the documents of the first."""
        import zlib

        return zlib.crc32(repr(ids).encode(), zlib.crc32(self.sizes.tobytes()))

    def placed(self, k: int, answers: np.ndarray) -> np.ndarray:
        """Answers in the order of the questions, back in the order of the hashes."""
        out = np.empty(len(answers), np.int64)
        out[self.order[k]] = answers
        return out


def _answer(batches: Iterator[pa.RecordBatch], root: str, plan: Plan) -> Iterator[pa.RecordBatch]:
    """Rows of QUESTIONS, sorted by shard, with counts in place of hashes."""
    opened: tuple[int, list | None] = (-1, None)
    shards, often = plan.shards, plan.often

    def find(file: list[np.ndarray] | None, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        want = _unpack_keys(raw)
        if file is None or not len(file[0]):
            return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
        at = np.minimum(np.searchsorted(file[0], want), len(file[0]) - 1)
        return at, file[0][at] == want

    def read(column: np.ndarray, at: np.ndarray, hit: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        out[hit] = column[at[hit]]
        return out

    for b in batches:
        for i in range(b.num_rows):
            batch, mark, shard, raw = (c[i].as_py() for c in b.columns)
            if opened[0] != shard:
                opened = (shard, _load(root, f"{'pairs' if shard < shards else 'words'}-{shard % shards}"))
            file = opened[1]
            at, hit = find(file, raw)
            if shard >= shards:
                answer = [read(c, at, hit) for c in file[1:6]] if file else [np.zeros(len(at), np.int64)] * 5
            else:
                n = read(file[1], at, hit) if file else np.zeros(len(at), np.int64)
                high = np.flatnonzero(n == often)
                if len(high):
                    n[high] = file[3][np.searchsorted(file[2], at[high])]
                answer = [n]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((batch, mark, shard, _slim(answer)), (pa.string(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["batch", "mark", "shard", "a"])


def _keep_answers(frame: pd.DataFrame, root: str, shards: int) -> pd.DataFrame:
    """Write the answers to a batch to its file: mark, counts of pairs, five numbers a word."""
    frame = frame.sort_values("shard")
    of_pairs, of_words = frame[frame.shard < shards], frame[frame.shard >= shards]

    def split(column: pd.Series, n: int) -> list[np.ndarray]:
        return list(np.concatenate([np.zeros((n, 0), np.int64), *(np.stack(_unslim(x)) for x in column)], axis=1))

    (counts,) = split(of_pairs.a, 1)
    name = str(frame.batch.iloc[0])
    _store(root, name, [np.frombuffer(_slim([np.array([frame.mark.iloc[0]], np.int64), counts, *split(of_words.a, 5)]), np.uint8)])
    return pd.DataFrame({"batch": [name], "pairs": [len(counts)]})


@dataclass
class Model:
    """Where the files are, and the totals (a few numbers; split contexts: at most HOT_WORDS)."""

    root: str
    plan: Plan
    vocabulary: int
    tokens: int
    contexts: int
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    word_rest: float
    hot_stats: np.ndarray

    def score(self, batch: Batch, answers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known tokens, base score, score) of each document, from the answers to the batch's questions."""
        c, (before, times, *stats) = batch.placed(0, answers[0]), (batch.placed(1, x) for x in answers[1:])
        at = np.minimum(np.searchsorted(batch.words, batch.contexts), len(batch.words) - 1)
        i = np.minimum(np.searchsorted(self.plan.hot, batch.contexts), len(self.plan.hot) - 1)
        total, k1, k2, k3 = (np.where(self.plan.hot[i] == batch.contexts, self.hot_stats[i, k], x[at]) for k, x in enumerate((times, *stats)))
        p1 = np.maximum(before - self.word_discounts[np.minimum(before, 3)], 0) / max(self.contexts, 1) + self.word_rest / (self.vocabulary + 1)
        base = np.log10((times + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1)))
        some = np.maximum(total, 1)
        rest = np.where(total > 0, (self.pair_discounts[1] * k1 + self.pair_discounts[2] * k2 + self.pair_discounts[3] * k3) / some, 1.0)
        word = np.searchsorted(batch.words, batch.of_pairs[2])
        p = np.maximum(c - self.pair_discounts[np.minimum(c, 3)], 0) / some[batch.context_of] + rest[batch.context_of] * p1[word]
        begins = np.cumsum(batch.sizes) - batch.sizes
        return np.add.reduceat((times > 0).astype(np.int64)[batch.word_of], begins), np.add.reduceat(base[batch.word_of], begins), np.add.reduceat(np.log10(p)[batch.pair_of], begins)

    def remove(self, docs: DataFrame) -> None:
        """Delete the model's files."""
        discard(self.root, docs.sparkSession)


def fit(docs: DataFrame, learn: Column | None = None) -> Model:
    """Count the model of the rows of docs where `learn` holds (all rows by default); its files stay in the shared folder."""
    spark = docs.sparkSession
    text = docs["text"].cast("string")
    chosen = docs if learn is None else docs.filter(learn)
    size = chosen.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    plan = Plan(max(4, -(-size // SHARD_BYTES)), FLUSH_TOKENS, OFTEN)
    # Which contexts to split is a matter of balance only; a bounded sample of short texts tells.
    short = chosen.filter(F.octet_length(text) <= HOT_BYTES).select(F.xxhash64(text).alias("h"), text.alias("t"))
    last = short.select("h").orderBy("h").limit(HOT_SAMPLE).agg(F.max("h")).first()[0]  # tasks send hashes, not texts
    sampled = short.filter(F.col("h") <= F.lit(last)).select("t").limit(HOT_SAMPLE).collect() if last is not None else []
    if sampled:
        tokens, _ = Words.read([r["t"] for r in sampled])
        word, n = np.unique(tokens, return_counts=True)
        often = word[(n > len(tokens) / (4 * plan.shards)) & (n > 20)]
        plan.hot = np.sort(np.unique(np.append(often[:HOT_WORDS], START)))
    root = scratch(spark, "lm")
    counted = in_batches(chosen.select(text.alias("text"))).mapInArrow(lambda b: _count(b, plan), COUNTS)
    parts = materialise(counted.groupBy("shard").applyInPandas(lambda f: _shard_pairs(f, plan, root), PARTS), "lm-parts")
    totals = parts.filter("kind > 2").groupBy("shard").applyInPandas(lambda f: _shard_words(f, root), "v long, n long, contexts long, n1 long, n2 long, n3 long, n4 long").groupBy().sum().first()
    v, n, contexts, *of_words = [int(x or 0) for x in totals]
    of_pairs = parts.filter("kind = 1").select(*[F.sum(F.col("stats")[k]).alias(f"n{k}") for k in range(4)]).first()
    hot = {}
    for r in parts.filter("kind = 2").groupBy("a").agg(*[F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(4)]).collect():  # at most HOT_WORDS
        hot[int(np.frombuffer(bytes(r["a"]), "<u8")[0])] = [r[f"s{k}"] for k in range(4)]
    discard(parts, spark)
    del counted, parts
    release_shuffles(spark)
    hot_stats = np.array([hot.get(int(x), [0, 0, 0, 0]) for x in plan.hot], np.int64).reshape(-1, 4)
    d = discounts(*of_words)
    above = v - of_words[0] - of_words[1]
    rest = (d[1] * of_words[0] + d[2] * of_words[1] + d[3] * above) / contexts if contexts else 1.0
    return Model(root, plan, v, n, contexts, discounts(*[int(x or 0) for x in of_pairs]), d, rest, hot_stats)


def _batches(rows: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[tuple[str, list, Batch]]:
    """(name, doc_ids, batch) of the rows (doc_id, text) of a task; names follow from its partition."""
    from pyspark import TaskContext

    part, ids, tokens, sizes, n, number = TaskContext.get().partitionId(), [], [], [], 0, 0
    for b in rows:
        for i in range(0, b.num_rows, 500):
            some = b.slice(i, 500)
            got, size = Words.read(some.column(1).to_pylist())
            ids += some.column(0).to_pylist()
            tokens.append(got)
            sizes.append(size)
            n += len(got)
            if n >= plan.flush:
                yield f"batch-{part}-{number}", ids, Batch(np.concatenate(tokens), np.concatenate(sizes), plan)
                ids, tokens, sizes, n, number = [], [], [], 0, number + 1
    if ids:
        yield f"batch-{part}-{number}", ids, Batch(np.concatenate(tokens), np.concatenate(sizes), plan)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score (add-half unigram) and score (the model), both log10, of every document.

    The result is a written table.
    """
    rows = in_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")))
    plan, root, folder = model.plan, model.root, scratch(docs.sparkSession, "lm-answers")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, batch in _batches(batches, plan):
            asked, mark = batch.questions(), batch.mark(ids)
            columns = [pa.array([name] * len(asked)), pa.array([mark] * len(asked), pa.int64()), pa.array([q[0] for q in asked], pa.int32()), pa.array([q[1] for q in asked], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["batch", "mark", "shard", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, batch in _batches(batches, plan):
            kept = _load(folder, name)
            mark, *answers = _unslim(kept[0].tobytes()) if kept else [np.array([-1])]
            if int(mark[0]) != batch.mark(ids):
                raise RuntimeError("documents came in another order the second time; write them to a table first")
            known, base, own = model.score(batch, answers)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(batch.sizes), pa.array(known), pa.array(base), pa.array(own)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    asked = rows.mapInArrow(ask, QUESTIONS).repartition("shard").sortWithinPartitions("shard")
    answered = asked.mapInArrow(lambda b: _answer(b, root, plan), QUESTIONS)
    kept = answered.groupBy("batch").applyInPandas(lambda f: _keep_answers(f, folder, plan.shards), "batch string, pairs long")
    kept.agg(F.sum("pairs")).collect()
    scored = materialise(rows.mapInArrow(run, SCORES), "lm-scores")
    discard(folder, docs.sparkSession)
    del asked, answered, kept
    release_shuffles(docs.sparkSession)
    return scored
