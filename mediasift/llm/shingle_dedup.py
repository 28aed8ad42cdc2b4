"""Operator 6 for a similarity of word shingles: near copies by SimHash, completed to the exact Jaccard similarity.

Words are those of operator 6; a document is the set of the hashes of its five-word shingles (fewer words: the
whole sequence). Documents of similarity 0.8 or more link, and one document of each component is kept.

Fingerprints of the same shingles that link in operator 6's trees are candidates, which bring most copies together.
But most pairs of similarity 0.8 differ in more than three bits, and over wider radii the trees prune nothing. So
the rest is found by prefix filtering, which misses no link: with all shingles in one order, two sets that are that similar
share OVERLAP of the first n - ceil(0.8 n) + OVERLAP shingles of each. The order puts frequent shingles last, so that a
common passage brings few documents together: those frequent in a sample, and then those of which a first round
finds more than GROUP_ROWS documents (as marks in a bitmap; any list is right, a good one saves candidates). Keys
are cut to 40 bits (a clash only adds a candidate); every candidate pair is checked on whole sets.

The documents of a large group that share a shingle first meet one of their size. Of the rest, pairs are counted by the
keys they share in small groups; keys in large groups count as shared if both documents have any. And as one of the keys
that a similar pair shares is among the first n - ceil(0.8 n) + 1 of both, only documents that have a large group's key
there are compared with each other, where they are of different components by then: by pairs in groups of up to PAIR_ROWS
documents, in larger ones by blocks, whose tasks get the sets of two chunks of the group and count all overlaps at once.

Edge cases: texts without words (null, empty) link with each other; rows without doc_id are kept; rows that share
a doc_id are one node, of which one is kept; an empty table gives no rows; all columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasift.llm.common import connected_components, discard, give_back, in_batches, materialise, tidy, worker_cache
from mediasift.llm.simhash import candidate_pairs, majority_bits, shingle_hashes

SHINGLE, SEED = 5, 42
#: Least similarity as a fraction.
SHARE, WHOLE = 4, 5
KEY_BITS, SAMPLE_DOCS, COMMON_FROM, MAX_COMMON = 40, 4096, 4, 100_000
#: Shared keys that similar documents must have (fewer if they have fewer shingles), and bits of the largest bitmap.
OVERLAP, MOST_BITS = 5, 1 << 28
#: Groups of up to so many documents meet in all pairs at once; of larger ones, so many at most share a partner.
GROUP_ROWS, STAR_ROWS, PAIRS_AT_ONCE = 16, 1000, 200_000
PAIR_ROWS, CHUNK_ROWS, COLUMNS_AT_ONCE = 64, 1024, 4096


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes (uint64) of the shingles of a text; texts without words share one."""
    return np.unique(np.array(shingle_hashes(text, shingle, SEED) or [0], np.uint64))


def _places(x: np.ndarray, bits: int) -> np.ndarray:
    h = x.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(20)) % np.uint64(bits)).astype(np.int64)


def _bitmap(ids: DataFrame, n: int) -> np.ndarray:
    """Marks of the longs of a column in a bitmap of bounded size; a clash only marks one more."""
    bits = min(MOST_BITS, max(1 << 16, 16 * n))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits // 8, np.uint8)
        for b in batches:
            at = _places(b.column(0).to_numpy(), bits)
            np.bitwise_or.at(seen, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([seen.tobytes()])], ["seen"])

    marks = np.zeros(bits // 8, np.uint8)
    for r in ids.coalesce(4).mapInArrow(mark, "seen binary").toLocalIterator():  # bounded bitmaps
        marks |= np.frombuffer(r["seen"], np.uint8)
    return marks


def _marked(marks: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = _places(x, len(marks) * 8)
    return marks[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


def least_shared(size: np.ndarray) -> np.ndarray:
    """How many keys the prefix of a set of that size shares with that of a similar set."""
    return np.minimum(OVERLAP, -(-SHARE * size // WHOLE))


def prefix(hashes: np.ndarray, common: np.ndarray, marks: np.ndarray | None = None) -> np.ndarray:
    """Keys of the shingles of a set of which similar sets share some; `common` (hashes) is sorted, `marks` tells frequent keys."""
    at = np.minimum(np.searchsorted(common, hashes), max(len(common) - 1, 0))
    last = common[at] == hashes if len(common) else np.zeros(len(hashes), bool)
    keys = (hashes & np.uint64((1 << KEY_BITS) - 1)).astype(np.int64)
    if marks is not None:
        last |= _marked(marks, keys)
    n = len(hashes)
    return np.concatenate([keys[~last], keys[last]])[: n - -(-SHARE * n // WHOLE) + int(least_shared(np.int64(n)))]


def _texts(docs: DataFrame) -> DataFrame:
    return in_batches(docs.filter(docs["doc_id"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")))


def _common(docs: DataFrame, rows: int) -> np.ndarray:
    """Shingles that are frequent in a sample; any list is right, a good one saves candidates."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py()).view(np.int64))], ["h"])

    share = F.lit(max(1, rows // SAMPLE_DOCS))
    sample = _texts(docs).filter(F.pmod(F.xxhash64("doc_id", F.lit("shingles")), share) == 0)
    found = sample.mapInArrow(hashes, "h long").groupBy("h").count().filter(F.col("count") >= COMMON_FROM)
    return np.sort(np.array([r["h"] for r in found.orderBy(F.desc("count"), "h").limit(MAX_COMMON).collect()], np.int64).view(np.uint64))  # at most MAX_COMMON rows


def _keys(docs: DataFrame, common: np.ndarray, marks: np.ndarray | None = None) -> DataFrame:
    """key, doc_id, size, head: one row per shingle of the prefix of each document (head: among the first that similar sets share one of).

    Unless there are marks, also one with its fingerprint: key null, the fingerprint in size.
    """
    shared = docs.sparkSession.sparkContext.broadcast((common, marks))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 100) for b in batches for i in range(0, b.num_rows, 100)):
            worker_cache("shingles", dict)  # nothing is kept: other operators' caches go
            order, frequent = shared.value
            lists = [np.array(shingle_hashes(t, SHINGLE, SEED), np.uint64) for t in b.column(1).to_pylist()]
            sets = [np.unique(x) if len(x) else np.zeros(1, np.uint64) for x in lists]
            heads = [prefix(x, order, frequent) for x in sets]
            n = np.fromiter(map(len, heads), np.int64, len(heads))
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            ids = b.column(0).to_numpy()
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            head = (place <= np.repeat(sizes - -(-SHARE * sizes // WHOLE), n)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads)), pa.array(np.repeat(ids, n)), pa.array(np.repeat(sizes, n)), pa.array(head)], ["key", "doc_id", "size", "head"])
            if frequent is None:
                fp = majority_bits(np.concatenate(lists), np.fromiter(map(len, lists), np.int64, len(lists)))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(ids), pa.int64()), pa.array(ids), pa.array(fp.view(np.int64)), pa.nulls(len(ids), pa.int64())], ["key", "doc_id", "size", "head"])
        give_back()

    return _texts(docs).mapInArrow(cut, "key long, doc_id long, size long, head long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of each group of two or more rows of a key; rows are sorted by key."""
    held: list[np.ndarray] | None = None
    for b in batches:
        cols = [c.to_numpy() for c in b.columns]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        cuts = np.flatnonzero(np.diff(cols[0])) + 1
        starts, ends = np.concatenate([[0], cuts[:-1]]), cuts
        for i, j in zip(starts[: len(cuts)].tolist(), ends.tolist(), strict=True):
            if j - i > 1:
                yield [c[i:j] for c in cols]
        held = [c[cuts[-1] if len(cuts) else 0 :] for c in cols]
    if held is not None and len(held[0]) > 1:
        yield held


CANDIDATES = "key long, u long, v long, n long, need long, head long"


def _pairs(groups: Iterator[list[np.ndarray]], apart: bool, group_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, u, v, n, need, head): pairs (key null) that share n keys and must share need, and members (u, of size v) of large groups.

    Groups are (key, doc_id, size, head), sorted by size; head of a pair: both have the key in their heads. Of a large
    group, documents meet one of about their size. With `apart` a fifth column has components, and all pairs
    between different ones are given, whatever the size of the group.
    """
    pairs: list[np.ndarray] = []
    members: list[list[np.ndarray]] = []
    held = 0

    def flush() -> pa.RecordBatch:
        found = np.concatenate([np.zeros((0, 5), np.int64), *pairs])
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        first = np.flatnonzero(np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(axis=1)])) if len(found) else np.zeros(0, np.int64)
        n = np.add.reduceat(found[:, 2], first) if len(first) else found[:, 2]
        head = np.maximum.reduceat(found[:, 4], first) if len(first) else found[:, 4]
        found = found[first]
        rows = [np.concatenate([np.zeros(0, np.int64), *(m[k] for m in members)]) for k in range(4)]
        none = pa.nulls(len(rows[0]), pa.int64())
        columns = [(pa.nulls(len(found), pa.int64()), rows[0]), (found[:, 0], rows[1]), (found[:, 1], rows[2]), (n, none), (found[:, 3], none), (head, rows[3])]
        pairs.clear()
        members.clear()
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(x, pa.int64()) for x in c]) for c in columns], ["key", "u", "v", "n", "need", "head"])

    def add(a: np.ndarray, b: np.ndarray, need: np.ndarray, head: np.ndarray, sure: bool) -> None:
        some = a != b
        low, high = np.minimum(a, b)[some], np.maximum(a, b)[some]
        pairs.append(np.stack([low, high, np.full(len(low), OVERLAP if sure else 1), need[some], head[some]], 1))

    for key, ids, sizes, head, *more in groups:
        if len(ids) > group_rows and not apart:
            members.append([key, ids, sizes, head])
            kind = (np.log(sizes) / np.log(1.1)).astype(np.int64) * (1 << 20) + ids % (-(-len(ids) // STAR_ROWS))
            _, of = np.unique(kind, return_inverse=True)
            least = np.full(of.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, of, ids)
            add(ids, least[of], np.ones(len(ids), np.int64), head, True)
            add(least[1:], least[:-1], np.ones(len(least) - 1, np.int64), np.ones(len(least) - 1, np.int64), True)
            held += len(ids)
        else:
            top = np.searchsorted(sizes, sizes * WHOLE // SHARE, "right")  # beyond, documents are too long
            for step in range(1, len(ids)):
                i = np.arange(len(ids) - step)
                i = i[i + step < top[i]]
                if not len(i):
                    break
                if apart:
                    i = i[more[0][i] != more[0][i + step]]
                add(ids[i], ids[i + step], least_shared(sizes[i]), head[i] * head[i + step], apart)
                held += len(i)
                if held >= PAIRS_AT_ONCE:
                    yield flush()
                    held = 0
        if held >= PAIRS_AT_ONCE:
            yield flush()
            held = 0
    yield flush()


def _candidates(keys: DataFrame, apart: bool) -> DataFrame:
    """keys dealt by key, as the rows of _pairs."""
    dealt, group_rows = keys.repartition("key").sortWithinPartitions("key", "size", "doc_id"), GROUP_ROWS
    return materialise(dealt.mapInArrow(tidy(lambda batches: _pairs(_groups(batches), apart, group_rows)), CANDIDATES), "candidates")


def _likely(candidates: DataFrame) -> DataFrame:
    """(u, v) of the candidate pairs that share keys enough, those of large groups taken for shared."""
    pairs = candidates.filter("key is null").groupBy("u", "v").agg(F.sum("n").alias("n"), F.max("need").alias("need"), F.max("head").alias("head"))
    large = candidates.filter("key is not null").groupBy("u").agg(F.count("*").alias("l"))
    left, right = (large.select(F.col("u").alias(c), F.col("l").alias(f"l{c}")) for c in ("u", "v"))
    some = pairs.filter("n < need and head > 0").join(left, "u").join(right, "v").filter("n + least(lu, lv) >= need")
    return pairs.filter("n >= need").select("u", "v").unionByName(some.select("u", "v"))


def _sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(id, hashes) of the documents whose id is among n `ids`, and of few others."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(ids, n))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = np.flatnonzero(_marked(shared.value, b.column(0).to_numpy()))
            for i in range(0, len(some), 500):
                t = b.take(pa.array(some[i : i + 500]))
                yield pa.RecordBatch.from_arrays([t.column(0), pa.array([shingle_set(x).tobytes() for x in t.column(1).to_pylist()], pa.binary())], ["id", "hashes"])

    return materialise(_texts(docs).mapInArrow(tidy(sets), "id long, hashes binary"), "sets")


def _links(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v) of the pairs whose sets are similar."""
    pairs = materialise(pairs.distinct(), "pairs")
    known = _sets(docs, pairs.select("u").unionByName(pairs.select(F.col("v").alias("u"))), pairs.count())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(WHOLE * both >= SHARE * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(hit, pa.bool_())), b.column(1).filter(pa.array(hit, pa.bool_()))], ["u", "v"])

    left = known.select(F.col("id").alias("u"), F.col("hashes").alias("x")).hint("merge")
    right = known.select(F.col("id").alias("v"), F.col("hashes").alias("y")).hint("merge")
    met = pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y")
    found = materialise(met.mapInArrow(tidy(check), "u long, v long"), "links")
    discard(known)
    return found


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two of the sets share."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    some = count[column] > 1  # the others overlap with nothing
    row, column = row[some], place[column[some]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS_AT_ONCE):
        i, j = np.searchsorted(column, [begin, begin + COLUMNS_AT_ONCE])
        has = np.zeros((len(sets), COLUMNS_AT_ONCE), np.float32)
        has[row[i:j], column[i:j] - begin] = 1
        out += has @ has.T
    return out


def _links_in_blocks(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(u, v) of similar documents of different components in the groups of members (key, doc_id, component)."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("chunks"))
    placed = members.join(sizes.hint("merge"), "key").withColumn("c", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
    met = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("key", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"), "c", "doc_id", "component")
    ids = members.select("doc_id").distinct()
    known = _sets(docs, ids, ids.count())

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in frame.hashes]
        n = np.array([len(x) for x in sets], np.float32)
        both = _overlaps(sets)
        component, chunk, ids = frame.component.to_numpy(), frame.c.to_numpy(), frame.doc_id.to_numpy()
        hit = (WHOLE * both >= SHARE * (n[:, None] + n - both)) & (component[:, None] != component)
        if frame.a.iloc[0] != frame.b.iloc[0]:
            hit &= chunk[:, None] != chunk
        i, j = np.nonzero(np.triu(hit, 1))
        del both, hit, sets
        give_back()
        return pd.DataFrame({"u": np.minimum(ids[i], ids[j]), "v": np.maximum(ids[i], ids[j])})

    joined = met.join(known.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id")
    found = materialise(joined.groupBy("key", "a", "b").applyInPandas(block, "u long, v long").distinct(), "links")
    discard(known)
    return found


def similar_groups(docs: DataFrame) -> DataFrame:
    """(node, component) of each document that links with another; docs should be a written table."""
    common = _common(docs, docs.count())
    first = materialise(_keys(docs, common), "keys")
    keys = first.filter("key is not null")
    frequent = materialise(keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP_ROWS).select("key"), "frequent")
    if n := frequent.count():
        keys = _keys(docs, common, _bitmap(frequent, n))
    found = _candidates(keys, False)
    pairs = candidate_pairs(first.filter("key is null").select("doc_id", F.col("size").alias("fp")))
    links = _links(docs, _likely(found).unionByName(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))))
    discard(first)
    nodes = connected_components(links)
    large = found.filter("key is not null and head > 0").select("key", F.col("u").alias("doc_id"), F.col("v").alias("size"), "head")
    if not large.limit(1).count():
        return nodes
    placed = large.join(nodes.select(F.col("node").alias("doc_id"), "component").hint("merge"), "doc_id", "left").select("key", "doc_id", "size", "head", F.coalesce("component", "doc_id").alias("component"))
    placed = materialise(placed, "members")
    groups = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n")).filter("a <> b")
    apart = materialise(placed.join(groups.select("key", "n").hint("merge"), "key"), "apart")
    few, many = apart.filter(F.col("n") <= PAIR_ROWS).drop("n"), apart.filter(F.col("n") > PAIR_ROWS)
    more = _links(docs, _candidates(few, True).select("u", "v")).unionByName(_links_in_blocks(docs, many.select("key", "doc_id", "component")))
    return connected_components(links.unionByName(more))


def keep_one_similar(docs: DataFrame) -> DataFrame:
    """docs with one document (the smallest doc_id) of each group of similar ones."""
    gone = similar_groups(docs).filter("node <> component").select(F.col("node").alias("gone_id"))
    gone = materialise(gone, "gone").hint("merge")
    kept = docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
    twice = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count()
    if not twice:
        return kept
    return kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id is null"))
