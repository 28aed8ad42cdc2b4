"""Operator 6: SimHash near-deduplication over vantage-point trees.

Fingerprints: texts are lower-cased in A-Z, cut into words at ASCII white space, and each shingle of three
words (fewer words: the whole sequence) is hashed by XXH64 with seed 42; a bit is set if it is set in over
half of the shingle hashes. A text without words has fingerprint zero.

Search: over whole 64-bit fingerprints a vantage point prunes next to nothing (distances crowd around 32), so
trees are built over parts. The bits are cut into bands; of two fingerprints within `distance`, some combination of
bands (a part) lies within a small radius of its counterpart, and each part has a vantage-point tree of its own. Every
level of a tree splits by the Hamming distance of the part to its vantage point; by the triangle inequality a
fingerprint can only meet those whose distance to each vantage point differs by that radius at most. Leaves are the
shards: a fingerprint is stored in one leaf a tree and queried in all leaves that its radius overlaps. With more
bands than `distance` the radius of the combinations is zero, and no leaf overlaps another; with fewer, neighbouring
leaves are queried as well. `plan_bands` takes the number of bands for which trees and pairs in leaves (a row in a leaf
counts as PAIRS_A_ROW pairs) cost least: parts get wider as fingerprints get more, so that leaves stay small. A leaf that is large all the same, since texts
are alike, branches by bands of its other bits. Pairs that share a leaf are compared exactly; what is left of
many fingerprints is cut into chunks that meet pairwise in tasks of bounded size. Equal fingerprints are one
point; of the pairs found only a spanning forest leaves a task.

Edge cases: null and empty texts have fingerprint zero and link as any other; ties and repeated rows share
a component; rows without doc_id take the component of their fingerprint (null if no row has an id) and are
kept by `keep_one`; rows that share a doc_id are one node; empty tables give no rows; other columns are
ignored by `near_duplicates` and kept by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.llm.common import attach_groups, connected_components, in_batches, materialise, worker_cache

SHINGLE, SEED, BITS, DISTANCE = 3, 42, 64, 3
LEVELS, LEAF_ROWS = 10, 4096
#: Comparisons inside a leaf that cost less than another leaf for a point, whose row is shuffled, sorted and sent to Python.
PAIRS_A_ROW = 16
#: How often a leaf that is still too large branches by bits that it doesn't agree in; after that, chunks of it meet pairwise.
BRANCHED = 2
BATCH_SHINGLES = 200_000


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> list[int]:
    """Hashes of the shingles of a text, repeats included; none if it has no words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxh64_intdigest(joined, seed)] if words else []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate([[0], ends[:-shingle]])
    return [xxh64_intdigest(joined[a:b], seed) for a, b in zip(begins.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints (uint64) of texts from their shingle hashes (uint64) end to end."""
    out = np.zeros(len(sizes), np.uint64)
    some = sizes[sizes > 0]
    if len(some):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count = np.add.reduceat(bits, np.cumsum(some) - some, axis=0, dtype=np.int32)
        out[sizes > 0] = np.packbits(2 * count > some[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprint_batch(texts: list[str | None], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Fingerprints of texts as uint64."""
    out, hashes, sizes = [np.zeros(0, np.uint64)], [], []
    for text in texts:
        found = shingle_hashes(text, shingle, seed)
        hashes += found
        sizes.append(len(found))
        if len(hashes) >= BATCH_SHINGLES:
            out.append(majority_bits(np.array(hashes, np.uint64), np.array(sizes)))
            hashes, sizes = [], []
    return np.concatenate([*out, majority_bits(np.array(hashes, np.uint64), np.array(sizes, np.int64))])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("shingles", dict)  # nothing is kept: other operators' caches go
        for b in batches:
            fp = fingerprint_batch(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return in_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))).mapInArrow(compute, "doc_id long, fp long")


def parts_of(distance: int, bands: int) -> tuple[list[int], int]:
    """(bit masks of the parts, radius): fingerprints within distance lie within the radius in one of the parts."""
    edges = [round(BITS * i / bands) for i in range(bands + 1)]
    cuts = [(1 << high) - (1 << low) for low, high in zip(edges[:-1], edges[1:], strict=True)]
    whole = max(1, bands - distance)  # so many bands no differing bit falls into
    return [sum(chosen) for chosen in combinations(cuts, whole)], 0 if bands > distance else distance // bands


def plan_bands(points: int, distance: int) -> int:
    """The number of bands with the fewest leaves to visit and fingerprints to meet there, if bits are evenly spread."""

    def cost(bands: int) -> float:
        return comb(bands, distance) * (1 + points / 2 ** (BITS * (bands - distance) / bands))

    return min(range(distance + 1, min(distance + 5, BITS) + 1), key=cost) if distance < BITS else 1


def vantage_points(mask: int, levels: int) -> list[int]:
    """Vantage points of a part: fixed pseudo-random bit patterns."""
    return [int(x) & mask for x in np.random.default_rng(7).integers(0, 1 << 63, levels, dtype=np.uint64) * np.uint64(2) + np.arange(levels, dtype=np.uint64) % np.uint64(2)]


def _branches(near: Column, base: int):
    return lambda key: F.transform(near, lambda d: key * base + d)


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def leaves(fp: Column, masks: list[int], radius: int, levels: int) -> tuple[Column, Column]:
    """(the leaf that stores fp, the leaves it is queried in), one entry for each part; leaves are longs."""
    store, probe = [], []
    for p, mask in enumerate(masks):
        bits = mask.bit_count()
        keys = F.array(F.lit(p).cast("long"))
        home: Column = F.lit(p).cast("long")
        for v in vantage_points(mask, levels):
            d = F.bit_count(fp.bitwiseAND(F.lit(_signed(mask))).bitwiseXOR(F.lit(_signed(v)))).cast("long")
            home = home * (bits + 1) + d
            if radius:
                near = F.sequence(F.greatest(d - radius, F.lit(0)), F.least(d + radius, F.lit(bits)))
                keys = F.flatten(F.transform(keys, _branches(near, bits + 1)))
        store.append(home)
        probe.append(keys if radius else F.array(home))
    return F.array(*store), F.flatten(F.array(*probe))


def _links_in_leaves(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (leaf, a, b, role, fp, rep), sorted by leaf and chunks: a spanning forest of the links inside each.

    role 0: stored and queried here, 1: stored only, 2: queried only.
    """
    held: pa.Table | None = None

    def links(t: pa.Table) -> pa.RecordBatch:
        leaf, a, b = (t.column(i).to_numpy() for i in range(3))
        role, fp, rep = (t.column(i).to_numpy() for i in range(3, 6))
        new = np.concatenate([[True], (leaf[1:] != leaf[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        group = np.cumsum(new) - 1
        parent = np.arange(len(leaf))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out, active, step = [], np.arange(len(leaf) - 1), 1
        while len(active):
            active = active[active + step < len(leaf)]
            active = active[group[active] == group[active + step]]
            hit = active[(np.bitwise_count(fp[active] ^ fp[active + step]) <= distance) & ((role[active] == 0) & (role[active + step] == 0) | (role[active] + role[active + step] == 3))]
            if len(hit):
                top = parent.copy()
                while (top != top[top]).any():
                    top = top[top]
                for i in hit[top[hit] != top[hit + step]].tolist():
                    x, y = root(i), root(i + step)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        out.append((rep[i], rep[i + step]))
            step += 1
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        if held is not None:
            t = pa.concat_tables([held, t]).combine_chunks()
        keys = [t.column(i).to_numpy() for i in range(3)]
        other = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
        cut = int(other[-1]) + 1 if len(other) else 0  # the last group may go on in the next batch
        if cut:
            yield links(t.slice(0, cut))
            t = t.slice(cut)
        held = t
    if held is not None and held.num_rows:
        yield links(held)


def link_forest(points: DataFrame, distance: int = DISTANCE, bands: int | None = None, levels: int = LEVELS) -> DataFrame:
    """Edges (u, v) between `rep`s of points (fp, rep) that span all links at `distance` or fewer bits. points should be a written table."""
    masks, radius = parts_of(distance, bands or plan_bands(points.count() // PAIRS_A_ROW, distance))
    store, probe = leaves(F.col("fp"), masks, radius, levels)
    points = points.filter("rep is not null")
    if radius:
        placed = points.select(F.explode(store).alias("leaf"), "fp", "rep").withColumn("role", F.lit(1))
        met = placed.unionByName(points.select(F.explode(probe).alias("leaf"), "fp", "rep").withColumn("role", F.lit(2)))
    else:
        placed = _small_leaves(points.select(F.posexplode(store).alias("part", "leaf"), "fp", "rep"), masks, distance)
        met = placed.withColumn("role", F.lit(0))
    counts = placed.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > LEAF_ROWS)
    chunks = counts.select("leaf", F.ceil(F.col("n") / LEAF_ROWS).cast("int").alias("chunks"))
    cut = met.join(chunks, "leaf", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    met = cut.select("leaf", mine.alias("c"), other.alias("o"), "role", "fp", "rep").select("leaf", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"), "role", "fp", "rep")
    met = met.repartition("leaf", "a", "b").sortWithinPartitions("leaf", "a", "b")
    return met.mapInArrow(lambda batches: _links_in_leaves(batches, distance), "u long, v long")


def narrowed(masks: list[int], distance: int) -> tuple[list[list[int]], list[int]]:
    """(bands of the bits outside each mask, every mask with each of its bands): two fingerprints within distance that agree under a mask agree in one of its bands."""
    bands = []
    for mask in masks:
        rest = [b for b in range(BITS) if not mask >> b & 1]
        bands.append([sum(1 << int(b) for b in part) for part in np.array_split(rest, distance + 1)])
    return bands, [mask | band for mask, own in zip(masks, bands, strict=True) for band in own]


def _small_leaves(placed: DataFrame, masks: list[int], distance: int) -> DataFrame:
    """leaf, fp, rep of placed (with the part of each leaf), the points of large leaves in branches of theirs.

    A leaf's points agree in a part of their bits, so those that link agree in one of a few bands of the others: a
    large leaf branches by these, and a point goes to as many branches instead of meeting all of the leaf.
    """
    ready: DataFrame | None = None
    for _ in range(BRANCHED):
        large = placed.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > LEAF_ROWS).select("leaf", F.lit(True).alias("large"))
        large = materialise(large, "large")
        if not large.limit(1).count():
            break
        marked = materialise(placed.join(large, "leaf", "left"), "leaves")
        done = marked.filter("large is null").select("leaf", "fp", "rep")
        ready = done if ready is None else ready.unionByName(done)
        bands, masks = narrowed(masks, distance)
        listed = F.array(*[F.array(*[F.lit(_signed(m)) for m in own]) for own in bands])
        branch = lambda m, j: F.struct((F.col("part") * (distance + 1) + j).alias("part"), F.xxhash64("leaf", j, F.col("fp").bitwiseAND(m)).alias("leaf"))
        branches = F.explode(F.transform(F.element_at(listed, F.col("part") + 1), branch)).alias("b")
        placed = marked.filter("large").select(branches, "fp", "rep").select("b.part", "b.leaf", "fp", "rep")
    placed = placed.select("leaf", "fp", "rep")
    return placed if ready is None else ready.unionByName(placed)


def candidate_pairs(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v): documents (doc_id, fp) whose fingerprints link; enough pairs to span nearly all groups, none of them a hub."""
    points = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "points")

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, last = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            fp, ids = np.append(fp, b.column(0).to_numpy()), np.append(last, b.column(1).to_numpy())
            same = np.flatnonzero((fp[1:] == fp[:-1]) & (ids[1:] != ids[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[same]), pa.array(ids[same + 1])], ["u", "v"])
            fp, last = fp[-1:], ids[-1:]

    sorted_ = rows.select("fp", "doc_id").repartitionByRange("fp", "doc_id").sortWithinPartitions("fp", "doc_id")
    return link_forest(points, distance).unionByName(sorted_.mapInArrow(neighbours, "u long, v long"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id: one row per document."""
    rows = materialise(fingerprints(docs), "fingerprints")
    points = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "points")
    nodes = connected_components(link_forest(points, distance))
    classes = points.join(nodes.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id"))
    return attach_groups(rows, materialise(classes, "classes"), ["fp"], "n", rows.count()).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """docs with one document of each group of near duplicates (the smallest doc_id), all columns kept."""
    found = near_duplicates(docs, distance).filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    found = materialise(found, "kept")
    ids = found.select(F.col("doc_id").alias("kept_id")).hint("merge")
    kept = docs.join(ids, docs["doc_id"] == ids["kept_id"], "left_semi")  # by a shuffle at every size
    if found.filter("n > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.filter(docs["doc_id"].isNull()))
