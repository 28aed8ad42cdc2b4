"""Operator 2: embedding near-deduplication as an exact metric range join.

The metric is the angle between vectors; a cosine of at least t is an angle of at most r = arccos(t). Pivots (a
bounded sample of the vectors, more of them for more vectors) cut the space into cells: a vector is at home with its
nearest pivot; a cell with many members is cut further by hash, so no cell is unbounded. A vector is replicated to
another cell only if two bounds of the triangle inequality let it reach a member there: its angle to the pivot is at
most the cell's radius plus r, and it lies within r of the surface that parts the cell from its own. Of two cells only
one receives the other's vectors. Each cell compares its members with each other and with its replicas, in
chunks of bounded size, alone; members are sent once for each chunk of replicas that there is. Products in single
precision decide pairs clear of the threshold; pairs within their error bound are decided in double precision.
Identical vectors are one point with a weight, and a cell reports link counts and a spanning forest, never its pairs.

Edge cases: vectors link only with others of their own length, each length with pivots and cells of its own;
vectors that are null, empty, zero or hold null or non-finite components link with nothing (n_links 0, their
own component); repeated rows are vectors of
their own that link; rows without vec_id are returned unlinked; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasift.llm.common import attach_groups, connected_components, materialise

COSINE = 0.95
MAX_PIVOTS, VECTORS_A_PIVOT, CELL_ROWS, REPLICA_ROWS = 1024, 6144, 12_288, 16_384
#: Room for rounding in angles and in differences of cosines.
SLACK = 1e-6


def clean_vectors(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, key (of identical vectors), vec (little-endian doubles of the scaled vector), dim; key is null for vectors that can't link."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in batches:
            keys, vecs, dims = [], [], []
            for i in range(b.num_rows):
                item = b.column(1)[i].values if b.column(1)[i].is_valid else None
                x = None if item is None or item.null_count or b.column(0)[i].as_py() is None else item.to_numpy(zero_copy_only=False).astype(np.float64)
                big = 0 if x is None or not len(x) or not np.isfinite(x).all() else np.abs(x).max()
                if big:
                    x = x / big  # no overflow of squares
                    x = x / np.sqrt(x @ x) + 0.0
                    raw = x.astype("<f8").tobytes()
                    keys.append(xxh3_128_digest(raw))
                    vecs.append(raw)
                    dims.append(len(x))
                else:
                    keys.append(None)
                    vecs.append(None)
                    dims.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "key", "vec", "dim"])

    rows = df.select(df[id_column].cast("long").alias("vec_id"), df[vector_column].cast("array<double>").alias("embedding"))
    return rows.mapInArrow(clean, "vec_id long, key binary, vec binary, dim int")


def _matrix(column: pa.Array | list, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column if isinstance(column, list) else column.to_pylist()), "<f8").reshape(-1, dim)


def _reaches(near: np.ndarray, home: np.ndarray, radii: np.ndarray, apart: np.ndarray, angle: float) -> np.ndarray:
    """Which rows may lie within `angle` of a member of which cell.

    near: cosines of rows and pivots; home: the nearest pivot of each row; radii: the widest angle of each cell;
    apart: distances between pivots.
    """
    ball = near >= np.cos(np.minimum(radii + angle + SLACK, np.pi)) - SLACK
    own = near[np.arange(len(near)), home]
    return ball & (own[:, None] - near <= np.sin(angle) * apart[home] + SLACK) & (radii >= 0)


def _linked(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of x link with which rows of y."""
    near = x.astype(np.float32) @ y.astype(np.float32).T
    hit = near >= cosine
    error = (x.shape[1] + 8) * 2.0**-23  # of a product of unit vectors in single precision
    i, j = np.nonzero(np.abs(near - np.float32(cosine)) <= error)
    for k in range(0, len(i), 100_000):
        a, b = i[k : k + 100_000], j[k : k + 100_000]
        hit[a, b] = np.einsum("ij,ij->i", x[a], y[b]) >= cosine
    return hit


class _Forest:
    """Union-find over positions with an array of roots that is kept flat."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> None:
        roots = np.unique(np.append(self.root[others], self.root[i]))
        if len(roots) > 1:
            self.root[np.isin(self.root, roots[1:])] = roots[0]


def _cell(frame: pd.DataFrame, dim: int, cosine: float, block: int = 1024) -> pd.DataFrame:
    """Links of one cell and chunk: rep, links (weighted), root (rep of the smallest position linked)."""
    home, guests, chunk = frame[frame.role == 0], frame[frame.role == 1], int(frame.chunk.iloc[0])
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in [*home.ids, *guests.ids]])
    weights = np.concatenate([np.frombuffer(x, np.int64) for x in [*home.weights, *guests.weights]]).astype(np.float64)
    x = np.concatenate([_matrix([v], dim) for v in [*home.vecs, *guests.vecs]])
    n = sum(len(v) for v in home.ids) // 8
    counts, forest = np.zeros(len(ids)), _Forest(len(ids))

    def meet(rows: np.ndarray, guests_: bool) -> None:
        hit = _linked(x[rows], x[:n], cosine)
        if not guests_:
            hit[np.arange(len(rows)), rows] = False
        some = np.flatnonzero(hit.any(axis=1))
        counts[rows[some]] += hit[some] @ weights[:n]
        if guests_:
            counts[:n] += weights[rows[some]] @ hit[some]
        for r in some:
            forest.join(int(rows[r]), np.flatnonzero(hit[r]))

    for i in range(0, n if chunk == 0 else 0, block):  # one chunk compares the members with each other
        meet(np.arange(i, min(i + block, n)), False)
    for i in range(n, len(ids), block):
        meet(np.arange(i, min(i + block, len(ids))), True)
    linked = np.flatnonzero(counts)
    return pd.DataFrame({"rep": ids[linked], "links": counts[linked].astype(np.int64), "root": ids[forest.root[linked]]})


def near_vectors(df: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    rows = materialise(clean_vectors(df), "vectors")
    usable = rows.filter("key is not null")
    points = materialise(usable.groupBy("dim", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec")), "points")
    order = F.struct(F.xxhash64("key").alias("h"), "key")
    lengths = points.groupBy("dim").agg(F.count("*").alias("n"), F.min_by("vec", order).alias("vec")).collect()  # a row a vector length
    if not lengths:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    angle = float(np.arccos(cosine))
    pivots, count = {}, {r["dim"]: r["n"] for r in lengths}
    for r in lengths:
        wanted = min(MAX_PIVOTS, -(-r["n"] // VECTORS_A_PIVOT))
        own = points.filter(F.col("dim") == r["dim"]).orderBy(F.xxhash64("key"), "key").limit(wanted).select("vec").collect() if wanted > 1 else [r]
        pivots[r["dim"]] = _matrix([bytes(p["vec"]) for p in own], r["dim"])  # at most MAX_PIVOTS vectors
    apart = {d: np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T))) for d, p in pivots.items()}
    members, reached = {d: np.zeros(len(p), np.int64) for d, p in pivots.items()}, {d: np.zeros(len(p), np.int64) for d, p in pivots.items()}
    radii = {d: np.full(len(p), -np.inf) for d, p in pivots.items()}

    def by_length(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
        dims = b.column(0).to_numpy()
        for dim in np.unique(dims).tolist():
            yield dim, b.filter(pa.array(dims == dim))

    def placed_by(dim: int, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """vectors, their cosines to the pivots, and the nearest pivot of each."""
        x = _matrix(vectors, dim)
        near = x @ pivots[dim].T
        return x, near, near.argmax(axis=1)

    def totals(dim: int, number: np.ndarray, radius: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([dim] * len(number), pa.int32()), pa.array(np.arange(len(number))), pa.array(number), pa.array(radius)], ["dim", "cell", "n", "radius"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, b in (x for b in batches for x in by_length(b)):
            _, near, home = placed_by(dim, b.column(1))
            radius = np.full(len(pivots[dim]), -1.0)
            np.maximum.at(radius, home, np.arccos(np.clip(near[np.arange(len(near)), home], -1, 1)))
            yield totals(dim, np.bincount(home, minlength=len(radius)), radius)

    def count_guests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, b in (x for b in batches for x in by_length(b)):
            _, near, home = placed_by(dim, b.column(1))
            yield totals(dim, _reaches(near, home, radii[dim], apart[dim], angle).sum(axis=0).astype(np.int64), np.zeros(len(pivots[dim])))

    def summed(work) -> list:
        found = points.select("dim", "vec").mapInArrow(work, "dim int, cell long, n long, radius double")
        return found.groupBy("dim", "cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()  # a row a pivot

    for r in summed(measure):
        members[r["dim"]][r["cell"]], radii[r["dim"]][r["cell"]] = r["n"], r["radius"]
    for r in summed(count_guests) if any(len(p) > 1 or count[d] > CELL_ROWS for d, p in pivots.items()) else []:
        reached[r["dim"]][r["cell"]] = r["n"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, b in (x for b in batches for x in by_length(b)):
            salts = np.maximum(1, -(-members[dim] // CELL_ROWS))
            first = np.cumsum(salts) - salts
            chunks = np.maximum(1, -(-reached[dim] // (2 * REPLICA_ROWS)))  # about half of those that reach a cell are sent there
            ids, weights = b.column(1).to_numpy(), b.column(2).to_numpy()
            x, near, nearest = placed_by(dim, b.column(3))
            salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            home = first[nearest] + (salt % salts[nearest].astype(np.uint64)).astype(np.int64)
            reach = _reaches(near, nearest, radii[dim], apart[dim], angle)
            out: dict[str, list] = {k: [] for k in ("dim", "cell", "chunk", "role", "ids", "weights", "vecs")}

            def put(cell: int, part: int, role: int, i: np.ndarray, out=out, dim=dim, ids=ids, weights=weights, x=x) -> None:
                for k, v in zip(out, (dim, cell, part, role, ids[i].tobytes(), weights[i].tobytes(), x[i].tobytes()), strict=True):
                    out[k].append(v)

            for pivot in np.flatnonzero(members[dim]).tolist():
                near_by = np.flatnonzero(reach[:, pivot] | (nearest == pivot))
                chunk = ((salt[near_by] >> np.uint64(20)) % np.uint64(chunks[pivot])).astype(np.int64)
                for c in range(int(first[pivot]), int(first[pivot] + salts[pivot])):
                    own = near_by[home[near_by] == c]
                    for part in range(int(chunks[pivot]) if len(own) else 0):
                        put(c, part, 0, own)
                    other = home[near_by]
                    sent = (other != c) & ((other < c) ^ ((other + c) % 2 == 1))
                    for part in np.unique(chunk[sent]).tolist():
                        put(c, part, 1, near_by[sent & (chunk == part)])
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    placed = points.select("dim", "rep", "n", "vec").mapInArrow(spread, "dim int, cell int, chunk int, role int, ids binary, weights binary, vecs binary")
    met_in_cells = placed.groupBy("dim", "cell", "chunk").applyInPandas(lambda frame: _cell(frame, int(frame.dim.iloc[0]), cosine), "rep long, links long, root long")
    found = materialise(met_in_cells, "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    nodes = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    classes = points.select("key", "rep", "n").join(links, "rep", "left").join(nodes.withColumnRenamed("node", "rep"), "rep", "left")
    classes = materialise(classes.select("key", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "classes")
    keyed = rows.select("vec_id", "key")
    joined = attach_groups(keyed, classes, ["key"], "n", rows.count())
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
