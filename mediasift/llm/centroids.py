"""Centroid clustering of integer vectors with exact assignments.

Vectors become integers (`scaled`) and are written once. In every round each task assigns its vectors to the nearest
centroid and adds up its clusters; only those sums are shuffled, `k` rows a task, and the driver holds no more than the
`k` centroids. A block of vectors is screened by one float32 matrix product. Its rounding error is bounded for each
pair (`screen_error`: any order of summation, with or without fused operations), so that each squared distance lies
in a known interval; a vector whose least interval overlaps with others has its distances to those centroids
recomputed in 64-bit integers, and the lowest number wins a tie. New centroids are the exact floors of the means.

Left out: vectors that are null, have another number of components, or hold null or non-finite ones. Components
beyond `LARGEST` after scaling raise an error, as squared distances no longer fit a long. Repeated rows are vectors of
their own; a null vec_id counts as an empty text where the first centroids are drawn. With fewer vectors than `k`
there are as many centroids as vectors. An empty table gives no rows. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasift.llm.common import materialise

#: Largest component in absolute value: 64 squares of differences stay below 2**63.
LARGEST = 2**27
#: Components screened against all centroids at a time (vectors times centroids).
BLOCK = 1 << 20
#: Unit roundoff of float32, and the slack of the float64 arithmetic around the screen.
U32, SLACK = 2.0**-24, 2.0**-48

ASSIGNED = "vec_id long, cluster int, distance long"
SUMS = "cluster int, n long, sums array<long>"


def scaled(vectors: DataFrame, dim: int, factor: int) -> DataFrame:
    """vec_id and the components floor(factor * x), as 32-bit integers in a binary, of the vectors that are kept."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.floor(factor * b.column(1).values.to_numpy(zero_copy_only=False)[b.column(1).offsets[0].as_py() : b.column(1).offsets[-1].as_py()])
            if len(x) and np.abs(x).max() > LARGEST:
                raise ArithmeticError(f"components beyond {LARGEST} after scaling: squared distances would not fit a long")
            rows = x.astype("<i4").reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], ["vec_id", "v"])

    v = vectors["embedding"].cast("array<double>")
    fit = (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(fit).select(vectors["vec_id"].cast("long").alias("vec_id"), v.alias("v")).mapInArrow(convert, "vec_id long, v binary")


def screen_error(dim: int) -> float:
    """Bound of a float32 dot product's error over the product of both lengths: dim roundings and one of each factor."""
    n = (dim + 2) * U32
    return n / (1 - n) * (1 + SLACK)


@dataclass
class Nearest:
    """Assigns blocks of integer vectors to the nearest of `centres` (k x dim, int64)."""

    centres: np.ndarray

    def __post_init__(self) -> None:
        self.narrow = np.ascontiguousarray(self.centres.T, np.float32)
        self.squares = (self.centres**2).sum(axis=1)
        self.lengths = np.sqrt(self.squares.astype(np.float64)) * (1 + SLACK)
        self.rows = max(1, BLOCK // max(1, len(self.centres)))
        self.recomputed = 0

    def __call__(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each row of v (n x dim, int32)."""
        got = [self.block(v[i : i + self.rows].astype(np.int64)) for i in range(0, len(v), self.rows)]
        return tuple(np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in range(2))

    def block(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.sqrt((v**2).sum(axis=1).astype(np.float64)) * (1 + SLACK)
        dots = (v.astype(np.float32) @ self.narrow).astype(np.float64)
        near = self.squares - 2 * dots  # squared distance less the vector's own square
        error = 2 * screen_error(v.shape[1]) * lengths[:, None] * self.lengths + SLACK * (self.squares + 2 * np.abs(dots))
        possible = near - error <= (near + error).min(axis=1, keepdims=True)
        best = possible.argmax(axis=1)  # the lowest number left
        open_ = np.flatnonzero(possible.sum(axis=1) > 1)
        self.recomputed += len(open_)
        if len(open_):
            row, centre = np.nonzero(possible[open_])
            exact = ((v[open_[row]] - self.centres[centre]) ** 2).sum(axis=1)
            first = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
            least = np.minimum.reduceat(exact, first)
            hit = np.flatnonzero(exact == least[row])
            best[open_] = centre[hit[np.unique(row[hit], return_index=True)[1]]]
        return best, ((v - self.centres[best]) ** 2).sum(axis=1)


def _vectors(b: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in b.column(b.schema.get_field_index("v"))), "<i4").reshape(-1, dim)


def moved(rows: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of the means of their vectors; those without vectors stay."""
    k, dim = centres.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest, n, sums = Nearest(centres), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            v = _vectors(b, dim)
            cluster, _ = nearest(v)
            n += np.bincount(cluster, minlength=k)
            np.add.at(sums, cluster, v)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = rows.select("v").mapInArrow(add, SUMS).select("cluster", "n", F.posexplode("sums").alias("at", "x"))
    whole = parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    after = centres.copy()
    for r in whole.collect():  # k x dim numbers
        after[r["cluster"], r["at"]] = int(r["x"]) // r["n"]
    return after


def first_centres(rows: DataFrame, k: int, seed: int, dim: int) -> np.ndarray:
    """The vectors with the k smallest SHA-256 of `seed:vec_id`."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = rows.orderBy(drawn, "vec_id", "v").limit(k).select("v").collect()  # k rows
    return np.frombuffer(b"".join(bytes(r["v"]) for r in found), "<i4").reshape(-1, dim).astype(np.int64)


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64, factor: int = 256) -> DataFrame:
    """Each kept row of vectors (vec_id, embedding): vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid."""
    spark = vectors.sparkSession
    rows = materialise(scaled(vectors, dim, factor), "integers")
    centres = first_centres(rows, k, seed, dim)
    for _ in range(rounds if len(centres) else 0):
        centres = moved(rows, centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(centres)
        for b in batches:
            cluster, distance = nearest(_vectors(b, dim))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    found = materialise(rows.mapInArrow(assign, ASSIGNED), "clusters")
    inertia = {r["cluster"]: int(r["n"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}  # k rows
    whole = sum(inertia.values())
    about = spark.createDataFrame([(c, inertia.get(c, 0), whole, centres[c].tolist()) for c in range(len(centres))], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


