"""Clusters around centroids, exact in integers, by a progressive search over Walsh-Hadamard
coefficients.

Vectors become integers, and vectors and centroids are transformed by the 64-point Walsh-Hadamard
transform in sequency order, coarse coefficients first: sums and differences only, so it is
exact, and squared distances of coefficients add up to 64 times the squared distance. A search adds
the differences of a few coefficients after the other for all centroids. The centroid that is best
after the first step is followed to the end at once, which gives a distance that some centroid reaches;
wherever the sum so far of another is strictly greater, it can neither win nor tie and is left
out. Those that stay finish all 64 coefficients, and the smallest number wins among equals.

Each round is one pass over the stored integers; a task returns one row of sums for each centroid,
and the driver gets at most one row of aggregated sums for each centroid and component.

Defined results: only vectors with exactly 64 components, none null or non-finite, take part; the
others give no row. Repeated rows count as often as they occur. Centroids start as the vectors
of the smallest hashes of their ids; rows with equal hashes follow the bytes of their integers, rows
without an id come last. Fewer vectors than centroids give fewer centroids. Integers beyond ±2^24 count as
that, so every distance fits 64 bits; sums of distances beyond 2^63 - 1 are given as that. An empty
table gives an empty table. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamlens.llm.common import stored

SIZE, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Where the steps of a search end.
STEPS = (4, 8, 16, 32, 64)
MOST, LONG = 2**24, 2**63 - 1
#: Rows that a task searches at a time.
ROWS = 4096


def sequency(size: int = SIZE) -> np.ndarray:
    """Where the coefficients of the transform stand by their changes of sign, fewest first."""
    signs = transform(np.eye(size, dtype=np.int64))
    return np.argsort((np.diff(signs, axis=0) != 0).sum(0), kind="stable")


def transform(vectors: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, in natural order, exact in int64."""
    out = vectors.astype(np.int64)
    n, size = out.shape
    half = 1
    while half < size:
        pairs = out.reshape(n, size // (2 * half), 2, half)
        out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), 2).reshape(n, size)
        half *= 2
    return out


class Search:
    """The nearest of some centroids for each vector."""

    def __init__(self, centroids: np.ndarray, steps: tuple[int, ...] = STEPS):
        self.order = sequency(centroids.shape[1])
        self.centroids = transform(centroids)[:, self.order]
        self.steps = steps

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the centroid and squared distance."""
        size = vectors.shape[1]
        coefficients = transform(vectors)[:, self.order]
        n, k = len(vectors), len(self.centroids)
        sums = np.zeros((n, k), np.int64)
        stays = np.ones((n, k), bool)
        reached = None
        low = 0
        for high in self.steps:
            row, number = np.nonzero(stays)
            part = coefficients[row, low:high] - self.centroids[number, low:high]
            sums[row, number] += np.einsum("ij,ij->i", part, part)
            if reached is None:
                leader = sums.argmin(1)
                rest = coefficients[:, high:] - self.centroids[leader, high:]
                reached = sums[np.arange(n), leader] + np.einsum("ij,ij->i", rest, rest)
            stays &= sums <= reached[:, None]
            low = high
        final = np.where(stays, sums, LONG)
        best = final.argmin(1)
        return best, final[np.arange(n), best] // size


def kept_vectors(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """vec_id and the integers of each vector that takes part, as little-endian 32-bit numbers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            whole = np.floor(values.clip(-MOST / SCALE, MOST / SCALE) * SCALE).astype("<i4")
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * size), len(whole), [None, pa.py_buffer(whole.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), flat.cast(pa.binary())], names=["vec_id", "ints"])

    x = F.col("embedding").cast("array<double>")
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter((F.size("x") == size) & ~bad)
    return whole.mapInArrow(cut, "vec_id long, ints binary")


def _matrix(ints: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(ints.to_pylist()), "<i4").reshape(-1, size)


def sums_by_centroid(vectors: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """How many vectors are nearest to each centroid, and their componentwise sums."""
    k, size = len(centroids), len(centroids[0])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(np.array(centroids, np.int64))
        sums, counts = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = _matrix(batch.column("ints").slice(at, ROWS), size)
                number, _ = search.nearest(rows)
                np.add.at(sums, number, rows)
                counts += np.bincount(number, minlength=k)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full), pa.array(counts[full]), pa.array(sums[full].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"],
        )

    parts = vectors.select("ints").mapInArrow(assign, "cluster long, n long, sums array<long>")
    wide = parts.select("cluster", "n", F.posexplode("sums").alias("place", "s"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in wide.groupBy("cluster", "place").agg(exact("n").alias("n"), exact("s").alias("s")).collect():
        found.setdefault(r.cluster, (int(r.n), [0] * size))[1][r.place] = int(r.s)
    return found


def first_centroids(vectors: DataFrame, k: int) -> list[list[int]]:
    hashed = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    chosen = vectors.withColumn("hash", hashed).orderBy(F.asc_nulls_last("hash"), "ints").limit(k).collect()
    return [np.frombuffer(r.ints, "<i4").tolist() for r in chosen]


def next_centroids(centroids: list[list[int]], found: dict[int, tuple[int, list[int]]]) -> list[list[int]]:
    """The floor of each mean; a centroid without vectors stays."""
    return [[s // found[c][0] for s in found[c][1]] if c in found else own for c, own in enumerate(centroids)]


def cluster(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector."""
    spark = rows.sparkSession
    vectors = stored(kept_vectors(rows, size), "vectors")
    centroids = first_centroids(vectors, k)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        centroids = next_centroids(centroids, sums_by_centroid(vectors, centroids))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(np.array(centroids, np.int64))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                number, distance = search.nearest(_matrix(batch.column("ints"), size))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance, pa.int64())],
                    names=["vec_id", "cluster", "distance"],
                )

    placed = stored(vectors.mapInArrow(assign, "vec_id long, cluster int, distance long"), "placed")
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    total = min(LONG, sum(int(r.d) for r in sums))
    facts = [
        (r.cluster, min(LONG, int(r.d)), total, hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest())
        for r in sums
    ]
    # one row for each of the k centroids at most
    found = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(found), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
