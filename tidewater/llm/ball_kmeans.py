"""Ball k-means in exact integers.

A cluster's members in a block of vectors are a ball: its centroid and the largest
distance of a member from it. A centroid is a neighbour of the ball only if half its
distance from the ball's centroid is at most that radius. Neighbours sorted by
distance cut the ball into a stable core, nearer to its centroid than half the
distance of the first neighbour, and annuli; a member of the m-th annulus can only go
to one of the m nearest neighbours, so it is compared with those alone, exactly.

Blocks of a few thousand vectors carry the cluster of each vector from round to
round and, beside the vectors, the sums of their clusters; a round reads and writes
all blocks once, adds up the sums and has the next centroids. Nothing but the
centroids and these sums reaches the driver, and no vector is shuffled.

Integers of any size are exact: sums travel in digits of 32 bits, and vectors whose
components pass `NARROW` are kept in blocks of their own and computed with Python's
integers. A distance or inertia that no long can hold is given as the largest long.

Defined results: vectors that are null, of another number of components, or with null
or non-finite ones are left out; a null vec_id is clustered but never a first
centroid; rows that share a vec_id are vectors of their own (first centroids are
ordered by hash, then by components); with fewer vectors than centroids there are as
many centroids as vectors; an empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import cut
from tidewater.storage import remove

DIM, CLUSTERS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Vectors in a block.
BLOCK = 4096
#: Components up to this are computed in 64 bits: 4 * 64 * (2 * NARROW) ** 2 stays below 2 ** 63.
NARROW = 1 << 26
_DIGIT, _DIGITS = 32, 64
_LONG = 2**63 - 1

BLOCKS = "ids array<long>, data binary, held binary, cells array<long>, sums array<long>"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """vec_id and embedding of the vectors that take part."""
    e = F.col("embedding").cast("array<double>")
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return vectors.where(F.coalesce((F.size("embedding") == dim) & ~bad, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of doubles, exactly: int64 where all are narrow, else Python integers."""
    limit = NARROW / scale
    if not len(values) or np.abs(values).max() < limit:
        return np.floor(values * scale).astype(np.int64)
    whole = [int(x) * scale if abs(x) >= 2.0**53 else math.floor(scale * x) for x in values.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(values.shape)


def _packed(x: np.ndarray) -> bytes:
    if x.dtype == object:
        return b"w" + ",".join(map(str, x.ravel().tolist())).encode()
    return b"n" + x.astype("<i4").tobytes()


def _unpacked(data: bytes, dim: int) -> np.ndarray:
    if data[:1] == b"w":
        return np.array(list(map(int, data[1:].split(b","))), dtype=object).reshape(-1, dim)
    return np.frombuffer(data, "<i4", offset=1).astype(np.int64).reshape(-1, dim)


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x from a centroid; both narrow (int64) or Python integers."""
    d = x - centroid if x.dtype == centroid.dtype else x.astype(object) - centroid.astype(object)
    return np.einsum("ij,ij->i", d, d) if d.dtype != object else (d * d).sum(axis=1)


class Balls:
    """Centroids, and for each the others in the order of their distance."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = [np.array(c, dtype=np.int64 if max(map(abs, c), default=0) <= NARROW else object) for c in centroids]
        self.order: list[list[int]] = []
        self.gaps: list[list[int]] = []
        for i, c in enumerate(self.centroids):
            others = sorted((int(squared(o[None], c)[0]), j) for j, o in enumerate(self.centroids) if j != i)
            self.gaps.append([g for g, _ in others])
            self.order.append([j for _, j in others])

    def assign(self, x: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, squared distance) of each vector, and how many distances were computed.

        `held` is any earlier assignment: the better it is, the smaller the balls and the fewer the comparisons.
        """
        cluster, distance, computed = held.copy(), np.zeros(len(x), dtype=object), 0
        for i in np.unique(held).tolist():
            rows = np.flatnonzero(held == i)
            members = x[rows]
            best, who = squared(members, self.centroids[i]), np.full(len(rows), i)
            computed += len(rows)
            near = bisect_right(self.gaps[i], 4 * int(best.max()))  # neighbours of the ball
            gaps, reach = self.gaps[i][:near], best * 4
            if best.dtype == object:
                ring = np.array([bisect_right(gaps, r) for r in reach], dtype=np.int64)
            else:
                ring = np.searchsorted(np.array([min(g, _LONG) for g in gaps], dtype=np.int64), reach, side="right")
            for m in range(near):  # the stable core, ring 0, is compared with none
                some = np.flatnonzero(ring > m)
                if not len(some):
                    break
                j = self.order[i][m]
                d = squared(members[some], self.centroids[j])
                computed += len(some)
                if d.dtype != best.dtype:
                    best, d = best.astype(object), d.astype(object)
                won = (d < best[some]) | ((d == best[some]) & (j < who[some]))
                best[some[won]], who[some[won]] = d[won], j
            cluster[rows], distance[rows] = who, best
        return cluster, distance, computed


def _digits(cell: int, value: int, cells: list[int], sums: list[int]) -> None:
    """Append the digits of a number of any size to the sums of a cell."""
    sign, value, place = (-1 if value < 0 else 1), abs(value), 0
    while value:
        cells.append(cell * _DIGITS + place)
        sums.append(sign * (value & ((1 << _DIGIT) - 1)))
        value >>= _DIGIT
        place += 1


def _block_sums(x: np.ndarray, cluster: np.ndarray, distance: np.ndarray, dim: int) -> tuple[list[int], list[int]]:
    """Digits of each cluster's component sums, size and inertia: cells are cluster * (dim + 2) + component, size, inertia."""
    cells: list[int] = []
    sums: list[int] = []
    for i in np.unique(cluster).tolist():
        own = cluster == i
        for at, value in enumerate([*x[own].sum(axis=0).tolist(), int(own.sum()), sum(distance[own].tolist())]):
            _digits(i * (dim + 2) + at, value, cells, sums)
    return cells, sums


def _totals(blocks: DataFrame, dim: int, k: int) -> list[list[int]]:
    """Sums over all blocks; k * (dim + 2) numbers reach the driver."""
    found = blocks.select(F.explode(F.arrays_zip("cells", "sums")).alias("s")).groupBy("s.cells").agg(F.sum("s.sums").alias("v")).toArrow()
    out = [[0] * (dim + 2) for _ in range(k)]
    for cell, value in zip(found.column(0).to_pylist(), found.column(1).to_pylist()):
        at, place = divmod(cell, _DIGITS)
        out[at // (dim + 2)][at % (dim + 2)] += value << (_DIGIT * place)
    return out


def _first_blocks(kept: DataFrame, dim: int, scale: int) -> DataFrame:
    def build(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids = part.column(0)
                values = np.asarray(part.column(1).flatten(), dtype=np.float64).reshape(-1, dim)
                wide = ~(np.abs(values).max(axis=1) < NARROW / scale)
                for rows in (np.flatnonzero(~wide), np.flatnonzero(wide)):
                    if len(rows):
                        x = integers(values[rows], scale)
                        yield _block(ids.take(pa.array(rows)), _packed(x), np.zeros(len(rows), dtype="<i4"), [], [])

    return kept.mapInArrow(build, BLOCKS)


def _block(ids, data, held, cells, sums) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([data], pa.binary()), pa.array([held.astype("<i4").tobytes()], pa.binary()), pa.array([cells], pa.list_(pa.int64())), pa.array([sums], pa.list_(pa.int64()))],
        names=["ids", "data", "held", "cells", "sums"],
    )


def _assigned(blocks: DataFrame, balls: Balls, dim: int) -> DataFrame:
    def step(batches):
        for batch in batches:
            ids, datas, helds = batch.column("ids"), batch.column("data"), batch.column("held")
            for r in range(batch.num_rows):
                data = datas[r].as_py()
                x = _unpacked(data, dim)
                cluster, distance, _ = balls.assign(x, np.frombuffer(helds[r].as_py(), "<i4").astype(np.int64))
                yield _block(ids[r].values, data, cluster, *_block_sums(x, cluster, distance, dim))

    return blocks.select("ids", "data", "held").mapInArrow(step, BLOCKS)


def first_centroids(kept: DataFrame, k: int, scale: int = SCALE) -> list[list[int]]:
    """The k vectors of smallest hash."""
    key = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = kept.where("vec_id is not null").select(key.alias("key"), "embedding").orderBy("key", "embedding").limit(k).collect()
    return [integers(np.array([r.embedding]), scale)[0].tolist() for r in rows]


def ball_kmeans(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """Clusters of the vectors (vec_id, embedding) after `rounds` rounds; see RESULT for the columns.

    Rounds after which no centroid has moved would change nothing and are not run.
    """
    spark = vectors.sparkSession
    kept = usable(vectors, dim)
    centroids = first_centroids(kept, k, scale)
    if not centroids:
        return kept.where("false").select(*[F.lit(None).cast(f.split(" ")[1]).alias(f.split(" ")[0]) for f in RESULT.split(", ")])
    blocks = cut(_first_blocks(kept, dim, scale))
    for step in range(rounds + 1):
        fresh = cut(_assigned(blocks, Balls(centroids), dim))
        remove(spark, blocks._tidewater_path)
        blocks, totals = fresh, _totals(fresh, dim, len(centroids))
        moved = [[s // t[dim] for s in t[:dim]] if t[dim] else c for t, c in zip(totals, centroids)]
        if step == rounds or moved == centroids:
            break
        centroids = moved
    return _rows(blocks, centroids, [t[dim + 1] for t in totals], dim)


def _rows(blocks: DataFrame, centroids: list[list[int]], inertias: list[int], dim: int) -> DataFrame:
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    arrays = Balls(centroids).centroids
    by_cluster, total = np.array([min(v, _LONG) for v in inertias], dtype=np.int64), min(sum(inertias), _LONG)

    def unpack(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                x = _unpacked(batch.column("data")[r].as_py(), dim)
                cluster = np.frombuffer(batch.column("held")[r].as_py(), "<i4")
                distance = np.zeros(len(x), dtype=np.int64)
                for i in np.unique(cluster).tolist():
                    rows = np.flatnonzero(cluster == i)
                    d = squared(x[rows], arrays[i])
                    distance[rows] = d if d.dtype != object else [min(v, _LONG) for v in d.tolist()]
                names = pa.DictionaryArray.from_arrays(pa.array(cluster), pa.array(digests)).dictionary_decode()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[r].values, pa.array(cluster), pa.array(distance), pa.array(by_cluster[cluster]), pa.array(np.full(len(x), total)), names],
                    names=[f.split(" ")[0] for f in RESULT.split(", ")],
                )

    return blocks.select("ids", "data", "held").mapInArrow(unpack, RESULT)


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of the embeddings after ten rounds."""
    return ball_kmeans(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
