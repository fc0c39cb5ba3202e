"""Centroid clustering of vectors in integers, by partial-distance search.

Components become integers, so that distances, sums and means are exact and depend on neither partitioning nor order. A round reads
the vectors once: tasks assign them and add them up, and the sums of each cluster and dimension, a few rows a task, are added in a
shuffle. Only the sums of k clusters come to the driver, where the new centroids are made, and go to the tasks of the next round.

Partial-distance search: dimensions are read in blocks, those of the highest variance first. A vector starts with the centroid that
is nearest in the first block; against every other one squared differences are added up block by block, and that centroid is
abandoned as soon as the partial sum is strictly above the best distance so far. What survives all blocks is at most as far, and
equally far ones go to the smaller number. The variance decides the order alone, so results don't depend on it.

Numbers of any size are exact: sums travel as 32-bit parts, and where 64 bits could overflow a task reckons in Python's integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ratingmill.llm.common import release, tune

DIMS, CLUSTERS, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024
#: Dimensions whose differences are added up before centroids are abandoned.
BLOCK = 8
#: Components below this have squared distances over 64 dimensions, and sums over 2**36 of them, within 64 bits.
NARROW = 1 << 27
MOST_LONG = (1 << 63) - 1
#: Places of a task's sums beside the dimensions.
COUNT, INERTIA = -1, -2


def is_whole(vector: str | Column, dims: int = DIMS) -> Column:
    """Whether a vector has exactly so many components, none of them null or non-finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    sound = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < math.inf)
    return F.coalesce((F.size(v) == dims) & F.forall(v, sound), F.lit(False))


def _integer(x: float, scale: int) -> int:
    return int(x) * scale if abs(x) > 1 << 60 else math.floor(x * scale)


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): int64 where that is narrow, else Python's integers."""
    whole = np.floor(x * float(scale))
    if not len(x) or np.abs(whole).max() < NARROW:
        return whole.astype(np.int64)
    return np.array([_integer(y, scale) for y in x.ravel().tolist()], object).reshape(x.shape)


def matrix(column: pa.Array, dims: int = DIMS) -> np.ndarray:
    """The vectors of a list column as doubles, a row each; all must have the length."""
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dims)


def nearest(v: np.ndarray, centroids: np.ndarray, order: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each vector; the smaller number where several are nearest."""
    if v.dtype == object or centroids.dtype == object:
        v, centroids = v.astype(object), centroids.astype(object)
    v, c = v[:, order], centroids[:, order]
    square = lambda rows, j, a, b: ((v[rows, a:b] - c[j, a:b]) ** 2).sum(1)
    dims, every = v.shape[1], np.arange(len(v))
    first = np.stack([square(every, j, 0, block) for j in range(len(c))], 1)
    number = np.argmin(first, 1)
    best = first[every, number] + ((v[:, block:] - c[number, block:]) ** 2).sum(1)
    for j in range(len(c)):
        rows = np.flatnonzero((number != j) & (first[:, j] <= best))
        d = first[rows, j]
        for at in range(block, dims, block):
            if not len(rows):
                break
            d = d + square(rows, j, at, at + block)
            on = d <= best[rows]
            rows, d = rows[on], d[on]
        closer = (d < best[rows]) | ((d == best[rows]) & (j < number[rows]))
        number[rows[closer]], best[rows[closer]] = j, d[closer]
    return number, best


def _parts(total: int) -> Iterator[tuple[int, int]]:
    """(place, part): total is the sum of part << 32 * place."""
    sign, left, place = (-1 if total < 0 else 1), abs(total), 0
    while left:
        if left & 0xFFFFFFFF:
            yield place, sign * (left & 0xFFFFFFFF)
        left, place = left >> 32, place + 1


def _summed(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray, dims: int, scale: int) -> dict[tuple[int, int], int]:
    """The sum over the vectors of each cluster by (cluster, dimension), and their COUNT and INERTIA."""
    k = len(centroids)
    schema = pa.schema([("cluster", pa.int32()), ("dim", pa.int32()), ("place", pa.int32()), ("part", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for b in batches:
            v = integers(matrix(b.column(0), dims), scale)
            if not len(v):
                continue
            number, best = nearest(v, centroids, order)
            for j in range(k):
                at = np.flatnonzero(number == j)
                if len(at):
                    sums = enumerate(v[at].sum(0).tolist())
                    for dim, s in (*sums, (COUNT, len(at)), (INERTIA, sum(best[at].tolist()))):
                        total[j, dim] = total.get((j, dim), 0) + s
            release()
        rows = [(j, dim, place, part) for (j, dim), s in sorted(total.items()) for place, part in _parts(s)]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, schema, strict=True)], schema=schema)

    parts = vectors.mapInArrow(each, "cluster int, dim int, place int, part long")
    out: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("cluster", "dim", "place").agg(F.sum("part").alias("part")).collect():  # at most k * (dims + 2) sums, in parts
        out[r.cluster, r.dim] = out.get((r.cluster, r.dim), 0) + (r.part << 32 * r.place)
    return out


def _by_variance(vectors: DataFrame, dims: int) -> np.ndarray:
    """The dimensions, those of the highest variance first."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(dims), np.zeros(dims)
        for b in batches:
            x = np.clip(matrix(b.column(0), dims), -1e60, 1e60)
            n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        yield pa.RecordBatch.from_pydict({"dim": np.arange(dims), "n": np.full(dims, n), "s": s, "q": q})

    parts = vectors.mapInArrow(each, "dim long, n long, s double, q double")
    rows = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()  # a row for each dimension
    spread = np.zeros(dims)
    for r in rows:
        spread[r.dim] = r.q / max(r.n, 1) - (r.s / max(r.n, 1)) ** 2
    return np.argsort(-spread, kind="stable")


def _array(rows: Sequence[Sequence[int]]) -> np.ndarray:
    narrow = max((abs(x) for r in rows for x in r), default=0) < NARROW
    return np.array(rows, np.int64 if narrow else object)


def first_centroids(vectors: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The k vectors whose sha256 of `seed:vec_id` is smallest, in that order; of equal ids the smaller vector, those without id last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(key.alias("key"), "embedding").orderBy(F.col("key").asc_nulls_last(), "embedding").limit(k).collect()
    return [[_integer(float(x), scale) for x in r.embedding] for r in rows]


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, dims: int = DIMS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector with exactly `dims` finite components.

    Other vectors (null, of another length, with a null or non-finite component) are left out. Equal rows count each, rows without
    vec_id are clustered and come last in the choice of first centroids, vec_id keeps its type. With fewer than k vectors there are
    as many centroids; an empty table gives no row; other columns are not looked at. A cluster that loses all its vectors keeps its
    centroid. distance, cluster_inertia and inertia are null where they don't fit a long. k * dims numbers go through the driver and
    to each task.
    """
    tune(vectors.sparkSession)
    whole = vectors.select("vec_id", "embedding").where(is_whole("embedding", dims))
    bare = whole.select("embedding")
    now = first_centroids(whole, k, seed, scale)
    kind = whole.schema["vec_id"].dataType.simpleString()
    out = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not now:
        return vectors.sparkSession.createDataFrame([], out)
    order = _by_variance(bare, dims)
    for _ in range(rounds):
        total = _summed(bare, _array(now), order, dims, scale)
        now = [[total.get((j, i), 0) // n for i in range(dims)] if (n := total.get((j, COUNT), 0)) else c for j, c in enumerate(now)]
    centroids, total = _array(now), _summed(bare, _array(now), order, dims, scale)
    own = [total.get((j, INERTIA), 0) for j in range(len(now))]
    long = lambda x: x if x <= MOST_LONG else None
    own, inertia = [long(x) for x in own], long(sum(own))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    id_type = to_arrow_schema(whole.schema).field("vec_id").type

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = integers(matrix(b.column(1), dims), scale)
            number, best = nearest(v, centroids, order) if len(v) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            at = number.tolist()
            columns = [
                b.column(0).cast(id_type),
                pa.array(at, pa.int32()),
                pa.array([long(x) for x in best.tolist()], pa.int64()),
                pa.array([own[j] for j in at], pa.int64()),
                pa.array([inertia] * len(at), pa.int64()),
                pa.array([sha[j] for j in at], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return whole.mapInArrow(each, out)
