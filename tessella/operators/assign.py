"""Nearest-centre joins: each observation with its nearest centre, or its two nearest.

Centres (k x d numbers) travel with the plan; observations never shuffle. Exact ties go to the smallest
cid. Two forms give the same bits: unrolled columns inside whole-stage code, for few centre
coordinates, and Arrow batches with NumPy, which adds up dimensions in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.distance import squared_distance_to

#: Up to so many centre coordinates, expressions are unrolled; more would pass the 64 KB that a generated method may have.
UNROLLED = 64
#: Coordinates of the centres that are broadcast at a time.
BROADCAST_CELLS = 4 << 20
CELLS = 4 << 20


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column, without nulls, as an n x d matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 0))


def squared_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """n x k, summed dimension by dimension."""
    out = np.zeros((len(x), len(centers)))
    for j in range(centers.shape[1]):
        gap = x[:, j, None] - centers[None, :, j]
        out += gap * gap
    return out


def slices(n: int, k: int) -> Iterator[slice]:
    step = max(1, CELLS // max(k, 1))
    return (slice(a, min(a + step, n)) for a in range(0, n, step))


def unrolled(centers: np.ndarray) -> bool:
    return 0 < centers.size <= UNROLLED


def nearest_struct(x: Column, centers: np.ndarray) -> Column:
    """struct(d2, cid) of the nearest centre; a struct compares by d2, then by cid."""
    cells = [F.struct(squared_distance_to(x, c).alias("d2"), F.lit(i).alias("cid")) for i, c in enumerate(centers)]
    return F.least(*cells) if len(cells) > 1 else cells[0]


def nearest(points: DataFrame, centers: np.ndarray, with_distance: bool = False) -> DataFrame:
    """(obs_id, cid), and distance (not squared) on request. Needs a centre."""
    centers = np.asarray(centers, float)
    if not len(centers):
        raise ValueError("no centres")
    if unrolled(centers):
        best = points.select("obs_id", nearest_struct(F.col("x"), centers).alias("best"))
        return best.select("obs_id", "best.cid", *([F.sqrt("best.d2").alias("distance")] if with_distance else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            for s in slices(len(x), len(centers)):
                d2 = squared_distances(x[s], centers)
                cid = d2.argmin(1)
                columns = [batch.column(0)[s], pa.array(cid, pa.int32())] + ([pa.array(np.sqrt(d2[np.arange(len(cid)), cid]))] if with_distance else [])
                yield pa.record_batch(columns, names=["obs_id", "cid", "distance"][: len(columns)])

    return points.select("obs_id", "x").mapInArrow(run, "obs_id long, cid int" + (", distance double" if with_distance else ""))


def nearest_join(points: DataFrame, centers: DataFrame) -> DataFrame:
    """(obs_id, cid) for centres that live in a table (cid, c): one row with all of them joins every observation.

    Their number and length are looked up first; more than `BROADCAST_CELLS` coordinates are broadcast block by block,
    each observation carrying the best centre so far.
    """
    from tessella.functions.distance import squared_distance

    k, d = (v or 0 for v in centers.agg(F.count("*"), F.max(F.size("c"))).first())
    blocks = max(1, -(-k * d // BROADCAST_CELLS))
    best = F.array_min(F.transform("all", lambda e: F.struct(squared_distance(F.col("x"), e["c"]).alias("d2"), e["cid"].alias("cid"))))
    found = points.select("obs_id", "x")
    for b in range(blocks):
        some = centers.where(F.pmod(F.xxhash64("cid"), F.lit(blocks)) == b)
        every = some.agg(F.collect_list(F.struct("cid", "c")).alias("all"))  # one row
        here = best if not b else F.least("best", best)  # a null, of a block without centres, loses
        found = found.join(F.broadcast(every)).select("obs_id", "x", here.alias("best"))
    return found.select("obs_id", "best.cid")


def two_nearest(points: DataFrame, centers: np.ndarray, keep_x: bool = False) -> DataFrame:
    """(obs_id, best, second), and x on request, by distance, then cid. Needs two centres."""
    centers = np.asarray(centers, float)
    if len(centers) < 2:
        raise ValueError("two centres are needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            for s in slices(len(x), len(centers)):
                best, second = two_best(squared_distances(x[s], centers))
                columns = [batch.column(0)[s], pa.array(best, pa.int32()), pa.array(second, pa.int32()), *([batch.column(1)[s]] if keep_x else [])]
                yield pa.record_batch(columns, names=["obs_id", "best", "second", "x"][: len(columns)])

    return points.select("obs_id", "x").mapInArrow(run, "obs_id long, best int, second int" + (", x array<double>" if keep_x else ""))


def two_best(d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best = d2.argmin(1)
    rest = d2.copy()
    rest[np.arange(len(d2)), best] = np.inf
    second = rest.argmin(1)
    return best, np.where(second == best, (best + 1) % d2.shape[1], second)
