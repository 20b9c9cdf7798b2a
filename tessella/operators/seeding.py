"""Start centres: given ones, a uniform sample, distance-weighted sampling, variance partitioning.

Each seeding has run(points, n, d, k), which returns the centres it found: k rows or fewer.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.distance import squared_distance_to
from tessella.operators.aggregate import moments
from tessella.operators.assign import matrix, slices, squared_distances, unrolled
from tessella.sources.points import gather


class Seeding(Protocol):
    def run(self, points: DataFrame, n: int, d: int, k: int) -> np.ndarray: ...


@dataclass
class Given:
    """The caller's centres; at most n of them are used."""

    centers: np.ndarray

    def run(self, points: DataFrame, n: int, d: int, k: int) -> np.ndarray:
        return np.asarray(self.centers, float)[: min(n, k)]


def sample_key(seed: int, *more: Column | int) -> Column:
    """Uniform and repeatable: the order of MD5 digests, which any SQL engine can form."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.lit(str(m)) if isinstance(m, int) else m.cast("string")) for m in more]).cast("binary"))


@dataclass
class Random:
    """min(n, k) observations without replacement, in order of obs_id."""

    seed: int = 6523

    def run(self, points: DataFrame, n: int, d: int, k: int) -> np.ndarray:
        rows = points.orderBy(sample_key(self.seed, F.col("obs_id"))).limit(max(k, 0)).collect() if k > 0 else []
        return np.array([r["x"] for r in sorted(rows, key=lambda r: r["obs_id"])], float).reshape(len(rows), d)


def draws(seed: int, k: int) -> list[float]:
    r = random.Random(seed)
    return [r.random() for _ in range(k)]


@dataclass
class KmeansPlusPlus:
    """Each seed is drawn with a weight of its squared distance to the seeds so far; stops when all weights are 0.

    The weights are a column that is lowered by the newest seeds only; it is written out every `rewrite`
    seeds. A draw narrows the range of obs_id by sums over at most `FAN` subranges, so no task orders all rows.
    """

    seed: int = 6523
    rewrite: int = 16
    FAN: int = field(default=4096, repr=False)

    def run(self, points: DataFrame, n: int, d: int, k: int) -> np.ndarray:
        if not n or k < 1:
            return np.empty((0, d))
        u = draws(self.seed, k)
        chosen = [min(n - 1, max(0, int(np.ceil(u[0] * n)) - 1))]
        centers = gather(points, chosen)
        state, pending, first = points.select("obs_id", "x"), [centers[0]], True
        while len(chosen) < min(k, n):
            weighted = self._lowered(state, pending, first)
            if len(pending) >= self.rewrite:
                from tessella.plans.session import durable

                state, pending, first = durable(weighted), [], False
                weighted = state
            pick = self._pick(weighted, n, u[len(chosen)])
            if pick is None:
                break
            chosen.append(pick)
            centers = np.vstack([centers, gather(points, [pick])])
            pending.append(centers[-1])
        return centers

    @staticmethod
    def _lowered(state: DataFrame, pending: list[np.ndarray], first: bool) -> DataFrame:
        """mind: the least squared distance to any seed; only the pending ones are measured."""
        seeds = np.array(pending)
        if unrolled(seeds):
            d2 = [squared_distance_to(F.col("x"), c) for c in pending] + ([] if first else [F.col("mind")])
            return state.withColumn("mind", F.least(*d2) if len(d2) > 1 else d2[0])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(1))
                low = np.full(len(x), np.inf) if first else batch.column(2).to_numpy()
                parts = [squared_distances(x[s], seeds).min(1) for s in slices(len(x), len(seeds))]
                low = np.minimum(low, np.concatenate(parts)) if parts else low
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(low)], names=["obs_id", "x", "mind"])

        return state.mapInArrow(run, "obs_id long, x array<double>, mind double")

    def _pick(self, weighted: DataFrame, n: int, u: float) -> int | None:
        """The first obs_id at which the running sum of weights reaches u times their total."""
        low, width, before, target = 0, n, 0.0, None
        while True:
            step = -(-width // self.FAN)
            inside = weighted.where((F.col("obs_id") >= low) & (F.col("obs_id") < low + width) & (F.col("mind") > 0))
            sums = sorted((r["part"], r["s"]) for r in inside.groupBy(F.floor((F.col("obs_id") - low) / step).cast("long").alias("part")).agg(F.sum("mind").alias("s")).collect())
            if not sums:
                return None
            if target is None:
                target = u * sum(s for _, s in sums)
            for part, s in sums:
                if before + s >= target or part == sums[-1][0]:
                    break
                before += s
            low += part * step
            if step == 1:
                return low
            width = step


def split_labels(points: DataFrame, splits: list[tuple[int, int, float, int]]) -> DataFrame:
    """(obs_id, cid, x) after splits (cluster, dimension, boundary, new cluster): values of the boundary or more move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            cid = np.zeros(len(x), np.int32)
            for old, j, boundary, new in splits:
                cid[(cid == old) & (x[:, j] >= boundary)] = new
            yield pa.record_batch([batch.column(0), pa.array(cid), batch.column(1)], names=["obs_id", "cid", "x"])

    return points.select("obs_id", "x").mapInArrow(run, "obs_id long, cid int, x array<double>")


#: Rows up to which a cut is searched in one task; beyond, by ranges of values.
CUT_ROWS = 1 << 18

Moments = tuple[int, float, float]  # n, mean, sum of squares about it


def best_cut(values: np.ndarray, times: np.ndarray, head: Moments, tail: Moments, after: float | None) -> tuple[float, float] | None:
    """(sum of squares, boundary) of the best cut that follows one of the sorted distinct values, which occur so many times; head and
    tail: the moments of what lies before and behind; after: the next value behind."""
    v = np.append(values, [] if after is None else [after])
    if len(v) < 2:
        return None
    shift = float(values @ times / times.sum())
    own, own2, n = np.cumsum(times * (values - shift)), np.cumsum(times * (values - shift) ** 2), np.cumsum(times)

    def side(count: np.ndarray, s: np.ndarray, s2: np.ndarray, other: Moments) -> np.ndarray:
        gap = np.where(count > 0, s / np.maximum(count, 1), 0) + shift - other[1]
        return np.maximum(s2 - s * s / np.maximum(count, 1), 0) + other[2] + gap * gap * count * other[0] / np.maximum(count + other[0], 1)

    left = side(n, own, own2, head)
    right = side(n[-1] - n, own[-1] - own, own2[-1] - own2, tail)
    total = (left + right)[: len(v) - 1]
    i = int(total.argmin())
    return float(total[i]), float(v[i] + (v[i + 1] - v[i]) / 2)


def _together(a: Moments, b: Moments) -> Moments:
    n, gap = a[0] + b[0], b[1] - a[1]
    return (n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n) if n else a


def optimal_boundary(values: DataFrame, n: int, rows: int | None = None) -> float:
    """The cut of column v into two parts with the least sum of squares: the midpoint of two neighbours; ties to the leftmost.

    Where all values are equal, that value. Equal values are counted before anything moves, so a value of half of all rows is one row. Beyond `rows` values, ranges
    of values are stored and cut in parallel: each knows the moments of all ranges before and behind it and the first value
    of the next. The driver sees a row for each range.
    """
    parts = max(1, -(-n // (rows or CUT_ROWS)))
    parted = values.groupBy("v").agg(F.count("*").alias("n"))
    if parts > 1:
        from tessella.plans.session import durable

        parted = durable(parted.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()))
    else:
        parted = parted.coalesce(1).withColumn("part", F.lit(0))
    parted = parted.select("v", "n", "part")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """A task's range: part, sorted values and how often each occurs."""
        found = [b for b in batches if b.num_rows]
        if found:
            v, times = (np.concatenate([b.column(k).to_numpy() for b in found]) for k in (0, 1))
            order = np.argsort(v)
            yield found[0].column(2)[0].as_py(), v[order], times[order].astype(float)

    def stat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v, times in whole(batches):
            mean = float(v @ times / times.sum())
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([int(times.sum())]), pa.array([mean]), pa.array([float(times @ (v - mean) ** 2)]), pa.array([v[0]])], names=["part", "n", "mean", "ss", "low"])

    stats = sorted(map(tuple, parted.mapInArrow(stat, "part int, n long, mean double, ss double, low double").collect()))
    none = (0, 0.0, 0.0)
    heads, tails = [none], [none]
    for _, *m, _ in stats[:-1]:
        heads.append(_together(heads[-1], tuple(m)))
    for _, *m, _ in stats[:0:-1]:
        tails.append(_together(tails[-1], tuple(m)))
    after = [x[-1] for x in stats[1:]] + [None]
    plan = {x[0]: y for x, *y in zip(stats, heads, reversed(tails), after)}
    held = values.sparkSession.sparkContext.broadcast(plan)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v, times in whole(batches):
            found = best_cut(v, times, *held.value[part])
            if found is not None:
                yield pa.record_batch([pa.array([found[0]]), pa.array([found[1]])], names=["ss", "boundary"])

    found = sorted((r["ss"], r["boundary"]) for r in parted.mapInArrow(search, "ss double, boundary double").collect())
    return found[0][1] if found else stats[0][-1]


@dataclass
class VariancePartition:
    """Splits the cluster of the largest (size-adjusted) sum of squares at its widest dimension, k - 1 times.

    The cut is the best one (or the mean); ties: the newer cluster, the first dimension, the leftmost cut.
    Stops early when nothing varies or a part is empty, and then keeps the unsplit centre.
    """

    size_adjustment: float = 1.0
    optimize_partition: bool = True

    def run(self, points: DataFrame, n: int, d: int, k: int) -> np.ndarray:
        if not n or not d or k < 1:
            return np.empty((0, d))
        splits: list[tuple[int, int, float, int]] = []
        held = {0: moments(points.select(F.lit(0).alias("cid"), "x"), d)[0]}
        while len(held) < k:
            worth = {c: ss.sum() / m ** (1 - self.size_adjustment) for c, (m, _, ss) in held.items()}
            top = max(worth, key=lambda c: (worth[c], c))
            m, mean, ss = held[top]
            if worth[top] <= 0:
                break
            j = int(ss.argmax())
            members = split_labels(points, splits).where(F.col("cid") == top)
            boundary = optimal_boundary(members.select(F.col("x")[j].alias("v")), m) if self.optimize_partition else float(mean[j])
            new = len(held)
            tried = [*splits, (top, j, boundary, new)]
            parts = moments(split_labels(points, tried).where(F.col("cid").isin(top, new)), d)
            if len(parts) < 2:
                break
            splits = tried
            held |= parts
        return np.array([held[c][1] for c in range(len(held))])
