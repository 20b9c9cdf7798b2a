"""Sizes, centroids, moments and within-cluster sums of squares.

Each task first reduces its rows to one row for each cluster; only those rows shuffle. A cluster without
members has size 0, the origin as its centroid and a sum of squares of 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.assign import matrix, nearest_struct, slices, squared_distances, unrolled


def _sum_arrays(partial: DataFrame) -> DataFrame:
    """(cid, n, s): the sums, in order of task, of partial (task, cid, n, s).

    Arrays are added as such: a SQL sum of each element is a plan as wide as the arrays, compiled anew in every pass.
    """

    def add(parts: pa.Table) -> pa.Table:
        order = np.argsort(parts["task"].to_numpy(), kind="stable")
        total = matrix(parts["s"].combine_chunks())[order].sum(0)
        return pa.table({"cid": parts["cid"][:1], "n": pa.array([int(parts["n"].to_numpy().sum())], pa.int64()), "s": pa.array([total], pa.list_(pa.float64()))})

    return partial.groupBy("cid").applyInArrow(add, "cid int, n long, s array<double>")


PARTIAL = "task int, cid int, n long, s array<double>"


def _partial(n: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's row for each cluster that it has members of."""
    from pyspark import TaskContext

    used = np.flatnonzero(n)
    if len(used):
        yield pa.record_batch([pa.array(np.full(len(used), TaskContext.get().partitionId()), pa.int32()), pa.array(used, pa.int32()), pa.array(n[used]), pa.array(list(s[used]), pa.list_(pa.float64()))], names=["task", "cid", "n", "s"])


def _partial_sums(labelled: DataFrame, d: int) -> DataFrame:
    """(task, cid, n, s): each task's sums of labelled (cid, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(0, np.int64), np.zeros((0, d))
        for batch in batches:
            cid, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
            if len(cid) and cid.max() >= len(n):
                grow = int(cid.max()) + 1 - len(n)
                n, s = np.append(n, np.zeros(grow, np.int64)), np.vstack([s, np.zeros((grow, d))])
            n += np.bincount(cid, minlength=len(n))
            order = np.argsort(cid, kind="stable")
            starts = np.flatnonzero(np.diff(cid[order], prepend=-1))
            if len(starts):
                s[cid[order][starts]] += np.add.reduceat(x[order], starts, axis=0)
        yield from _partial(n, s)

    return labelled.select(F.col("cid").cast("int").alias("cid"), "x").mapInArrow(run, PARTIAL)


def _dense(rows: list, k: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    sizes, centers = np.zeros(k, np.int64), np.zeros((k, d))
    for r in rows:
        sizes[r["cid"]] = r["n"]
        centers[r["cid"]] = np.array(r["s"]) / r["n"]
    return sizes, centers


def centroids(labelled: DataFrame, k: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, k x d centroids) of labelled (cid, x)."""
    return _dense(_sum_arrays(_partial_sums(labelled, d)).collect(), k, d)


def global_centroid(points: DataFrame, d: int) -> np.ndarray:
    """The mean of all observations; without any, NaN."""
    sizes, centers = centroids(points.select(F.lit(0).alias("cid"), "x"), 1, d)
    return centers[0] if sizes[0] else np.full(d, np.nan)


def sizes(assignments: DataFrame, k: int) -> np.ndarray:
    out = np.zeros(k, np.int64)
    for r in assignments.groupBy("cid").count().collect():
        out[r["cid"]] = r["count"]
    return out


def labelled_wcss(labelled: DataFrame, centers: np.ndarray) -> np.ndarray:
    """Within-cluster sum of squares of every centre, of labelled (cid, x): one scan, no join."""
    k = len(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            cid, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
            for s in slices(len(x), max(centers.shape[1], 1)):
                gap = x[s] - centers[cid[s]]
                total += np.bincount(cid[s], (gap * gap).sum(1), k)
        yield pa.record_batch([pa.array(np.arange(k), pa.int32()), pa.array(total)], names=["cid", "ss"])

    out = np.zeros(k)
    for r in labelled.select(F.col("cid").cast("int").alias("cid"), "x").mapInArrow(run, "cid int, ss double").groupBy("cid").agg(F.sum("ss").alias("ss")).collect():
        out[r["cid"]] = r["ss"]
    return out


def wcss(points: DataFrame, assignments: DataFrame, centers: np.ndarray) -> np.ndarray:
    """The same for labels that are stored apart from the observations."""
    return labelled_wcss(points.join(assignments, "obs_id").select("cid", "x"), centers)


def assigned_wcss(points: DataFrame, label_centers: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The same where labels are those of the nearest of label_centers: no join."""
    k = len(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            x = matrix(batch.column(0))
            for s in slices(len(x), k):
                cid = squared_distances(x[s], label_centers).argmin(1)
                gap = x[s] - centers[cid]
                total += np.bincount(cid, (gap * gap).sum(1), k)
        yield pa.record_batch([pa.array(np.arange(k), pa.int32()), pa.array(total)], names=["cid", "ss"])

    out = np.zeros(k)
    for r in points.select("x").mapInArrow(run, "cid int, ss double").groupBy("cid").agg(F.sum("ss").alias("ss")).collect():
        out[r["cid"]] = r["ss"]
    return out


def assign_and_sum(points: DataFrame, centers: np.ndarray, previous: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
    """One refinement pass: sizes and centroids by nearest centre, and how many labels differ from those by `previous` (None: 0)."""
    k, d = centers.shape
    if unrolled(centers):
        x = F.col("x")
        named = points.select(*[x[j].alias(f"x{j}") for j in range(d)], nearest_struct(x, centers)["cid"].alias("cid"), (nearest_struct(x, previous)["cid"] if previous is not None else F.lit(0)).alias("old"))
        grouped = named.groupBy("cid").agg(F.count("*").alias("n"), F.sum((F.col("cid") != F.col("old")).cast("long")).alias("moved"), *[F.sum(f"x{j}").alias(f"s{j}") for j in range(d)])
        rows = grouped.select("cid", "n", "moved", F.array(*[F.col(f"s{j}") for j in range(d)]).alias("s")).collect()
        return *_dense(rows, k, d), sum(r["moved"] for r in rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, moved, s = np.zeros(k, np.int64), np.zeros(k), np.zeros((k, d))
        for batch in batches:
            x = matrix(batch.column(0))
            for part in slices(len(x), k):
                cid = squared_distances(x[part], centers).argmin(1)
                old = squared_distances(x[part], previous).argmin(1) if previous is not None else 0
                n += np.bincount(cid, minlength=k)
                moved += np.bincount(cid, cid != old, k)
                order = np.argsort(cid, kind="stable")
                starts = np.flatnonzero(np.diff(cid[order], prepend=-1))
                s[cid[order][starts]] += np.add.reduceat(x[part][order], starts, axis=0)
        yield from _partial(n, np.column_stack([moved, s]))

    rows = _sum_arrays(points.select("x").mapInArrow(run, PARTIAL)).collect()
    found = [{"cid": r["cid"], "n": r["n"], "s": r["s"][1:]} for r in rows]
    return *_dense(found, k, d), int(round(sum(r["s"][0] for r in rows)))


def moments(labelled: DataFrame, d: int) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Of each cluster of labelled (cid, x): members, mean, and sum of squares about the mean by dimension.

    Tasks return means and sums of squares about these, which merge without cancellation, in order of task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, tuple] = {}
        for batch in batches:
            cid, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
            for c in np.unique(cid).tolist():
                some = x[cid == c]
                mean = some.mean(0)
                held[c] = _merged(held.get(c), (len(some), mean, ((some - mean) ** 2).sum(0)))
        if held:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()] * len(held), pa.int32()), pa.array([*held], pa.int32()), pa.array([v[0] for v in held.values()], pa.int64()), *(pa.array([v[i] for v in held.values()], pa.list_(pa.float64())) for i in (1, 2))], names=["task", "cid", "n", "mean", "ss"])

    out: dict[int, tuple] = {}
    for r in sorted(labelled.select(F.col("cid").cast("int").alias("cid"), "x").mapInArrow(run, "task int, cid int, n long, mean array<double>, ss array<double>").collect(), key=lambda r: r["task"]):
        out[r["cid"]] = _merged(out.get(r["cid"]), (r["n"], np.array(r["mean"]), np.array(r["ss"])))
    return out


def _merged(a: tuple | None, b: tuple) -> tuple:
    if a is None:
        return b
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + gap * gap * (a[0] * b[0] / n)
