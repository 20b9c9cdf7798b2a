"""Refinements: Lloyd, Hartigan-Wong, mini-batch.

Each has run(points, n, d, centers) and returns a Refined: the centres whose nearest ones are the labels (or
the labels themselves), the final centres, and details. Status 0: converged; 2: iteration limit;
4: quick-transfer limit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.aggregate import assign_and_sum, centroids, global_centroid
from tessella.operators.assign import matrix, nearest, squared_distances, two_nearest
from tessella.operators.seeding import sample_key


@dataclass
class Details:
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    iterations: int = 0
    status: int = 0


@dataclass
class Refined:
    clusters: DataFrame  # obs_id, cid
    centers: np.ndarray
    details: Details
    label_centers: np.ndarray | None = None  # labels are the nearest of these, if so


class Refinement(Protocol):
    def run(self, points: DataFrame, n: int, d: int, centers: np.ndarray) -> Refined: ...


def is_edge_case(n: int, k: int) -> bool:
    return k <= 1 or k >= n


def edge_case(points: DataFrame, n: int, d: int, centers: np.ndarray) -> Refined:
    """One cluster: the mean of all. As many as observations or more: each its own, in order. None: nothing."""
    k = len(centers)
    if k == 1:
        return Refined(points.select("obs_id", F.lit(0).alias("cid")), global_centroid(points, d)[None, :], Details(np.array([n])))
    if not k:
        return Refined(points.select("obs_id", F.lit(0).alias("cid")), centers, Details())
    own = np.zeros((k, d))
    for r in points.collect():  # n <= k rows
        own[r["obs_id"]] = r["x"]
    return Refined(points.select("obs_id", F.col("obs_id").cast("int").alias("cid")), own, Details(np.append(np.ones(n, np.int64), np.zeros(k - n, np.int64))))


@dataclass
class Lloyd:
    """Batch reassignment. One job per pass; previous labels are recomputed from the previous centres, so no labels are stored."""

    max_iterations: int = 10

    def run(self, points: DataFrame, n: int, d: int, centers: np.ndarray) -> Refined:
        k = len(centers)
        if is_edge_case(n, k):
            return edge_case(points, n, d, centers)
        before, now, sizes = None, np.asarray(centers, float), np.zeros(k, np.int64)
        status, iteration = 2, 0
        for iteration in range(1, self.max_iterations + 1):
            found, means, moved = assign_and_sum(points, now, before)
            if iteration > 1 and not moved:
                status = 0
                break
            sizes, before, now = found, now, means
        if before is None:
            return Refined(points.select("obs_id", F.lit(0).alias("cid")), now, Details(sizes, 0, 2))
        return Refined(nearest(points, before), now, Details(sizes, iteration, status), before)


@dataclass
class MiniBatch:
    """Running means over sampled batches. A batch is at most `batch_size` rows and is worked on by the driver; the last
    assignment and the final centroids cover all observations."""

    max_iterations: int = 100
    batch_size: int = 500
    max_change_proportion: float = 0.01
    convergence_history: int = 10
    seed: int = 1234567890

    def run(self, points: DataFrame, n: int, d: int, centers: np.ndarray) -> Refined:
        if self.convergence_history < 1:
            raise ValueError("convergence_history must be 1 or more")
        k = len(centers)
        if is_edge_case(n, k):
            return edge_case(points, n, d, centers)
        now = np.array(centers, float)
        total, sampled, changed = (np.zeros(k, np.int64) for _ in range(3))
        labels: dict[int, int] = {}  # of sampled observations; others had label 0
        status, iteration = 2, 0
        for iteration in range(self.max_iterations):
            batch = sorted((r["obs_id"], r["x"]) for r in points.orderBy(sample_key(self.seed, iteration, F.col("obs_id"))).limit(min(n, self.batch_size)).collect())
            ids, x = [i for i, _ in batch], np.array([v for _, v in batch], float)
            cid = squared_distances(x, now).argmin(1)
            for c in np.unique(cid):
                some = x[cid == c]
                total[c] += len(some)
                now[c] += (some - now[c]).sum(0) / total[c]
            if iteration:
                for i, c in zip(ids, cid.tolist()):
                    old = labels.get(i, 0)
                    sampled[old] += 1
                    if old != c:
                        sampled[c] += 1
                        changed[old] += 1
                        changed[c] += 1
                if iteration % self.convergence_history == 0:
                    if not (changed >= sampled * self.max_change_proportion).any():
                        status = 0
                        labels.update(zip(ids, cid.tolist()))
                        break
                    sampled[:], changed[:] = 0, 0
            labels.update(zip(ids, cid.tolist()))
        done = iteration + 1 if status == 0 else self.max_iterations
        found, means, _ = assign_and_sum(points, now, None)
        return Refined(nearest(points, now), means, Details(found, done, status), now)


@dataclass
class HartiganWong:
    """Exact single-point transfers. The two nearest centres are found by all tasks; the transfers are sequential by
    definition (each changes the centres that the next observation sees), so they run in one task, for observations of
    at most `max_bytes` (and `max_rows`, if given); more raise an error."""

    max_iterations: int = 10
    max_quick_transfer_iterations: int = 50
    quit_on_quick_transfer_convergence_failure: bool = False
    max_rows: int | None = None
    max_bytes: int = 1 << 30

    def run(self, points: DataFrame, n: int, d: int, centers: np.ndarray) -> Refined:
        k = len(centers)
        if is_edge_case(n, k):
            return edge_case(points, n, d, centers)
        if 8 * n * d > self.max_bytes or n > (self.max_rows or n):
            raise ValueError(f"{n} observations of {d} dimensions; Hartigan-Wong is sequential and takes at most max_bytes = {self.max_bytes}, max_rows = {self.max_rows}. Use Lloyd or MiniBatch.")
        from tessella.plans.session import durable

        near = two_nearest(points, centers, keep_x=True).withColumn("all", F.lit(0))
        limits = (self.max_iterations, self.max_quick_transfer_iterations, self.quit_on_quick_transfer_convergence_failure)

        def transfer(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("obs_id").combine_chunks()
            best, iterations, status = hartigan_wong(matrix(rows["x"].combine_chunks()), rows["best"].to_numpy().astype(np.int64), rows["second"].to_numpy().astype(np.int64), k, *limits)
            return pa.table({"obs_id": rows["obs_id"], "cid": pa.array(best, pa.int32()), "iterations": pa.array(np.full(len(best), iterations), pa.int32()), "status": pa.array(np.full(len(best), status), pa.int32())})

        done = durable(near.groupBy("all").applyInArrow(transfer, "obs_id long, cid int, iterations int, status int"))
        first = done.first()
        clusters = done.select("obs_id", "cid")
        sizes, means = centroids(points.join(clusters, "obs_id").select("cid", "x"), k, d)
        return Refined(clusters, means, Details(sizes, first["iterations"], first["status"]))


def hartigan_wong(x: np.ndarray, best: np.ndarray, second: np.ndarray, k: int, max_iterations: int, max_quick: int, quit_on_quick: bool) -> tuple[np.ndarray, int, int]:
    """(labels, iterations, status).

    One clock orders all changes of clusters: it counts observations, is 0 as a stage of quick transfers
    begins and negative in the optimal pass before it. What changed less than a round ago is due again.
    """
    run = _Transfers(x, best.copy(), second.copy(), k)
    for iteration in range(1, max_iterations + 1):
        if run.optimal_pass():
            return run.best, iteration, 0
        had, converged = run.quick_stage(max_quick)
        run.recompute()
        if not converged and quit_on_quick:
            return run.best, iteration, 4
        if converged and k == 2:
            return run.best, iteration, 0
        if had:
            run.quiet = 0
    return run.best, max_iterations, 2


class _Transfers:
    def __init__(self, x: np.ndarray, best: np.ndarray, second: np.ndarray, k: int):
        self.x, self.n, self.k, self.best, self.second = x, len(x), k, best, second
        self.quiet = 0  # observations since the last transfer
        self.loss_of = np.zeros(self.n)  # what leaving its cluster saves, by observation
        self.live_until = np.full(k, self.n)  # a cluster is live for earlier observations; at first for all
        self.recompute()

    def recompute(self) -> None:
        self.size = np.bincount(self.best, minlength=self.k)
        self.centers = np.zeros((self.k, self.x.shape[1]))
        np.add.at(self.centers, self.best, self.x)
        self.centers /= np.maximum(self.size, 1)[:, None]
        size = self.size.astype(float)
        self.loss = np.where(size > 1, size / np.maximum(size - 1, 1), 1e30)
        self.gain = size / (size + 1)

    def cost(self, i: int, c: int) -> float:
        gap = self.x[i] - self.centers[c]
        return float(gap @ gap)

    def transfer(self, i: int, a: int, b: int) -> None:
        """Moves observation i from cluster a, of two members or more, to b; a becomes its second choice."""
        na, nb = float(self.size[a]), float(self.size[b])
        self.centers[a] = (self.centers[a] * na - self.x[i]) / (na - 1)
        self.centers[b] = (self.centers[b] * nb + self.x[i]) / (nb + 1)
        self.size[a] -= 1
        self.size[b] += 1
        self.loss[a], self.gain[a] = ((na - 1) / (na - 2) if na > 2 else 1e30), (na - 1) / na
        self.loss[b], self.gain[b] = ((nb + 1) / nb if nb else np.inf), (nb + 1) / (nb + 2)
        self.best[i], self.second[i] = b, a

    def optimal_pass(self) -> bool:
        """Each observation against all clusters that may have become better. True: a whole round without transfers."""
        changed = np.full(self.k, -1)  # in this pass: the observation
        for i in range(self.n):
            self.quiet += 1
            a = self.best[i]
            if self.size[a] != 1:
                self.loss_of[i] = self.cost(i, a) * self.loss[a]
                at = self.second[i]
                gain = self.cost(i, at) * self.gain[at]
                live = (changed >= 0) | (self.live_until > i)
                other = np.ones(self.k, bool) if live[a] else live
                other[[a, at]] = False
                other = np.flatnonzero(other)
                if len(other):
                    gap = self.centers[other] - self.x[i]
                    gains = np.einsum("ij,ij->i", gap, gap) * self.gain[other]
                    low = int(gains.argmin())
                    if gains[low] < gain:
                        gain, at = gains[low], int(other[low])
                if gain < self.loss_of[i]:
                    self.quiet = 0
                    self.transfer(i, a, at)
                    changed[[a, at]] = i
                else:
                    self.second[i] = at
            if self.quiet == self.n:
                return True
        self.changed_at = np.where(changed >= 0, changed - self.n, -3 * self.n)
        self.live_until = np.maximum(changed, 0)
        return False

    def quick_stage(self, rounds: int) -> tuple[bool, bool]:
        """Swaps between each observation's two choices. (had a transfer, converged)."""
        had, quiet = False, 0
        for now in range(rounds * self.n):
            i = now % self.n
            quiet += 1
            a, b = self.best[i], self.second[i]
            if self.size[a] != 1:
                since = now - self.n  # when this observation was last here
                if self.changed_at[a] >= since:
                    self.loss_of[i] = self.cost(i, a) * self.loss[a]
                if max(self.changed_at[a], self.changed_at[b]) > since and self.cost(i, b) * self.gain[b] < self.loss_of[i]:
                    had, quiet = True, 0
                    self.transfer(i, a, b)
                    self.changed_at[[a, b]] = now
                    self.live_until[[a, b]] = self.n
            if quiet == self.n:
                return had, True
        return had, False


REFINEMENTS: dict[str, Callable[..., Refinement]] = {"lloyd": Lloyd, "hartigan-wong": HartiganWong, "mini-batch": MiniBatch}
