"""A whole clustering: one seeding and one refinement."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.aggregate import assigned_wcss, wcss
from tessella.operators.compact import remove_unused_centers
from tessella.operators.refine import REFINEMENTS, Details, Refined, Refinement
from tessella.operators.seeding import Given, KmeansPlusPlus, Random, Seeding, VariancePartition
from tessella.sources.points import centers_frame, validate, write

SEEDINGS = {"given": Given, "random": Random, "kmeans++": KmeansPlusPlus, "variance-partition": VariancePartition}


@dataclass
class Results:
    points: DataFrame
    clusters: DataFrame  # obs_id, cid
    centers: np.ndarray  # k rows; those that the seeding didn't find are zeros
    details: Details
    refined: Refined

    def centers_frame(self) -> DataFrame:
        return centers_frame(self.points.sparkSession, self.centers)

    def details_frame(self) -> DataFrame:
        d = self.details
        return self.points.sparkSession.createDataFrame([([int(s) for s in d.sizes], d.iterations, d.status)], "sizes array<bigint>, iterations int, status int")

    def wcss(self) -> np.ndarray:
        if self.refined.label_centers is not None:
            return np.append(assigned_wcss(self.points, self.refined.label_centers, self.refined.centers), np.zeros(len(self.centers) - len(self.refined.centers)))
        return wcss(self.points, self.clusters, self.centers)

    def summary(self) -> DataFrame:
        """(cid, size, wcss), one row for each centre."""
        rows = [(i, int(n), float(w)) for i, (n, w) in enumerate(zip(self.details.sizes, self.wcss()))]
        return self.points.sparkSession.createDataFrame(rows, "cid int, size long, wcss double")

    def compacted(self) -> tuple[DataFrame, np.ndarray, np.ndarray, int]:
        return remove_unused_centers(self.clusters, self.centers, self.details.sizes)

    def save(self, path: str, sink: str = "parquet", mode: str = "errorifexists") -> None:
        for name, df in (("clusters", self.clusters), ("centers", self.centers_frame()), ("details", self.details_frame())):
            write(df, f"{path}/{name}", sink, mode)


def compute(points: DataFrame, seeding: Seeding | str, refinement: Refinement | str, k: int, shape: tuple[int, int] | None = None) -> Results:
    """k clusters of points(obs_id, x). Parts can be named or given as objects with their options.

    shape: (n, d) where the caller has checked the points already; they are checked otherwise.
    """
    seeding = SEEDINGS[seeding]() if isinstance(seeding, str) else seeding
    refinement = REFINEMENTS[refinement]() if isinstance(refinement, str) else refinement
    n, d = shape or validate(points)
    seeds = seeding.run(points, n, d, k)
    found = refinement.run(points, n, d, seeds)
    centers, sizes = np.zeros((k, d)), np.zeros(k, np.int64)
    centers[: len(found.centers)] = found.centers
    sizes[: len(found.details.sizes)] = found.details.sizes
    return Results(points, found.clusters.select("obs_id", F.col("cid").cast("int").alias("cid")), centers, Details(sizes, found.details.iterations, found.details.status), found)
