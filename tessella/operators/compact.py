"""Renumbering of clusters so that those without members come last."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remove_unused_centers(assignments: DataFrame, centers: np.ndarray, sizes: np.ndarray) -> tuple[DataFrame, np.ndarray, np.ndarray, int]:
    """(assignments, centers, sizes, clusters with members): the order stays, the tail is zeros; nothing changes if all have members."""
    used = np.flatnonzero(sizes)
    if len(used) == len(sizes):
        return assignments, centers, sizes, len(used)
    new_centers, new_sizes = np.zeros_like(centers), np.zeros_like(sizes)
    new_centers[: len(used)], new_sizes[: len(used)] = centers[used], sizes[used]
    place = F.array_position(F.array(*[F.lit(int(c)) for c in used]), F.col("cid")) - 1  # k literals: no join
    others = [c for c in assignments.columns if c != "cid"]
    return assignments.select(*others, place.cast("int").alias("cid")), new_centers, new_sizes, len(used)
