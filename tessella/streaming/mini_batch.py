"""Mini-batch clustering of a stream of observations (an addition: batch clusterings need no stream).

Every micro-batch is one aggregation: its sums by nearest centre lower into running means, so no rows reach
the driver. The state (centres and counts) is a small table, rewritten after each micro-batch under its
number, so that a restarted query does not count a micro-batch twice.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.aggregate import assign_and_sum
from tessella.operators.assign import nearest


@dataclass
class StreamingMiniBatch:
    centers: np.ndarray
    state_path: str
    counts: np.ndarray = field(default=None)
    last: int = -1

    def __post_init__(self) -> None:
        self.centers = np.array(self.centers, float)
        self.counts = np.zeros(len(self.centers), np.int64) if self.counts is None else self.counts

    def update(self, points: DataFrame, number: int) -> None:
        """Takes in micro-batch `number` of points(obs_id, x), once."""
        spark = points.sparkSession
        self._restore(spark)
        if number <= self.last:
            return
        n, means, _ = assign_and_sum(points, self.centers, None)
        total = self.counts + n
        some = n > 0
        self.centers[some] += (means[some] - self.centers[some]) * (n[some] / total[some])[:, None]
        self.counts, self.last = total, number
        rows = [(number, i, int(c), [float(v) for v in x]) for i, (c, x) in enumerate(zip(self.counts, self.centers))]
        spark.createDataFrame(rows, "number long, cid int, n long, c array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.state_path}/number={number}")

    def _restore(self, spark) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.state_path)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if self.last >= 0 or not store.exists(path):
            return
        done = [int(s.getPath().getName().split("=")[1]) for s in store.listStatus(path) if store.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        if done:
            rows = sorted(spark.read.parquet(f"{self.state_path}/number={max(done)}").select("cid", "n", "c").collect())
            self.counts, self.centers, self.last = np.array([r["n"] for r in rows]), np.array([r["c"] for r in rows], float), max(done)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """stream: a streaming DataFrame (obs_id, x)."""
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def predict(self, points: DataFrame) -> DataFrame:
        return nearest(points, self.centers)
