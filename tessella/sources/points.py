"""Observations: rows (obs_id BIGINT, x ARRAY<DOUBLE>) with dense ids from 0.

Scans keep the plan declarative, so filters on obs_id and the choice of columns reach the Parquet reader.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_array(df: DataFrame, obs_id: str, x: str) -> DataFrame:
    """Any numeric array column, cast to double once."""
    return df.select(F.col(obs_id).cast("long").alias("obs_id"), F.col(x).cast("array<double>").alias("x"))


def from_columns(df: DataFrame, obs_id: str | Column, columns: Sequence[str | Column]) -> DataFrame:
    """Coordinates from numeric columns."""
    cast = [(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns]
    key = F.col(obs_id) if isinstance(obs_id, str) else obs_id
    return df.select(key.cast("long").alias("obs_id"), F.array(*cast).alias("x"))


def read_points(spark: SparkSession, path: str, obs_id: str, x: str | Sequence[str], source: str = "parquet", **options: str) -> DataFrame:
    """From any source that Spark reads."""
    df = spark.read.format(source).options(**options).load(path)
    return from_array(df, obs_id, x) if isinstance(x, str) else from_columns(df, obs_id, x)


def from_matrix(spark: SparkSession, data: np.ndarray) -> DataFrame:
    """A small in-memory matrix with a row for each observation."""
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(np.asarray(data))]
    return spark.createDataFrame(rows, "obs_id long, x array<double>")


def dense_ids(df: DataFrame, *order: str) -> DataFrame:
    """obs_id 0 .. n - 1 by the given columns, in two passes over stored range partitions: their counts, then numbers within each.

    Rows equal in all of `order` are interchangeable. Only one number for each partition reaches the driver.
    """
    parted = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_within", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    from tessella.plans.session import durable

    parted = durable(parted)  # drawn anew, range bounds might number rows twice
    sizes = sorted((r["_part"], r["count"]) for r in parted.groupBy("_part").count().collect())
    before, starts = 0, {}
    for part, n in sizes:
        starts[part] = before
        before += n
    base = F.element_at(F.create_map(*[F.lit(v) for pair in starts.items() for v in pair]), F.col("_part")) if starts else F.lit(0)
    return parted.withColumn("obs_id", base + F.col("_within")).drop("_part", "_within")


def count(points: DataFrame) -> int:
    return points.count()


def dimensions(points: DataFrame) -> int:
    """d of the first row, or 0; validate() checks that all rows agree."""
    first = points.select(F.size("x").alias("d")).first()
    return first["d"] if first else 0


def validate(points: DataFrame) -> tuple[int, int]:
    """(n, d). Raises on null, NaN or ragged coordinates, and on ids that are not 0 .. n - 1."""
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v))
    r = points.agg(
        F.count("*").alias("n"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high"), F.count_if(F.col("x").isNull() | bad).alias("bad"),
        F.min("obs_id").alias("first"), F.max("obs_id").alias("last"), F.count_distinct("obs_id").alias("ids"),
    ).first()
    if r["bad"]:
        raise ValueError(f"{r['bad']} observations with null or NaN coordinates")
    if r["n"] and r["low"] != r["high"]:
        raise ValueError(f"observations of {r['low']} to {r['high']} dimensions")
    if r["n"] and (r["first"], r["last"], r["ids"]) != (0, r["n"] - 1, r["n"]):
        raise ValueError("obs_id must be 0 .. n - 1, each once")
    return r["n"], r["high"] or 0


def observation(points: DataFrame, obs_id: int) -> DataFrame:
    return points.where(F.col("obs_id") == obs_id)


def consecutive(points: DataFrame, start: int, length: int) -> DataFrame:
    return points.where((F.col("obs_id") >= start) & (F.col("obs_id") < start + length))


def indexed(points: DataFrame, ids: DataFrame) -> DataFrame:
    """Observations whose obs_id is in ids(obs_id); Spark broadcasts ids if their measured size allows."""
    return points.join(ids.select("obs_id").distinct(), "obs_id", "left_semi")


def gather(points: DataFrame, chosen: Sequence[int]) -> np.ndarray:
    """The chosen observations in the order of `chosen`, as a matrix; a list of at most k ids."""
    rows = {r["obs_id"]: r["x"] for r in points.where(F.col("obs_id").isin([int(i) for i in set(chosen)])).collect()} if len(chosen) else {}
    return np.array([rows[int(i)] for i in chosen], float).reshape(len(chosen), -1)



def centers_frame(spark: SparkSession, centers: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centers)], "cid int, c array<double>")



def write(df: DataFrame, path: str, sink: str = "parquet", mode: str = "errorifexists", **options: str) -> None:
    df.write.format(sink).options(**options).mode(mode).save(path)
