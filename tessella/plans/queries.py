"""The registry of clustering queries. Every query reads its whole table; rounding only makes value hashes comparable."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.distance import adjusted_ss
from tessella.operators import aggregate, assign, refine, seeding
from tessella.operators.compact import remove_unused_centers
from tessella.plans.compute import compute
from tessella.sources import points as P

K = 10
#: Start centres of the lineitem clustering, in scaled units.
STARTS = [[0.1, 0.1, 0.2, 0.2], [0.9, 0.9, 0.8, 0.8], [0.5, 0.2, 0.8, 0.2], [0.3, 0.6, 0.2, 0.8]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.from_array(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("obs_id"), F.col("label").alias("cid"), F.col("embedding").cast("array<double>").alias("x"))


def jittered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings pulled 100 apart by label on the first dimension: the labels are the right clustering."""
    rows = labelled(spark, sf_dir)
    return rows.select("obs_id", F.transform("x", lambda v, j: F.when(j == 0, v + F.col("cid") * 100.0).otherwise(v)).alias("x"))


def jitter_starts(d: int) -> np.ndarray:
    out = np.zeros((K, d))
    out[:, 0] = 100.0 * np.arange(K)
    return out


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four scaled measures. The table has no key, so results are per cluster and obs_id is not read."""
    columns = [F.col("l_quantity") / 50, F.col("l_extendedprice") / 100000, F.col("l_discount") * 10, F.col("l_tax") * 12.5]
    return P.from_columns(table(spark, sf_dir, "lineitem"), F.lit(None), columns)


def first_centers(points: DataFrame, k: int = K) -> np.ndarray:
    return P.gather(points, range(k))


def r6(column: str):
    return (F.round(column, 6) + 0.0).alias(column)


def frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def long_form(spark: SparkSession, centers: np.ndarray) -> DataFrame:
    rows = [(i, j, float(v)) for i, c in enumerate(centers) for j, v in enumerate(c)]
    return frame(spark, rows, "cid int, dim int, value double").select("cid", "dim", r6("value"))


def row_count(spark, sf_dir):
    p = embeddings(spark, sf_dir)
    n, d = P.validate(p)
    return frame(spark, [(P.count(p), n, P.dimensions(p), d)], "n long, n_valid long, d int, d_valid int")


def scan_one(spark, sf_dir):
    return P.observation(embeddings(spark, sf_dir), 42).select("obs_id", F.posexplode("x").alias("dim", "value")).select("obs_id", "dim", r6("value"))


def scan_range(spark, sf_dir):
    return P.consecutive(embeddings(spark, sf_dir), 100, 50).select("obs_id", (F.round(F.col("x")[0], 6) + 0.0).alias("first"))


def scan_indexed(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("obs_id"))
    return P.indexed(embeddings(spark, sf_dir), ids).select("obs_id", (F.round(F.col("x")[0], 6) + 0.0).alias("first"))


def gather_rows(spark, sf_dir):
    return long_form(spark, P.gather(embeddings(spark, sf_dir), [7, 3, 3, 411]))


def nearest_center(spark, sf_dir):
    p = embeddings(spark, sf_dir)
    return assign.nearest(p, first_centers(p), with_distance=True).select("obs_id", "cid", r6("distance"))


def nearest_center_join(spark, sf_dir):
    p = embeddings(spark, sf_dir)
    centers = p.where(f"obs_id < {K}").select(F.col("obs_id").cast("int").alias("cid"), F.col("x").alias("c"))
    return assign.nearest_join(p, centers)


def two_nearest_centers(spark, sf_dir):
    p = embeddings(spark, sf_dir)
    return assign.two_nearest(p, first_centers(p))


def global_centroid(spark, sf_dir):
    p = embeddings(spark, sf_dir)
    return long_form(spark, aggregate.global_centroid(p, P.dimensions(p))[None, :]).select("dim", "value")


def cluster_centroids(spark, sf_dir):
    p = labelled(spark, sf_dir)
    sizes, centers = aggregate.centroids(p, K, P.dimensions(p))
    n = frame(spark, [(i, int(v)) for i, v in enumerate(sizes)], "cid int, size long")
    return long_form(spark, centers).join(F.broadcast(n), "cid")  # K rows


def empty_cluster_centroid(spark, sf_dir):
    """Cluster K has no members and gets the origin."""
    p = labelled(spark, sf_dir)
    return long_form(spark, aggregate.centroids(p, K + 1, P.dimensions(p))[1])


def cluster_sizes(spark, sf_dir):
    return frame(spark, [(i, int(n)) for i, n in enumerate(aggregate.sizes(labelled(spark, sf_dir), K + 1))], "cid int, size long")


def cluster_wcss(spark, sf_dir):
    p = labelled(spark, sf_dir)
    _, centers = aggregate.centroids(p, K + 1, P.dimensions(p))
    ss = aggregate.labelled_wcss(p, centers)
    return frame(spark, [(i, float(v)) for i, v in enumerate(ss)], "cid int, wcss double").select("cid", r6("wcss"))


def dim_sum_squares(spark, sf_dir):
    """By line number, the sums of squares of four measures, and their size-adjusted total."""
    measures = lineitem(spark, sf_dir).select("x")
    lines = table(spark, sf_dir, "lineitem")
    p = P.from_columns(lines, "l_linenumber", [F.col("l_quantity") / 50, F.col("l_extendedprice") / 100000, F.col("l_discount") * 10, F.col("l_tax") * 12.5]).withColumnRenamed("obs_id", "cid")
    found = aggregate.moments(p, P.dimensions(measures))
    rows = [(c, n, j, float(v), float(ss.sum())) for c, (n, _, ss) in found.items() for j, v in enumerate(ss)]
    df = frame(spark, rows, "cid int, n long, dim int, ss double, total double")
    return df.select("cid", "n", "dim", F.round("ss", 5).alias("ss"), F.round(adjusted_ss(F.col("total"), F.col("n"), 0.5), 5).alias("adjusted"))


def optimal_partition(spark, sf_dir):
    p = embeddings(spark, sf_dir)
    found = seeding.optimal_boundary(p.select(F.col("x")[0].alias("v")), p.count())
    return frame(spark, [(found,)], "boundary double").select(r6("boundary"))


def compact_clusters(spark, sf_dir):
    p = labelled(spark, sf_dir).where("cid % 2 = 0")
    sizes, centers = aggregate.centroids(p, K, P.dimensions(p))
    return remove_unused_centers(p.select("obs_id", "cid"), centers, sizes)[0]


def edge_k1(spark, sf_dir):
    p = P.from_columns(table(spark, sf_dir, "region"), "r_regionkey", ["r_regionkey"])
    got = compute(p, "random", "lloyd", 1)
    return frame(spark, [(int(got.details.sizes[0]), float(got.centers[0, 0]), got.details.iterations, got.details.status)], "size long, center double, iterations int, status int")


def edge_k_ge_n(spark, sf_dir):
    p = P.from_columns(table(spark, sf_dir, "nation"), "n_nationkey", ["n_nationkey", "n_regionkey"])
    got = compute(p, "random", "hartigan-wong", 30)
    sizes = frame(spark, [(i, int(n), float(c[0]), float(c[1])) for i, (n, c) in enumerate(zip(got.details.sizes, got.centers))], "cid int, size long, c0 double, c1 double")
    return sizes.join(got.clusters, "cid", "left").select("cid", "size", "c0", "c1", "obs_id")


def init_none(spark, sf_dir):
    p = embeddings(spark, sf_dir)
    n, d = p.count(), P.dimensions(p)
    return long_form(spark, seeding.Given(first_centers(p, 12)).run(p, n, d, 12))


def init_random(spark, sf_dir):
    p = embeddings(spark, sf_dir)
    return long_form(spark, seeding.Random().run(p, p.count(), P.dimensions(p), K))


def init_kmeanspp(spark, sf_dir):
    p = embeddings(spark, sf_dir)
    return long_form(spark, seeding.KmeansPlusPlus().run(p, p.count(), P.dimensions(p), 4))


def init_kmeanspp_10(spark, sf_dir):
    p = embeddings(spark, sf_dir)
    return long_form(spark, seeding.KmeansPlusPlus(seed=42).run(p, p.count(), P.dimensions(p), K))


def _varpart(spark, sf_dir, optimal, k=3):
    p = embeddings(spark, sf_dir)
    return long_form(spark, seeding.VariancePartition(optimize_partition=optimal).run(p, p.count(), P.dimensions(p), k))


def init_varpart_mean(spark, sf_dir):
    return _varpart(spark, sf_dir, False)


def init_varpart_opt(spark, sf_dir):
    return _varpart(spark, sf_dir, True)


def init_varpart_10(spark, sf_dir):
    return _varpart(spark, sf_dir, True, K)


def lloyd(spark, sf_dir):
    p = embeddings(spark, sf_dir)
    return compute(p, seeding.Given(first_centers(p)), "lloyd", K).summary().select("cid", "size", r6("wcss"))


def lloyd_details(spark, sf_dir):
    """How Lloyd ends on separated clusters, and on others within 2 and 25 passes."""
    rows = []
    for name, p, start, limit in (("separated", jittered(spark, sf_dir), jitter_starts, 10), ("two passes", embeddings(spark, sf_dir), None, 2), ("many passes", embeddings(spark, sf_dir), None, 25)):
        got = compute(p, seeding.Given(start(P.dimensions(p)) if start else first_centers(p)), refine.Lloyd(limit), K).details
        rows.append((name, got.iterations, got.status, [int(n) for n in got.sizes]))
    return frame(spark, rows, "name string, iterations int, status int, sizes array<bigint>").selectExpr("name", "iterations", "status", "posexplode(sizes) as (cid, size)")


def points_round_trip(spark, sf_dir):
    """Centres, labels and details, written and read again as points."""
    from tessella.plans.session import shared_path

    path = shared_path(spark, "round-trip")
    compute(jittered(spark, sf_dir), seeding.Given(jitter_starts(64)), "lloyd", K).save(path)
    centers = P.read_points(spark, f"{path}/centers", "cid", "c").select("obs_id", F.col("x")[0].alias("first"))
    sizes = spark.read.parquet(f"{path}/details").selectExpr("posexplode(sizes) as (obs_id, size)")
    counted = spark.read.parquet(f"{path}/clusters").groupBy(F.col("cid").alias("obs_id")).agg(F.count("*").alias("labels"))
    return centers.join(sizes, "obs_id").join(counted, "obs_id").select("obs_id", r6("first"), "size", "labels")


def lloyd_lineitem(spark, sf_dir):
    p = lineitem(spark, sf_dir)
    got = compute(p, seeding.Given(np.array(STARTS)), "lloyd", 4, shape=(p.count(), 4))
    return got.summary().select("cid", "size", F.round("wcss", 4).alias("wcss"))


def hartigan_wong(spark, sf_dir):
    p = jittered(spark, sf_dir)
    return compute(p, seeding.Given(jitter_starts(P.dimensions(p))), "hartigan-wong", K).clusters


def hartigan_wong_free(spark, sf_dir):
    p = embeddings(spark, sf_dir)
    return compute(p, seeding.Given(first_centers(p)), "hartigan-wong", K).summary().select("cid", "size", r6("wcss"))


def minibatch(spark, sf_dir):
    p = jittered(spark, sf_dir)
    kind = refine.MiniBatch(max_iterations=12, batch_size=200)
    return compute(p, seeding.Given(jitter_starts(P.dimensions(p))), kind, K).clusters


def minibatch_steps(spark, sf_dir):
    p = embeddings(spark, sf_dir)
    kind = refine.MiniBatch(max_iterations=2, batch_size=60)
    return compute(p, seeding.Given(first_centers(p)), kind, K).summary().select("cid", "size", r6("wcss"))


def compute_pipeline(spark, sf_dir):
    p = jittered(spark, sf_dir)
    return compute(p, seeding.Given(jitter_starts(P.dimensions(p))), "lloyd", K).summary().select("cid", "size", r6("wcss"))


QUERIES = [
    row_count, scan_one, scan_range, scan_indexed, gather_rows, nearest_center, nearest_center_join, two_nearest_centers, global_centroid, cluster_centroids,
    empty_cluster_centroid, cluster_sizes, cluster_wcss, dim_sum_squares, optimal_partition, compact_clusters, edge_k1, edge_k_ge_n, init_none, init_random,
    init_kmeanspp, init_kmeanspp_10, init_varpart_mean, init_varpart_opt, init_varpart_10, lloyd, lloyd_details, points_round_trip, lloyd_lineitem, hartigan_wong, hartigan_wong_free, minibatch, minibatch_steps, compute_pipeline,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
