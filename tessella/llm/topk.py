"""Exact top-k inner products by tiled matrix products.

Vectors are packed into tiles, one row each. A query tile meets a shard tile by an equi-join on (query
tile, lane): a shard has one lane and a copy for each query tile, a query tile a copy for each lane. So
work spreads over (query tiles x lanes) keys of equal weight, whatever the data. Each meeting is one
matrix product with a partial selection of k per query; a task carries the running lists of the tiles
that it meets in turn. Lists of lanes then merge as a tree, `FAN` lanes to one at each level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import stored, table

K = 5
SCALE = 256.0
QUERY_TILE = 1024
SHARD_TILE = 4096
FAN = 32
_LONG = (-(2**63), 2**63 - 1)


def tiles(vectors: DataFrame, rows: int, scale: float = SCALE) -> DataFrame:
    """(tile, block, dim, ids, small, data): vectors (vec_id, embedding, block) as floor(scale * x), at most `rows` of one block
    packed together; float64 holds these integers exactly. A block goes with its rows, so it is the same however they are partitioned.

    Left out: null ids and vectors, and vectors with a null or non-finite component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        waiting: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        held: dict[tuple[int, int], int] = {}

        def flush(key: tuple[int, int]) -> pa.RecordBatch:
            nonlocal number
            ids, data = (np.concatenate(x) for x in zip(*waiting.pop(key)))
            held.pop(key)
            small = np.abs(data).max(initial=0) < 2**15
            body = data.astype(np.int16 if small else np.float64).tobytes()
            number += 1
            columns = [pa.array([number - 1], pa.int64()), pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([small]), pa.array([body], pa.binary())]
            return pa.record_batch(columns, names=["tile", "block", "dim", "ids", "small", "data"])

        for batch in batches:
            vectors_ = batch.column(1)
            sizes = np.where(vectors_.is_null().to_numpy(zero_copy_only=False), -1, vectors_.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False))
            for dim in np.unique(sizes[sizes >= 0]).tolist():
                at = np.flatnonzero(sizes == dim)
                some = batch.take(pa.array(at))
                flat = some.column(1).flatten()
                matrix = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
                good = np.isfinite(matrix).all(1) & ~some.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = some.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[good]
                block = some.column(2).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[good]
                matrix = np.floor(matrix[good] * scale)
                for one in np.unique(block).tolist():
                    rest, key = np.flatnonzero(block == one), (one, dim)
                    while len(rest):
                        taken, rest = np.split(rest, [rows - held.get(key, 0)])
                        waiting.setdefault(key, []).append((ids[taken], matrix[taken]))
                        held[key] = held.get(key, 0) + len(taken)
                        if held[key] == rows:
                            yield flush(key)
        for key in [*waiting]:
            yield flush(key)

    return vectors.mapInArrow(run, "tile long, block long, dim int, ids binary, small boolean, data binary")


def unpack(ids: bytes, data: bytes, small: bool, dim: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(ids, np.int64)
    return numbers, np.frombuffer(data, np.int16 if small else np.float64).astype(np.float64).reshape(len(numbers), dim)


def best_of_tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, vec_id, score) of each query's k best rows of the tile, ties to smaller ids; scores are exact integers."""
    order = np.argsort(ids, kind="stable")
    ids, data = ids[order], data[order]
    bound = np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * max(data.shape[1], 1)
    if bound * (len(ids) + 1) < 2**52:
        # One integer for score and place: a larger one is better.
        value = (queries @ data.T).astype(np.int64) * len(ids) + np.arange(len(ids) - 1, -1, -1)
        value[query_ids[:, None] == ids[None, :]] = np.iinfo(np.int64).min
        if k < len(ids):
            pick = np.argpartition(value, len(ids) - k, axis=1)[:, len(ids) - k :]
        else:
            pick = np.broadcast_to(np.arange(len(ids)), value.shape)
        value = np.take_along_axis(value, pick, 1)
        query, column = np.nonzero(value != np.iinfo(np.int64).min)
        return query, ids[pick[query, column]], value[query, column] // len(ids)
    # Large components: exact whole numbers of any size, a query at a time; they compare as the longs that return.
    whole = data.astype(object)
    to_int = np.vectorize(int, otypes=[object])
    whole, out = to_int(whole) if whole.size else whole, ([], [], [])
    for q, (own, vector) in enumerate(zip(query_ids, queries)):
        score = whole @ to_int(vector) if whole.size else np.zeros(len(ids), object)
        ranked = sorted((-min(max(s, _LONG[0]), _LONG[1]), i) for s, i in zip(score, ids.tolist()) if i != own)[:k]
        for s, i in ranked:
            out[0].append(q)
            out[1].append(i)
            out[2].append(-s)
    return np.array(out[0], np.int64), np.array(out[1], np.int64), np.array(out[2], np.int64)


def _ranked(df: DataFrame, k: int, *by: str) -> DataFrame:
    """Per key, the k best rows and their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: float = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for every row of vectors (vec_id, embedding) with is_query.

    Vectors of another length are no candidates. Rows with a query's own vec_id are none either. Where
    vec_ids repeat, each row is a candidate of its own, and of a repeated query's rows the best k count.
    A score beyond a long's range counts as that range's nearest end, so such scores tie.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("asks"))
    chosen = vectors.where("asks").select("vec_id", "embedding")
    blocks = max(1, -(-chosen.count() // QUERY_TILE))
    lanes = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * 3 // blocks)
    # A query's block follows from its id; dealing the queries out by block only makes for fuller tiles.
    chosen = chosen.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    asking = stored(tiles(chosen.repartition(blocks, "block"), QUERY_TILE, scale), "topk-queries", "snappy")
    asking = asking.select("block", "dim", F.col("tile").alias("q_tile"), F.col("ids").alias("q_ids"), F.col("small").alias("q_small"), F.col("data").alias("q_data"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    shards = tiles(vectors.select("vec_id", "embedding", F.lit(0).cast("long").alias("block")), SHARD_TILE, scale).drop("block")
    shards = shards.withColumn("lane", F.pmod(F.xxhash64("tile"), F.lit(lanes)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    meetings = asking.join(shards, ["block", "lane", "dim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, query_ids, lists = None, None, None

        def flush() -> Iterator[pa.RecordBatch]:
            if key is not None:
                query, ids, score = lists
                yield pa.record_batch([pa.array(query_ids[query]), pa.array(np.full(len(query), key[0], np.int64)), pa.array(np.full(len(query), key[1], np.int32)), pa.array(ids), pa.array(score)], names=["query_id", "q_tile", "lane", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(n)[i].as_py() for n, name in enumerate(batch.schema.names)}
                if key != (row["q_tile"], row["lane"]):
                    yield from flush()
                    key, lists = (row["q_tile"], row["lane"]), (np.empty(0, np.int64),) * 3
                    query_ids, queries = unpack(row["q_ids"], row["q_data"], row["q_small"], row["dim"])
                found = best_of_tile(query_ids, queries, *unpack(row["ids"], row["data"], row["small"], row["dim"]), k)
                query, ids, score = (np.concatenate(x) for x in zip(lists, found))
                order = np.lexsort((ids, ~score, query))  # the complement descends as the score ascends, without overflow
                query, ids, score = query[order], ids[order], score[order]
                head = np.flatnonzero(np.append(True, query[1:] != query[:-1])[: len(query)])
                place = np.arange(len(query)) - np.repeat(head, np.diff(np.append(head, len(query))))
                lists = query[place < k], ids[place < k], score[place < k]
        yield from flush()

    best = meetings.mapInArrow(run, "query_id long, q_tile long, lane int, vec_id long, score long")
    while lanes > FAN:
        lanes = -(-lanes // FAN)
        best = _ranked(best.withColumn("lane", (F.col("lane") / FAN).cast("int")), k, "query_id", "lane").drop("rank")
    return _ranked(best, k, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
