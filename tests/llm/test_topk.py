import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.llm import topk


@pytest.mark.parametrize("size", [1.0, 1e6, 1e9])
def test_matches_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "QUERY_TILE", 3)
    monkeypatch.setattr(topk, "SHARD_TILE", 7)
    monkeypatch.setattr(topk, "FAN", 2)
    r = random.Random(4)
    rows = [(i, [round(r.uniform(-1, 1), 1) * size for _ in range(4)]) for i in range(150)]
    rows += [(i + 1000, v) for i, v in rows[:20]]  # ties
    rows += [(2000, None), (2001, [1.0, None, 1.0, 1.0]), (2002, [1.0, float("nan"), 1.0, 1.0]), (2003, [float("inf")] * 4), (2010, [1.0, 2.0]), (2004, [3.0, 1.0]), (None, [1.0] * 4), (2020, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(5)
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, a in good:
        if q % 10 == 0:
            near = sorted((-min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1), c) for c, b in good if c != q and len(a) == len(b))[:5]
            want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(near)]
    got = topk.top_k(df, F.col("vec_id") % 10 == 0).collect()
    assert sorted(tuple(x) for x in got) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []


@pytest.mark.parametrize("parts", [1, 7, 211])
def test_any_number_of_partitions(spark, monkeypatch, parts):
    """Every query comes back whole however many partitions Spark makes, also where it makes others than asked for."""
    kind = type(spark.range(0))
    dealt = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, n, *by: dealt(self, parts, *by) if by else dealt(self, n))
    monkeypatch.setattr(topk, "QUERY_TILE", 5)
    r = random.Random(parts)
    rows = [(i, [r.randrange(-9, 9) / 2 for _ in range(3)]) for i in range(400)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0).collect()
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = []
    for q, a in whole[::10]:
        near = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in whole if c != q)[:5]
        want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(near)]
    assert sorted(map(tuple, got)) == want


def test_large_scores_keep_their_order_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_TILE", 2)
    rows = [(i, [float(2**22), (1 + i) / 256]) for i in range(120)]  # scores near 2^60 that differ by 1
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), F.col("vec_id") == 0).collect()
    whole = [(2**30, 1 + i) for i in range(120)]
    near = sorted((-(whole[0][0] * b[0] + whole[0][1] * b[1]), i) for i, b in enumerate(whole) if i)[:5]
    assert [(x["vec_id"], x["score"]) for x in sorted(got, key=lambda x: x["rank"])] == [(i, -s) for s, i in near]
    assert [i for _, i in near] == [119, 118, 117, 116, 115]
