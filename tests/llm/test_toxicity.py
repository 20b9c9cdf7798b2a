import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import toxicity
from tessella.llm.common import labelled_sample

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = toxicity.op5_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert toxicity.op5_toxicity(spark, SF).count() == 1000
    assert got.score.between(0, 1).all()
    assert (got.predicted == got.toxic).mean() > 0.95
    assert got[got.toxic == 0].predicted.mean() < 0.02


def test_features_match_a_plain_loop():
    texts = ["Abcdé fgh", "", None, "ab", "abcabcabc", "ÀB\U0001f600cdef"]
    buckets = [[set() for _ in texts] for _ in toxicity.ORDERS]
    for k, (text, bucket, inside) in enumerate(toxicity.ngram_buckets(pa.array(texts))):
        for t, b in zip(text[inside], bucket[inside]):
            buckets[k][t].add(int(b))
    for k, n in enumerate(toxicity.ORDERS):
        for t, text in enumerate(texts):
            low = (text or "").lower()
            assert len(buckets[k][t]) == len({low[i : i + n] for i in range(len(low) - n + 1)})


def slow_buckets(text):
    """The buckets of a text's n-grams, with plain whole numbers."""
    low, out = (text or "").lower(), set()
    for n in toxicity.ORDERS:
        for i in range(len(low) - n + 1):
            h = ord(low[i]) * 2654435761 % 2**32
            for c in low[i + 1 : i + n]:
                h = (h * 2246822519 + ord(c)) % 2**32
            out.add((h ^ h >> 15) * 2654435761 % 2**32 >> 32 - toxicity.BUCKET_BITS)
    return out


def slow_scores(rows, labels, texts):
    """The classifier as the module's docstring defines it: dicts of n-grams, and Newton's method on the whole matrix."""
    rows = [(t, y) for _, t, y in sorted({(d, t, labels[d]) for d, t in rows if d in labels and t is not None})]
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    held = [slow_buckets(t) for t, _ in rows]
    a, b = Counter(f for x, (_, y) in zip(held, rows) if y for f in x), Counter(f for x, (_, y) in zip(held, rows) if not y for f in x)
    part = lambda x, e: x * math.log(x / e) if x > 0 else 0.0
    differs = {}
    for f in {*a, *b}:
        e = (a[f] + b[f]) * n1 / (n1 + n0)
        differs[f] = 2 * (part(a[f], e) + part(b[f], a[f] + b[f] - e) + part(n1 - a[f], n1 - e) + part(n0 - b[f], n0 - (a[f] + b[f] - e)))
    chosen = sorted((f for f in differs if differs[f] >= toxicity.SIGNIFICANCE), key=lambda f: (-differs[f], f))[: toxicity.FEATURES]
    ratio = np.array([math.log((a[f] + 1) / (n1 + 2)) - math.log((b[f] + 1) / (n0 + 2)) for f in chosen])
    matrix = lambda sets: np.array([[*((f in x) * r for f, r in zip(chosen, ratio)), 1.0] for x in sets])
    x, y, theta = matrix(held), np.array([y for _, y in rows]), np.zeros(len(chosen) + 1)
    ridge = np.append(np.full(len(chosen), toxicity.RIDGE * len(y)), 1e-9)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ theta))
        theta = theta - np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (p - y) + ridge * theta)
    return 1 / (1 + np.exp(-matrix([slow_buckets(t) for t in texts]) @ theta)), len(chosen)


def test_scores_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FEATURES", 150)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"][:1500]) for r in docs.collect()] + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "ÀB\U0001f600 xyz")]
    toxic = {i for i, t in rows if t and i % 3 == 0}
    rows = [(i, (t + " you vile idiot" * (1 + i % 3) if i in toxic and i % 2 else t)) for i, t in rows] + rows[:5]
    labels = {i: int(i in toxic) for i, _ in rows if i % 7}
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = toxicity.fit(frame, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    want, size = slow_scores(rows, labels, [t for _, t in rows])
    assert size == len(model.weight) > 20
    assert model.scores(pa.array([t for _, t in rows])) == pytest.approx(want, abs=1e-4)
    assert 0.1 < want.std()


def test_odd_input(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "you idiot", 5), (3, "x " * 200000, 5), (3, "x " * 200000, 5)], "doc_id long, text string, Score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one_class = spark.createDataFrame([(3, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    for labels in (none, one_class):
        scored = toxicity.scored(docs, toxicity.fit(docs, labels))
        got = scored.select("doc_id", "Score", "score_1").collect()
        assert len(got) == 5 and all(0 <= x["score_1"] <= 1 and x["Score"] == 5 for x in got)
    assert toxicity.scored(docs.select("doc_id", "text").limit(0), toxicity.fit(docs, none)).collect() == []
    assert toxicity.scored(docs, toxicity.fit(docs, none), keep=0.5).count() == 5


def test_null_ids_are_of_no_fold(spark):
    rows = spark.createDataFrame([(None,), (1,)], "doc_id long").select(toxicity.held_out().alias("x")).collect()
    assert [r["x"] for r in rows][0] is False


def test_sample_does_not_depend_on_file_layout(spark):
    """Nor do labels without a document or text use it up, nor do repeated rows."""
    rows = [(i, f"text {i} " + "x" * (i % 90), i % 2) for i in range(300)] + [(i, None, 1) for i in range(300, 400)]
    rows += [(7, rows[7][1], 1), (8, "another text", 0), (None, "no id", 1)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1200)] + [(None, 1), (5, None)], "doc_id long, label int")
    order = [r[0] for r in spark.range(300).orderBy(F.xxhash64("id"), "id").collect()]
    order.insert(order.index(8), 8)  # of two texts
    found = []
    for some in (rows, sorted(rows, key=lambda r: (r[2], -(r[0] or 0)))):
        docs = spark.createDataFrame(some, "doc_id long, text string, side int").coalesce(1)
        got = labelled_sample(docs, labels, 200, 5)
        assert got.rdd.getNumPartitions() <= 5
        found.append(sorted(map(tuple, got.collect())))
        assert [x[0] for x in found[-1]] == sorted(order[:200])
        assert len(labelled_sample(docs, labels, 1000, 3).collect()) == 301
    assert found[0] == found[1]
    assert all(t in [y for d, y, _ in rows if d == i] and label == i % 2 for i, t, label in found[0])
