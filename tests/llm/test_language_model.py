import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import language_model as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens_of(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def held(doc):
    return doc is None or zlib.crc32(str(doc).encode()) % 5 == 1


def slow(rows, order):
    """The model as its docstring defines it, with exact estimates in the expectation step."""
    def grams(t, n):
        full = [("<",)] * (n - 1) + t
        return [tuple(full[i : i + n]) for i in range(len(t))]

    texts = [(d, tokens_of(t)) for d, t in rows]
    learn = [t for d, t in texts if not held(d)]
    c = [Counter(g for t in learn for g in grams(t, n)) for n in range(1, order + 1)]
    total, v = sum(c[0].values()), len(c[0])

    def look(t, less):
        out, of = [], [grams(t, n) for n in range(1, order + 1)]
        for i in range(len(t)):
            ctx, p = [total - less], [(c[0][(t[i],)] - less) / (total - less)]
            for n in range(2, order + 1):
                g = of[n - 1][i]
                short = g[:-1]
                while len(short) > 1 and short[0] == ("<",) and short[1] == ("<",):
                    short = short[1:]
                k = len(learn) if set(short) == {("<",)} else c[len(g[:-1]) - 1][g[:-1]]
                ctx.append(k - less)
                p.append((c[n - 1][g] - less) / (k - less) if k - less > 0 else 0)
            b = 0
            for n, k in enumerate(ctx[1:], 1):
                if k > 0:
                    b = 64 * n + math.ceil(math.log2(k)) + 1
            out.append((b, [1 / (v + 1), *p]))
        return out

    every = [x for t in learn for x in look(t, 1)]
    weights = {}
    for b in {x[0] for x in every} | {-1}:
        rows_b = [p for k, p in every if k == b or b == -1]
        w = [1 / (order + 1)] * (order + 1)
        for _ in range(lm.EM_ROUNDS):
            new = [0] * (order + 1)
            for p in rows_b:
                s = sum(x * y for x, y in zip(w, p))
                for i in range(order + 1):
                    new[i] += w[i] * p[i] / s
            w = [x / len(rows_b) for x in new]
        w = [max(x, 1e-6) for x in w]
        weights[b] = [x / sum(w) for x in w]
    out = []
    for d, t in texts:
        base = sum(math.log10((c[0][(x,)] + 0.5) / (total + 0.5 * (v + 1))) for x in t)
        score = sum(math.log10(sum(x * y for x, y in zip(weights.get(b, weights[-1]), p))) for b, p in look(t, 0))
        out.append((d, len(t), sum(c[0][(x,)] > 0 for x in t), total, base, score))
    return sorted(out, key=str)


def corpus():
    r = random.Random(8)
    words = [f"w{i}é" for i in range(60)]
    rows = []
    for i in range(80):
        t = [r.choice(words[:20])]
        for _ in range(r.choice([0, 3, 30, 120])):
            t.append(words[(words.index(t[-1]) * 7 + r.choice([1, 1, 1, 2, 5])) % 60] if r.random() < 0.8 else r.choice(words))
        rows.append((i, " \t".join(t).upper().replace("É", "é") if i % 3 else "\n".join(t)))
    return rows + [(200, None), (201, ""), (202, " \n "), (203, "never seen words"), (5, rows[5][1]), (None, rows[6][1]), (204, "w1é " * 500)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_matches_slow_model(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(lm, "BINS_PER_OCTAVE", 8)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1, 1) for d, t in rows], "doc_id long, text string, train int, chunk int").repartition(3)
    got = lm.scores(docs, lm.fold() != 1, order).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    for x, y in zip(sorted((tuple(x) for x in got), key=str), slow(rows, order), strict=True):
        assert x[:4] == y[:4]
        assert x[4] == pytest.approx(y[4]) and x[5] == pytest.approx(y[5], rel=0.01)


def test_key_bits():
    assert [lm.key_bits(n) for n in (0, 1, 1 << 20, (1 << 30) + 5, 1 << 45)] == [24, 25, 45, 55, 64]


def test_null_ids_are_of_no_fold(spark):
    known = next(i for i in range(9) if not held(i))
    rows = spark.createDataFrame([(None, "a b"), (known, "a c")], "doc_id long, text string")
    got = lm.scores(rows, lm.fold() != 1).select("doc_id", "train", "train_tokens").collect()
    assert {(r["doc_id"], r["train"]) for r in got} == {(None, False), (known, True)} and got[0]["train_tokens"] == 3


def test_query_has_contexts_of_two_words(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r["score"] for r in lm.op9_lm_scoring(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want, less = ({r["doc_id"]: r["score"] for r in lm.scores(docs, lm.fold() != 1, order).collect()} for order in (3, 2))
    assert got == pytest.approx(want, rel=1e-9) and got != pytest.approx(less, rel=1e-3)


def test_probabilities_and_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.scores(docs, F.lit(True)).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    untrained = lm.scores(one, F.lit(False)).first()
    assert untrained["train_tokens"] == 0 and untrained["score"] == 0.0 and untrained["n_known"] == 0
