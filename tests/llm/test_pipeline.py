"""The pipeline against a plain version of each stage, run on that stage's own input."""

import zlib

import numpy as np
import pytest
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from tessella.llm import mixing, simhash, toxicity
from tests.llm.test_decontaminate import slow as slow_hits
from tests.llm.test_simhash import slow_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.stored(stage(spark, docs, SF), f"test-{n}")
        rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
        if n < 4:
            assert out.columns == docs.columns
            got = sorted(r["doc_id"] for r in out.select("doc_id").collect())
        if n == 0:
            score = toxicity.fit(docs, labels).scores(pa.array([t for _, t in rows]))
            assert got == [d for (d, _), s in zip(rows, score) if s < 0.5]
        elif n == 1:
            prints = np.array([slow_fingerprint(t) for _, t in rows], np.uint64)
            root = list(range(len(rows)))
            for i in range(len(rows)):
                for j in np.flatnonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= 3):
                    root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
            assert got == [d for k, (d, _) in enumerate(rows) if root[k] == k] and len(got) < len(rows)
        elif n == 2:
            assert got == sorted(x[0] for x in slow_hits(rows, bench) if not x[-1])
        elif n == 3:
            rates = {r["doc_id"]: r["rate"] for r in mixing.rated(docs, mixing.fit_to_weights(docs, labels)).collect()}
            assert all(abs(got.count(d) - rate) < 1 for d, rate in rates.items()) and {*got} <= {*rates}
        else:
            tokenizer, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
            found = sorted(out.collect(), key=lambda r: r["start"])
            for r, (d, t) in zip(found, rows, strict=True):
                ids = tokenizer.encode(t, add_special_tokens=False).ids + [2]
                assert tuple(r) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
                start += len(ids)
        docs = out


def test_one_of_each_group_with_odd_rows(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (7, "other words stand here"), (7, "a b c d"), (None, "quite alone is this"), (None, "quite alone is this"), (8, None), (9, "")]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, fp int").repartition(3)
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(5, "a b c d"), (7, "other words stand here"), (None, "quite alone is this"), (8, None)], key=str)
    assert simhash.one_of_each(docs.limit(0)).collect() == []


COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, score double, fp long, kept string, rate double, doc_id_1 long, `simhash_place` long"
EXTRA = (0.5, 1, "k", 2.0, 3, 4)


def tables(spark, path, docs, labels, items):
    rows = [(d, t, lang, "web", 1, *EXTRA) for d, t, lang in docs]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def words(seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice([*"abcdefghij"], 6)) for _ in range(n))


def test_run_on_odd_tables(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, extra columns of names that stages use, odd labels and items."""
    plain = [(i, words(i, 40), ["en", "de", None][i % 3]) for i in range(40)]
    odd = [(None, words(900, 30), None), (None, words(900, 30), "en"), (100, None, "en"), (101, "", "en"), (102, words(901, 20000), "fr"), (5, plain[5][1], "en"), (103, words(77, 30), "en")]
    labels = [(i, i % 2, 0) for i in range(0, 40, 2)] + [(None, 1, 1), (1, None, None), (9999, 1, 1), (3, 1, 0)]
    sf = tables(spark, tmp_path / "odd", plain + odd, labels, [("q1", words(77, 30)), (None, "x y"), ("q2", None), ("q3", "")])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = corpus_pipeline.stored(stage(spark, docs, sf), f"odd-{n}")
        assert out.columns == docs.columns and all(tuple(r)[5:] == EXTRA for r in out.collect())
        kept.append([(r["doc_id"], r["text"]) for r in out.collect()])
        docs = out
    assert len(kept[0]) == 47  # no label is toxic and known
    alone = [(i, t) for i, t, _ in plain + odd if (i, t) not in ((101, ""), (None, odd[0][1]))]
    assert sorted(kept[1], key=str) == sorted({*alone, (None, odd[0][1])}, key=str)
    assert {(103, odd[-1][1])} == {*kept[1]} - {*kept[2]}
    assert {*kept[3]} <= {*kept[2]}
    found = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in found) == sorted((d is None, d) for d, _ in kept[3])


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_run_on_an_empty_table(spark, tmp_path, empty):
    docs = [(i, words(i, 30), "en") for i in range(12)]
    labels = [(i, i % 2, 0) for i in range(12)]
    parts = {"documents": docs, "labels": labels, "benchmark": [("q", words(3, 20))]} | {empty: []}
    sf = tables(spark, tmp_path / empty, parts["documents"], parts["labels"], parts["benchmark"])
    found = corpus_pipeline.run(spark, sf).collect()
    ids = {r["doc_id"] for r in found}
    assert found == [] if empty == "documents" else ids and (3 in ids or empty != "benchmark" or labels) and ids <= {*range(12)}
