import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import mixing

SF = "/root/testdata/sf0.01"


def slow_rates(tokens, p, targets):
    """Plain projected gradient of the same least squares, in the same metric, run for long."""
    gram = (p * tokens[:, None]).T @ p
    r = np.ones(len(tokens))
    for _ in range(2000):
        r = np.maximum(0, r - p @ np.linalg.solve(gram, (r * tokens) @ p - targets))
    return r


def test_rates_match_brute_force_and_targets(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = mixing.fit_to_weights(docs, labels)
    got = mixing.rated(docs.select("doc_id", "text"), found).toPandas().sort_values("doc_id")
    rows = docs.select("doc_id", "text").toPandas().sort_values("doc_id")
    tokens = np.array([len(t.split()) for t in rows.text.fillna("")], float)
    p = found.classifier.posteriors(pa.array(rows.text, pa.string()))
    assert (got.n_tokens.to_numpy() == tokens).all() and (got.rate >= 0).all()
    want = slow_rates(tokens, p, found.targets)
    assert np.allclose(got.rate, want, atol=2e-3)
    assert np.abs((got.rate.to_numpy() * tokens) @ p - found.targets).sum() < 0.01 * found.targets.sum()
    copies = mixing.mixed(docs, found)
    assert copies.columns == docs.columns
    n = copies.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].reindex(got.doc_id).fillna(0).to_numpy()
    assert (np.abs(n - got.rate.to_numpy()) < 1).all()


def test_classifier_finds_domains(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = mixing.fit_to_weights(docs, labels)
    got = mixing.rated(docs, found).toPandas()
    long = got[got.n_tokens >= 20]
    assert (long.domain.str[:2] == long.lang).mean() > 0.9


def test_negative_pull_is_clipped(spark):
    """A domain with target 0 ends with rates of 0, not below."""
    docs = spark.createDataFrame([(i, ("aaa bbb " if i % 2 else "xyz uvw ") * 30) for i in range(40)], "doc_id long, text string")
    model = mixing.train(["aaa bbb " * 30, "xyz uvw " * 30] * 20, ["a", "x"] * 20)
    got = mixing.rated(docs, mixing.fit(docs, model, {"a": 1.0})).toPandas()
    assert got[got.domain == "x"].rate.max() < 0.05 and got[got.domain == "a"].rate.min() == pytest.approx(2, abs=0.1)


class Given:
    """A classifier whose posteriors are written in the texts."""

    domains = [f"{lang}-{quality}" for lang in ("de", "en", "es", "fr") for quality in ("good", "poor")]

    def posteriors(self, column):
        return np.array([[float(x) for x in t.split()[0].split(",")] for t in column.to_pylist()])


def skewed(spark, english, poor, n=3000):
    """Documents with soft posteriors, most of them English and many poor: texts, tokens, posteriors."""
    r = np.random.default_rng(3)
    lang, bad = r.choice(4, n, p=[(1 - english) / 3, english, (1 - english) / 3, (1 - english) / 3]), (r.random(n) < poor).astype(int)
    z = r.normal(0, 1.5, (n, 8))
    z[np.arange(n), 2 * lang + bad] += 4.5
    z[np.arange(n), 2 * lang + 1 - bad] += 2.2
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    tokens = 1 + r.integers(0, 60, n)
    texts = [",".join(map(repr, x.tolist())) + " w" * (t - 1) for x, t in zip(p, tokens)]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), tokens.astype(float), p


@pytest.mark.parametrize("english, poor", [(0.85, 0.4), (0.94, 0.5)])
def test_skewed_corpus_meets_its_targets(spark, english, poor):
    """Many rates are 0, so that short steps alone take hundreds of rounds."""
    docs, tokens, p = skewed(spark, english, poor)
    found = mixing.fit(docs, Given(), mixing.WEIGHTS)
    rates = mixing.rates_of(p, found.steps)
    assert (rates == 0).mean() > 0.4
    totals = (rates * tokens) @ p
    assert np.allclose(totals, found.totals) and np.allclose(totals, found.targets, rtol=1e-3) and found.gap <= mixing.TOLERANCE
    gram, want = (p * tokens[:, None]).T @ p, np.ones(len(tokens))
    for _ in range(20000):
        want = np.maximum(0, want - p @ np.linalg.solve(gram, (want * tokens) @ p - found.targets))
    assert np.abs((want * tokens) @ p - found.targets).sum() < 1e-3 * found.targets.sum()
    assert np.sqrt(np.mean((rates - want) ** 2)) < 0.01 * np.sqrt(np.mean(want**2))


def test_classifier_counts_all_labelled_rows(spark):
    """More labelled rows than any sample took; the last ones alone are French and poor."""
    rows = [(i, f"word{i % 50} né\t{i}" if i % 7 else "ab", "en" if i < 9500 else "fr", int(i < 9500)) for i in range(10000)]
    docs = spark.createDataFrame([*rows, (10000, None, "de", 1), (10001, "ohne", "xx", 1)], "doc_id long, text string, lang string, quality int")
    found = mixing.train_on(mixing.domain_labels(docs.drop("quality"), docs.select("doc_id", "quality")), sorted(mixing.WEIGHTS))
    want = mixing.train([r[1] for r in rows], ["en-good" if r[3] else "fr-poor" for r in rows], sorted(mixing.WEIGHTS))
    assert np.allclose(found.prior, want.prior) and np.allclose(found.weight, want.weight)
    whole = mixing.fit_to_weights(docs.drop("quality"), docs.select("doc_id", "quality")).classifier
    assert np.allclose(whole.prior, want.prior) and whole.evidence in mixing.EVIDENCE


def test_targets_out_of_reach_are_reported(spark):
    """Every document is half of b, so b cannot be without a."""
    text = ",".join(["0.5", "0.5"] + ["0"] * 6) + " w w w"
    other = ",".join(["0.9", "0.1"] + ["0"] * 6) + " w w w"
    docs = spark.createDataFrame([(i, text if i % 2 else other) for i in range(20)], "doc_id long, text string")
    with pytest.warns(UserWarning, match="No rates meet the targets"):
        found = mixing.fit(docs, Given(), {"de-poor": 1.0})
    p = np.array([[0.5, 0.5], [0.9, 0.1]])
    gram = (p * 40).T @ p
    a = np.linalg.cholesky(np.linalg.inv(gram)).T
    best = min(np.linalg.norm(a @ (40 * r * p[0] - [0, 80])) for r in np.linspace(0, 5, 5001))
    assert np.linalg.norm(a @ (found.totals[:2] - [0, 80])) == pytest.approx(best, rel=1e-3)


def test_odd_input(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (None, "ab", 1.0), (3, "é " * 100000, 1.0), (3, "é " * 100000, 1.0)], "doc_id long, text string, p double")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = mixing.train([], [], ["a", "b"])
    for some in (docs, docs.limit(0)):
        found = mixing.fit(some, model, {"a": 0.5, "b": 0.5})
        assert mixing.rated(some, found).count() == some.count()
        assert mixing.mixed(some, found).columns == some.columns
    found = mixing.fit_to_weights(docs.selectExpr("doc_id", "text", "'en' as lang"), labels)
    assert mixing.rated(docs, found).where("rate >= 0").count() == 5
