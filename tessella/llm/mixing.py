"""Mixing to target weights with soft domain membership.

A labelled table trains a naive Bayes classifier over hashed byte trigrams, whose posteriors say how much
of a document belongs to each domain. It counts the trigrams of all labelled documents, in a distributed pass. Each document then gets a rate r >= 0, the expected number of its
copies. With t its tokens and p its posteriors, the rates minimise the distance of the expected domain
totals, the sum of r t p, from the targets, by projected gradient:

    r <- max(0, r - p . G^-1 (sum of r t p - target)),    G = sum of t p p'

(the gradient in the metric in which one step is the largest safe one). Where many rates stay at 0 such steps
creep, so after `STEPS` of them implicit steps follow, each as far as `LENGTHS` of them: the same update with
the totals that it leads to, found by Newton's method on its d multipliers. The fit ends when the totals meet the
targets within `TOLERANCE`, or when a long step moves them no more: then these are the nearest totals that
rates can reach, and a warning tells the gap. In this metric a domain that hardly any document has outweighs all others; where
pursuing it would lead further from the targets than rates of 1 are, the directions in which G is small (`CUTOFFS`) are left out. A fit that ends by neither raises an error. A document's rate follows
from its posteriors and the few numbers that each step adds, so a step is one aggregation of stored posteriors
(an implicit one some), nothing about documents reaches the driver and no rates are joined.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import LOWER, NOT_WHITE, clean_documents, fresh_name, packed, pieces, stored, table, text_bytes
from tessella.llm.exchange import mix

BUCKET_BITS = 16
PIECE_BYTES = 4 << 20
STEPS = 40
LENGTHS = (1e2, 1e4, 1e6)
LONG_STEPS = 12  # the last length is repeated
NEWTON_ROUNDS = 50
TOLERANCE = 1e-6
CUTOFFS = (1e-10, 1e-6, 1e-4, 1e-2)  # of G's eigenvalues, as a share of the largest
EVIDENCE = (4, 8, 16, 32, 64, 128, 256, 512)


def _trigrams(raw: np.ndarray) -> np.ndarray:
    low = LOWER[raw].astype(np.uint32)
    h = (low[:-2] * np.uint32(65536) + low[1:-1] * np.uint32(256) + low[2:]) * np.uint32(2654435761)
    return (h >> np.uint32(32 - BUCKET_BITS)).astype(np.uint16)


@dataclass
class Classifier:
    """Domain posteriors. evidence: of a longer text, the mean over its trigrams counts as so many."""

    domains: list[str]
    prior: np.ndarray  # log
    weight: np.ndarray  # log, by domain and bucket
    evidence: float

    def likelihoods(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, the sum of each domain's weights and the number of trigrams."""
        raw, offsets = text_bytes(column)
        n = np.maximum(np.diff(offsets) - 2, 0)
        out = np.zeros((len(n), len(self.domains)))
        if n.sum():
            some = np.flatnonzero(n)
            grams = _trigrams(raw)
            bounds = np.stack([offsets[some], offsets[some] + n[some]], 1).ravel()
            padded = np.append(grams, np.uint16(0))
            for d in range(len(self.domains)):
                out[some, d] = np.add.reduceat(self.weight[d][padded], bounds, dtype=np.float64)[::2]
        return out, n

    def posteriors(self, column: pa.Array, evidence: float | None = None) -> np.ndarray:
        return self.posteriors_of(*self.likelihoods(column), evidence or self.evidence)

    def posteriors_of(self, total: np.ndarray, n: np.ndarray, evidence: float) -> np.ndarray:
        z = self.prior + total * (np.minimum(n, evidence) / np.maximum(n, 1))[:, None]
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def smoothed(domains: list[str], texts: np.ndarray, counts: np.ndarray, evidence: float) -> Classifier:
    """From counts, already smoothed, of each domain's texts and trigrams."""
    return Classifier(domains, np.log(texts / texts.sum()), np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32), evidence)


def train(texts: list[str], labels: list[str], domains: list[str] | None = None) -> Classifier:
    """A fifth of the sample chooses the evidence that a text may bring, by log loss; all of it gives the weights.

    domains: those to predict, by default the labels that occur. Without texts all domains are equally likely.
    """
    domains = domains or sorted(set(labels)) or ["all"]
    number = {d: i for i, d in enumerate(domains)}

    def counted(some: list[int], evidence: float) -> Classifier:
        counts = np.ones((len(domains), 1 << BUCKET_BITS))
        prior = np.ones(len(domains))
        for i in some:
            raw = np.frombuffer(texts[i].encode(), np.uint8)
            prior[number[labels[i]]] += 1
            if len(raw) > 2:
                counts[number[labels[i]]] += np.bincount(_trigrams(raw), minlength=1 << BUCKET_BITS)
        return smoothed(domains, prior, counts, evidence)

    every = [i for i, x in enumerate(labels) if x in number]
    tuned, rest = every[::5], [i for k, i in enumerate(every) if k % 5]
    best = EVIDENCE[0]
    if rest:
        model = counted(rest, best)
        truth = np.array([number[labels[i]] for i in tuned])
        column = pa.array([texts[i] for i in tuned], pa.string())
        best = min(EVIDENCE, key=lambda e: -np.log(np.maximum(model.posteriors(column, e)[np.arange(len(tuned)), truth], 1e-12)).mean())
    return counted(every, best)


def train_on(rows: DataFrame, domains: list[str]) -> Classifier:
    """As train, on all rows (doc_id, text, label), by two scans; a fifth by a hash of doc_id is that which chooses the evidence.

    The domains' trigram counts reach the driver, added up before. Null texts and labels that are no domain are left out.
    """
    d, buckets = len(domains), 1 << BUCKET_BITS
    number = F.array_position(F.array(*[F.lit(x) for x in domains]), F.col("label")).cast("int") - 1
    tuned = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0, F.lit(False))
    rows = stored(packed(rows.select("text", number.alias("number"), tuned.alias("tuned")).where("text is not null and number >= 0")), "mix-labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, counts = np.zeros(2 * d, np.int64), np.zeros(2 * d * buckets, np.int64)
        for part in pieces(batches, "text", PIECE_BYTES):
            raw, offsets = text_bytes(part.column(0))
            kind = part.column(1).to_numpy() + d * part.column(2).to_numpy(zero_copy_only=False)
            texts += np.bincount(kind, minlength=2 * d)
            n = np.diff(offsets)
            if len(raw) > 2:
                inside = np.repeat(np.cumsum(n), n)[:-2] >= np.arange(3, len(raw) + 1)
                counts += np.bincount((np.repeat(kind, n)[:-2] * buckets + _trigrams(raw))[inside], minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(np.append(at, -1 - np.arange(2 * d)), pa.int32()), pa.array(np.append(counts[at], texts), pa.int64())], names=["at", "n"])

    found = rows.mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = found["at"].to_numpy(), found["n"].to_numpy()
    texts, counts = np.zeros(2 * d), np.zeros(2 * d * buckets)
    texts[-1 - at[at < 0]], counts[at[at >= 0]] = n[at < 0], n[at >= 0]
    texts, counts = texts.reshape(2, d), counts.reshape(2, d, buckets)
    best = EVIDENCE[0]
    if texts[0].any() and texts[1].any():
        held = rows.sparkSession.sparkContext.broadcast(smoothed(domains, texts[0] + 1, counts[0] + 1, best))

        def loss(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = np.zeros(len(EVIDENCE))
            for part in pieces(batches, "text", PIECE_BYTES):
                truth = part.column(1).to_numpy()
                seen = held.value.likelihoods(part.column(0))
                total -= [np.log(np.maximum(held.value.posteriors_of(*seen, e)[np.arange(len(truth)), truth], 1e-12)).sum() for e in EVIDENCE]
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total])], names=["task", "total"])

        losses = sorted((r["task"], r["total"]) for r in rows.where("tuned").mapInArrow(loss, "task int, total array<double>").collect())
        best = EVIDENCE[int(np.argmin([math.fsum(x[k] for _, x in losses) for k in range(len(EVIDENCE))]))]
    return smoothed(domains, texts.sum(0) + 1, counts.sum(0) + 1, best)


def token_counts(column: pa.Array) -> np.ndarray:
    """Words, separated by white space, of each text."""
    raw, offsets = text_bytes(column)
    inside = NOT_WHITE[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    start[heads] = inside[heads]
    return np.diff(np.searchsorted(np.flatnonzero(start), offsets))


def rates_of(posteriors: np.ndarray, steps: np.ndarray) -> np.ndarray:
    rate = np.ones(len(posteriors))
    for step in steps:
        rate = np.maximum(rate - posteriors @ step, 0)
    return rate


@dataclass
class Mix:
    classifier: Classifier
    steps: np.ndarray
    totals: np.ndarray  # expected tokens of each domain
    targets: np.ndarray

    @property
    def gap(self) -> float:
        """The distance of the totals from the targets, as a share of these."""
        return float(np.abs(self.totals - self.targets).sum() / max(self.targets.sum(), 1))


def _sums(parts: DataFrame, size: int, of) -> np.ndarray:
    """The sum over all rows of what `of` (tokens, posteriors) returns for a batch; one row for each task reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size)
        for batch in batches:
            tokens = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
            total += of(tokens, batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(tokens), -1)).ravel()
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total])], names=["task", "total"])

    rows = sorted((r["task"], r["total"]) for r in parts.mapInArrow(run, "task int, total array<double>").collect())
    return np.array([math.fsum(x[k] for _, x in rows) for k in range(size)])


def fit(docs: DataFrame, classifier: Classifier, weights: dict[str, float], total: float | None = None, steps: int = STEPS) -> Mix:
    """weights: of each domain of the classifier (others 0), in proportion. total: expected tokens, by default those of docs."""

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text", PIECE_BYTES):
            p = held.value.posteriors(part.column(0))
            yield pa.record_batch([pa.array(token_counts(part.column(0)), pa.int64()), pa.FixedSizeListArray.from_arrays(p.ravel(), d).cast(pa.list_(pa.float64()))], names=["tokens", "p"])

    held = docs.sparkSession.sparkContext.broadcast(classifier)
    d = len(classifier.domains)
    parts = stored(packed(clean_documents(docs, "text")).mapInArrow(classify, "tokens long, p array<double>"), "mix-posteriors", "snappy")
    first = _sums(parts, d * d + d, lambda t, p: np.concatenate([((p * t[:, None]).T @ p).ravel(), t @ p]))
    gram, totals = first[: d * d].reshape(d, d), first[d * d :]
    share = np.array([max(weights.get(x, 0.0), 0.0) for x in classifier.domains])
    targets = share / (share.sum() or 1) * (totals.sum() if total is None else total)
    values, vectors = np.linalg.eigh(gram)
    away = lambda x: float(np.abs(x - targets).sum())
    for cutoff in CUTOFFS:
        some = values > cutoff * values.max(initial=0)
        done, found, still = _descend(parts, totals, targets, vectors[:, some] / np.sqrt(values[some]), steps)
        if away(found) <= (1 + TOLERANCE) * away(totals):
            break
    else:
        done, found, still = np.empty((0, d)), totals, False
    mix_ = Mix(classifier, done, found, targets)
    if still:
        raise RuntimeError(f"The rates did not converge: the totals are {mix_.gap:.2g} of the targets away and still move.")
    if mix_.gap > TOLERANCE:
        warnings.warn(f"No rates meet the targets: the nearest totals are {mix_.gap:.2g} of them away.", stacklevel=2)
    return mix_


def _descend(parts: DataFrame, totals: np.ndarray, targets: np.ndarray, white: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The steps, the totals they lead to, and whether these still move."""
    done, last = np.empty((0, len(totals))), np.inf

    def met(moved: float) -> bool:
        return bool(np.abs(totals - targets).sum() <= TOLERANCE * max(targets.sum(), 1)) or moved <= TOLERANCE * max(targets.sum(), 1)

    for _ in range(steps):
        if met(last):
            break
        done = np.vstack([done, white @ (white.T @ (totals - targets))])
        before, totals = totals, _sums(parts, len(totals), lambda t, p, done=done: (t * rates_of(p, done)) @ p)
        last = np.abs(totals - before).sum()
    last = np.inf  # a short step may move little far from the end
    for length in (*LENGTHS, *[LENGTHS[-1]] * (LONG_STEPS - len(LENGTHS))):
        if met(last):
            break
        step, after = _implicit(parts, done, totals, targets, white, length)
        done, last, totals = np.vstack([done, step]), np.abs(after - totals).sum() if length == LENGTHS[-1] else np.inf, after
    return done, totals, not met(last)


def _implicit(parts: DataFrame, done: np.ndarray, totals: np.ndarray, targets: np.ndarray, white: np.ndarray, length: float) -> tuple[np.ndarray, np.ndarray]:
    """The step s with s = length G^-1 (totals after it - targets), and these totals.

    By Newton's method for the minimum over m (s = white m) of sum of t r^2 / 2 + m . white' targets + m . m / (2 length),
    which is convex and whose gradient vanishes at s.
    """
    d, k = white.shape
    tokens = max(totals.sum(), targets.sum(), 1)

    def at(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        steps = np.vstack([done, white @ m])

        def of(t: np.ndarray, p: np.ndarray) -> np.ndarray:
            r = rates_of(p, steps)
            q = p[r > 0]
            return np.concatenate([[t @ (r * r)], (t * r) @ p, ((q * t[r > 0][:, None]).T @ q).ravel()])

        sums = _sums(parts, 1 + d + d * d, of)
        after, curve = sums[1 : 1 + d], white.T @ sums[1 + d :].reshape(d, d) @ white + np.eye(k) / length
        return sums[0] / 2 + m @ (white.T @ targets) + m @ m / (2 * length), white.T @ (after - targets) - m / length, curve, after

    m = np.zeros(k)
    value, downhill, curve, after = at(m)
    for _ in range(NEWTON_ROUNDS):
        if downhill @ downhill <= (1e-3 * TOLERANCE) ** 2 * tokens:
            break
        way, scale = np.linalg.solve(curve, downhill), 1.0
        while True:
            new = at(m + scale * way)
            if new[0] <= value - 1e-4 * scale * (downhill @ way) + 1e-13 * abs(value) or scale < 1e-9:
                break
            scale /= 2
        m, (value, downhill, curve, after) = m + scale * way, new
    return white @ m, after


def rated(docs: DataFrame, found: Mix) -> DataFrame:
    """The rows of docs with domain (the likeliest; of equally likely ones the first by name), n_tokens and rate.

    A null or empty text has the prior as its posteriors and no tokens. Repeated rows get the same rate. Where docs
    has columns of the new names, they keep theirs and the new ones are called domain_1 and so on.
    """
    names = [fresh_name(x, docs.columns) for x in ("domain", "n_tokens", "rate")]
    held = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text", PIECE_BYTES):
            text = part.column(part.schema.get_field_index("text"))
            p = held.value.classifier.posteriors(text)
            domain = pa.array([held.value.classifier.domains[i] for i in p.argmax(1)], pa.string())
            columns = [*part.columns, domain, pa.array(token_counts(text), pa.int64()), pa.array(rates_of(p, held.value.steps))]
            yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *names])

    added = [T.StructField(name, kind) for name, kind in zip(names, (T.StringType(), T.LongType(), T.DoubleType()))]
    return packed(docs).mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def mixed(docs: DataFrame, found: Mix) -> DataFrame:
    """The rows of docs, each as often as its rate says; a fraction of a copy is drawn by a hash of doc_id (null: as 0)."""
    held = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text", PIECE_BYTES):
            rate = rates_of(held.value.classifier.posteriors(part.column(part.schema.get_field_index("text"))), held.value.steps)
            ids = part.column(part.schema.get_field_index("doc_id")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            draw = (mix(ids, np.uint64(1)) >> np.uint64(11)) * 2.0**-53
            copies = np.floor(rate + draw).astype(np.int64)
            for low in range(0, int(copies.max(initial=0))):  # a piece's copies a round at a time
                some = np.flatnonzero(copies > low)
                yield part.take(pa.array(some))

    return packed(docs).mapInArrow(run, docs.schema)


#: The mix of the query and of the pipeline: languages, and in each nine tenths of good quality.
WEIGHTS = {f"{lang}-{quality}": share * part for lang, share in (("de", 0.2), ("en", 0.4), ("es", 0.2), ("fr", 0.2)) for quality, part in (("good", 0.9), ("poor", 0.1))}


def domain_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and label: language and labelled quality, of the documents with both."""
    # One plan at all sizes: labels grow with the documents.
    quality = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    named = clean_documents(docs, "doc_id", "lang", "text").where("lang in ('de', 'en', 'es', 'fr') and text is not null")
    judged = labels.select("doc_id", quality.alias("quality")).where("quality is not null")
    return named.hint("merge").join(judged, "doc_id").select("doc_id", "text", F.concat_ws("-", "lang", "quality").alias("label"))


def fit_to_weights(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS) -> Mix:
    """The classifier is fitted on every document with a label, whatever their number and length."""
    return fit(docs, train_on(domain_labels(docs, labels), sorted(weights)), weights)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = fit_to_weights(docs, table(spark, sf_dir, "labels"))
    return rated(clean_documents(docs, "doc_id", "text"), found).select("doc_id", "domain", "n_tokens", F.round("rate", 6).alias("rate"))
