"""Toxicity scores: a linear classifier over character n-grams that are scaled by naive Bayes log-count ratios.

A feature is the presence of an n-gram of characters (lower-cased, hashed into `BUCKETS`) in a text.
Its value is the log ratio of how often toxic and other texts hold it; a logistic regression learns the
weights of the features whose frequencies differ significantly. Training takes the first `SAMPLE_ROWS`
labelled texts by a hash of doc_id (repeated rows count once), however the files lie, and all of each text;
scoring reads all of every text. Tasks count the n-grams and mark each text's features: the driver sees
the `FEATURES` chosen ones and one bit a feature for each text of the sample, never a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import clean_documents, distinct, fresh_name, labelled_sample, packed, pieces, stored, table, text_bytes
from tessella.llm.exchange import squeeze, unsqueeze

SAMPLE_ROWS = 10_000
ORDERS = (3, 4, 5, 6)
BUCKET_BITS = 20
FEATURES = 2048
SIGNIFICANCE = 20.0  # least log-likelihood ratio of a feature
RIDGE = 3e-4
FIT_TASKS = 16
RANGES = 64  # of buckets, that tasks add up
BLOCK = 1024  # rows of the sample that are unpacked at a time
PIECE_BYTES = 2 << 20


def ngram_buckets(column: pa.Array, orders: tuple[int, ...] = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: the text and the bucket of every n-gram position, and whether it lies within one text."""
    raw, offsets = text_bytes(pc.utf8_lower(column))
    if not len(raw):
        return
    chars = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    heads = np.append(0, np.cumsum((raw & 0xC0) != 0x80))[offsets]
    text = np.repeat(np.arange(len(heads) - 1, dtype=np.int32), np.diff(heads))
    h = chars * np.uint32(2654435761)
    for n in range(2, max(orders) + 1):
        if len(chars) < n:
            return
        h = h[: len(chars) - n + 1] * np.uint32(2246822519) + chars[n - 1 :]
        if n in orders:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(2654435761)
            yield text[: len(h)], (mixed >> np.uint32(32 - BUCKET_BITS)).astype(np.int32), text[: len(h)] == text[n - 1 :]


@dataclass
class Model:
    slot: np.ndarray  # of each bucket: its feature, or -1
    weight: np.ndarray  # of each feature: ratio times learned weight
    bias: float

    def features(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, feature) pairs."""
        size = len(self.weight)
        found = [np.empty(0, np.int64)]
        for text, bucket, inside in ngram_buckets(column):
            slot = self.slot[bucket]
            at = np.flatnonzero((slot >= 0) & inside)
            found.append(distinct(text[at].astype(np.int64) * size + slot[at]))
        pairs = distinct(np.concatenate(found))
        return (pairs // size, pairs % size) if size else (pairs, pairs)

    def scores(self, column: pa.Array) -> np.ndarray:
        text, feature = self.features(column)
        z = self.bias + np.bincount(text, self.weight[feature], len(column)) if len(text) else np.full(len(column), self.bias)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_by(column: pa.Array, labels: np.ndarray) -> np.ndarray:
    """Of each label, 0 or 1, and bucket: the texts that hold it."""
    buckets = 1 << BUCKET_BITS
    out = np.zeros(2 * buckets, np.int64)
    pairs = [distinct(text[inside].astype(np.int64) * buckets + bucket[inside]) for text, bucket, inside in ngram_buckets(column)]
    if pairs:
        text, bucket = np.divmod(distinct(np.concatenate(pairs)), buckets)
        out += np.bincount(labels[text] * buckets + bucket, minlength=2 * buckets)
    return out.reshape(2, buckets)


def log_ratio(a: Column, b: Column, n1: int, n0: int) -> Column:
    """Naive Bayes log-count ratio of a feature that a of n1 toxic and b of n0 other texts hold."""
    return F.log((a + 1) / (n1 + 2)) - F.log((b + 1) / (n0 + 2))


def likelihood_ratio(a: Column, b: Column, n1: int, n0: int) -> Column:
    """Twice the log-likelihood ratio of the two frequencies being different."""
    expected = (a + b) * F.lit(n1 / (n1 + n0))
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(F.lit(0.0))
    return 2 * (part(a, expected) + part(b, a + b - expected) + part(n1 - a, n1 - expected) + part(n0 - b, n0 - (a + b - expected)))


def regression(bits: np.ndarray, labels: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression. bits: of each text, a packed row of which features it holds.

    By Newton's method, each step by conjugate gradients; the last coordinate is the bias.
    """
    n, size = len(labels), len(ratio)
    prior = (labels.sum() + 0.5) / (n + 2)
    blocks = [slice(i, i + BLOCK) for i in range(0, n, BLOCK)]
    rows = lambda s: np.unpackbits(bits[s], axis=1, count=size).astype(np.float64)

    def times(v: np.ndarray) -> np.ndarray:
        return np.concatenate([rows(s) @ (ratio * v[:size]) for s in blocks]) + v[size]

    def back(e: np.ndarray) -> np.ndarray:
        return np.append(ratio * sum(e[s] @ rows(s) for s in blocks), e.sum())

    ridge = np.append(np.full(size, RIDGE * n), 1e-9)
    theta = np.append(np.zeros(size), np.log(prior / (1 - prior)))

    def cost(t: np.ndarray, z: np.ndarray) -> float:
        return float(np.logaddexp(0, z).sum() - z @ labels + 0.5 * (ridge * t * t).sum())

    z = times(theta)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        gradient, curve = back(p - labels) + ridge * theta, p * (1 - p)
        if np.abs(gradient).max() < 1e-6 * n:
            break
        step, left = np.zeros(size + 1), -gradient
        along, norm = left.copy(), left @ left
        for _ in range(100):
            turned = back(curve * times(along)) + ridge * along
            far = norm / (along @ turned)
            step, left = step + far * along, left - far * turned
            before, norm = norm, left @ left
            if norm < 1e-6 * (gradient @ gradient):
                break
            along = left + norm / before * along
        way, now, scale = times(step), cost(theta, z), 1.0
        while cost(theta + scale * step, z + scale * way) > now and scale > 1e-4:
            scale /= 2
        theta, z = theta + scale * step, z + scale * way
    return theta[:size], float(theta[size])


def train(sample: DataFrame) -> Model:
    """From rows (text, label 0 or 1), all of them. Without both labels every text has the (smoothed) share of label 1."""
    buckets = 1 << BUCKET_BITS
    wide = buckets // RANGES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, buckets), np.int64)
        for part in pieces(batches, "text", PIECE_BYTES >> 3):  # all their n-grams are sorted
            held += held_by(part.column(0), part.column(1).to_numpy().astype(np.int64))
        for r in range(RANGES):
            body = np.ascontiguousarray(held[:, r * wide : (r + 1) * wide])
            if body.any():
                yield pa.record_batch([pa.array([r], pa.int32()), pa.array([squeeze(body.ravel())], pa.binary())], names=["range", "body"])

    def add(parts: pa.Table) -> pa.Table:
        total = sum(unsqueeze(b).astype(np.int64) for b in parts.column("body").to_pylist()).reshape(2, wide)
        at = np.flatnonzero(total.any(0))
        return pa.table({"bucket": pa.array(at + parts.column("range")[0].as_py() * wide, pa.int32()), "a": pa.array(total[1, at]), "b": pa.array(total[0, at])})

    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    slot = np.full(buckets, -1, np.int32)
    if not n1 or not n0:
        prior = (n1 + 0.5) / (n1 + n0 + 2)
        return Model(slot, np.empty(0), float(np.log(prior / (1 - prior))))
    counts = sample.select("text", "label").mapInArrow(count, "range int, body binary").groupBy("range").applyInArrow(add, "bucket int, a long, b long")
    differs = counts.withColumn("differs", likelihood_ratio(F.col("a"), F.col("b"), n1, n0)).where(F.col("differs") >= SIGNIFICANCE)
    best = differs.orderBy(F.desc("differs"), "bucket").limit(FEATURES).select("bucket", log_ratio(F.col("a"), F.col("b"), n1, n0).alias("ratio"))
    chosen = sorted((r["bucket"], r["ratio"]) for r in best.collect())
    slot[[b for b, _ in chosen]] = np.arange(len(chosen))
    model = Model(slot, np.array([x for _, x in chosen]), 0.0)
    held = sample.sparkSession.sparkContext.broadcast(model)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text", PIECE_BYTES):
            bits = np.zeros((part.num_rows, len(held.value.weight)), np.uint8)
            bits[held.value.features(part.column(0))] = 1
            packed = np.packbits(bits, axis=1)
            yield pa.record_batch([pa.array([x.tobytes() for x in packed], pa.binary()), part.column(1)], names=["bits", "label"])

    # In an order that no partitioning changes, so that sums come out alike.
    marked = sorted((r["bits"], r["label"]) for r in sample.select("text", "label").mapInArrow(mark, "bits binary, label int").collect())
    held.destroy()
    bits = np.frombuffer(b"".join(x for x, _ in marked), np.uint8).reshape(len(marked), -1)
    weight, bias = regression(bits, np.array([y for _, y in marked], np.int64), model.weight)
    return Model(slot, model.weight * weight, bias)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """From rows of labels (doc_id, toxic) whose label is 0 or 1, joined to docs; others are left out."""
    judged = labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("label"))
    return train(stored(labelled_sample(docs, judged, rows, FIT_TASKS), "toxic-sample"))


def scored(docs: DataFrame, model: Model, keep: float | None = None) -> DataFrame:
    """The rows of docs and a score (0 to 1) each; keep: only those below it, without the score.

    A null or empty text has no n-grams and gets the model's bias. Repeated rows get the same score. Where docs has
    a column `score` of its own, that one keeps its name and the new one is called score_1 (or _2 and so on).
    """
    name = fresh_name("score", docs.columns)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text", PIECE_BYTES):
            score = held.value.scores(part.column(part.schema.get_field_index("text")))
            if keep is None:
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, name])
            else:
                yield part.filter(pa.array(score < keep))

    return packed(docs).mapInArrow(run, docs.schema if keep is not None else T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def held_out(column: str = "doc_id") -> Column:
    """Whether the crc32 of the id as text is a multiple of 5; a null id is of no fold, so false."""
    return F.coalesce(F.crc32(F.col(column).cast("long").cast("string")) % 5 == 0, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = clean_documents(table(spark, sf_dir, "documents"), "doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
