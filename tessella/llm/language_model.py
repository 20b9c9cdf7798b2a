"""n-gram language model scores by deleted interpolation.

Texts become stored chunks of word codes. For each order, chunks ask shards for the training counts of
their distinct n-grams (see exchange.py), so no n-gram row is ever joined and a frequent n-gram costs one
entry a chunk. Words are known by 64-bit hashes; of longer n-grams, hashes travel with as many bits as the corpus
needs for one in 16 million tokens to meet another's (see key_bits). An n-gram's probability mixes the maximum-likelihood estimates of all orders and a uniform
one, with weights that depend on how frequent the context is. The weights are learned by expectation-
maximisation on deleted counts: each training token is held out in turn, that is, its own occurrence is
taken off the counts that predict it. The expectations need only, for each bucket of contexts, how often
each combination of (finely rounded) estimates comes up; that histogram covers all training tokens and is
bounded by its bins, so it is all that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import NOT_WHITE, binary_array, clean_documents, discard, in_tasks, packed, pieces, stored, table, word_cuts
from tessella.llm.exchange import answer, answered, ask, free_messages, group_sums, joined, key_bits, mix, parted, shard_number, squeeze, squeeze_sorted, unsqueeze, unsqueeze_sorted, with_answers

ORDER = 3
CHUNK_BYTES = 2 << 20
#: Hashes of the marks before a text's first word and after its last; no word has them but by chance.
BEGIN, END = np.uint64(0x5BE0CD19137E2179), np.uint64(0x1F83D9ABFB41BD6B)
BINS_PER_OCTAVE = 2  # rounding of estimates in the histogram
EM_ROUNDS = 60


def chunk_of(ids: pa.Array, texts: pa.Array, train: np.ndarray) -> tuple[bytes, int, int, int]:
    """A chunk's body, its distinct keys, tokens, and training tokens."""
    data, starts, counts = word_cuts(texts, NOT_WHITE)
    coded = binary_array(data, starts).dictionary_encode()
    words = coded.dictionary.to_pylist()
    digest = xxhash.xxh64_intdigest
    keys, number = np.unique(np.append(np.fromiter((digest(w) for w in words), np.uint64, len(words)), END), return_inverse=True)
    codes = np.full(len(starts) - 1 + len(counts), number[-1], np.int64)  # every text ends with END
    codes[np.arange(len(starts) - 1) + np.repeat(np.arange(len(counts)), counts)] = number[coded.indices.to_numpy(zero_copy_only=False)]
    tokens = counts + 1
    learned = np.bincount(codes[np.repeat(train, tokens)], minlength=len(keys))
    null = ids.is_null().to_numpy(zero_copy_only=False)
    body = joined(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), null.tobytes(), train.tobytes(), squeeze(tokens), squeeze(codes), squeeze_sorted(keys), squeeze(learned))
    return body, len(keys), len(codes), int(tokens[train].sum())


class Chunk:
    def __init__(self, body: bytes):
        ids, null, train, tokens, codes, keys, learned = parted(body)
        self.ids = pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(null, bool))
        self.train = np.frombuffer(train, bool)
        self.tokens, self.codes = unsqueeze(tokens).astype(np.int64), unsqueeze(codes).astype(np.int64)
        self.keys, self.learned = unsqueeze_sorted(keys), unsqueeze(learned)

    def grams(self, order: int, bits: int = 64) -> np.ndarray:
        """The hash, of so many bits, of the n-gram that ends at each token; it begins with BEGIN where it would pass the text's start."""
        words = self.keys[self.codes]
        first = np.cumsum(self.tokens) - self.tokens
        grams = words
        for _ in range(order - 1):
            context = np.empty_like(grams)
            context[1:] = grams[:-1]
            context[first] = BEGIN
            grams = mix(context, words)
        return grams >> np.uint64(64 - bits)

    def counted(self, order: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams, their training occurrences here, and each token's n-gram number."""
        if order == 1:
            return self.keys, self.learned, self.codes
        return group_sums(self.grams(order, bits), np.repeat(self.train, self.tokens).astype(np.uint64))

    def counts(self, replies: list[list[bytes] | None], bits: int = 64) -> list[np.ndarray]:
        """Of each token, the training count of its n-gram, from order 1 on."""
        return [answered(r).astype(np.int64)[self.counted(n + 1, bits)[2]] for n, r in enumerate(replies)]


class Counted:
    """A chunk's texts without their words: of each token, the training counts of its n-grams."""

    def __init__(self, body: bytes):
        ids, null, train, tokens, *counts = parted(body)
        self.ids = pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(null, bool))
        self.train = np.frombuffer(train, bool)
        self.tokens = unsqueeze(tokens).astype(np.int64)
        self.counts = [unsqueeze(x).astype(np.int64) for x in counts]  # from order 1 on

    @staticmethod
    def body(chunk: bytes, counts: list[np.ndarray]) -> bytes:
        return joined(*parted(chunk)[:4], *(squeeze(x) for x in counts))

    def contexts(self, texts: int, tokens: int) -> list[np.ndarray]:
        """Of each token, how often training has its context, from order 1 on; `texts`: training texts."""
        first = np.cumsum(self.tokens) - self.tokens
        out = [np.full(len(self.counts[0]), tokens)]
        for shorter in self.counts[:-1]:
            context = np.empty_like(shorter)
            context[1:] = shorter[:-1]
            context[first] = texts
            out.append(context)
        return out


def _octave(count: np.ndarray) -> np.ndarray:
    """0, 1, 2, 3-4, 5-8, ... as 0, 1, 2, 3, 4, ..."""
    return np.where(count > 0, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 0)


def bucket(contexts: list[np.ndarray]) -> np.ndarray:
    """By the longest context that training has, and its frequency."""
    out = np.zeros(len(contexts[0]), np.int64)
    for order, context in enumerate(contexts[1:], 1):
        out = np.where(context > 0, 64 * order + _octave(context), out)
    return out


def estimates(counts: list[np.ndarray], contexts: list[np.ndarray]) -> list[np.ndarray]:
    return [np.where(n > 0, c / np.maximum(n, 1), 0.0) for c, n in zip(counts, contexts)]


def learn(histogram: list[tuple[int, list[int], int]], order: int, uniform: float, rounds: int = EM_ROUNDS) -> dict[int, np.ndarray]:
    """Mixture weights of each bucket, from the uniform estimate up to the longest order; bucket -1 has those of all tokens."""
    out: dict[int, np.ndarray] = {}
    every: dict[int, list] = {}
    for number, bins, times in histogram:
        every.setdefault(number, []).append((bins, times))
        every.setdefault(-1, []).append((bins, times))
    for number, rows in every.items():
        bins = np.array([b for b, _ in rows], np.float64).reshape(-1, order)
        times = np.array([t for _, t in rows], np.float64)
        p = np.concatenate([np.full((len(rows), 1), uniform), np.where(bins < 0, 0.0, 2.0 ** (-bins / BINS_PER_OCTAVE))], axis=1)
        weight = np.full(order + 1, 1 / (order + 1))
        for _ in range(rounds):
            share = weight * p
            weight = (times[:, None] * share / share.sum(1, keepdims=True)).sum(0) / times.sum()
        # A floor keeps every weight above zero, so no text has probability zero.
        weight = np.maximum(weight, 1e-6)
        out[number] = weight / weight.sum()
    return out


def scores(docs: DataFrame, train: Column, order: int = ORDER) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score: one row for each row of docs, repeated rows too.

    train: a boolean column over doc_id; rows of which it isn't true only get scores. A null or empty text
    is its end mark alone. Without training tokens every estimate is the uniform one. The scores are log10.
    Columns but doc_id and text are not read.
    """
    docs = clean_documents(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for part in pieces(batches, "text", CHUNK_BYTES):
            learns = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
            body, keys, tokens, learned = chunk_of(part.column(0), part.column(1), learns)
            yield pa.record_batch([pa.array([x], pa.int64()) for x in (chunk, keys, tokens, learned, int(learns.sum()))] + [pa.array([body], pa.binary())], names=["chunk", "n_keys", "n_tokens", "n_learned", "n_texts", "payload"])
            chunk += 1

    chunks = stored(packed(docs).mapInArrow(cut, "chunk long, n_keys long, n_tokens long, n_learned long, n_texts long, payload binary"), "lm-chunks", "uncompressed")
    n_keys, n_tokens, learned, texts, n_chunks = (x or 0 for x in chunks.agg(F.sum("n_keys"), F.sum("n_tokens"), F.sum("n_learned"), F.sum("n_texts"), F.count("*")).first())
    bits = key_bits(n_tokens)

    def reply(keys: np.ndarray, columns: list[np.ndarray], _: np.ndarray) -> tuple[list[np.ndarray], dict[str, int]]:
        _, sums, number = group_sums(keys, columns[0])
        return [sums[number]], {"known": int((sums > 0).sum())}

    replies, distinct = [], 0
    for n in range(1, order + 1):

        def question(row: dict, n: int = n) -> tuple[np.ndarray, list[np.ndarray]]:
            keys, here, _ = Chunk(row["payload"]).counted(n, bits)
            return keys, [here]

        asked = ask(chunks, question, shard_number(n_keys), 64) if n == 1 else ask(chunks, question, shard_number(n_tokens), bits)
        replies.append(stored(answer(asked, reply), f"lm-counts{n}", "snappy"))
        del asked
        free_messages(docs.sparkSession)  # so that the disk holds one order's messages at a time
        if n == 1:
            distinct = replies[0].where("chunk is null").agg(F.sum(F.col("stats")[0])).first()[0] or 0
    uniform = 1 / (distinct + 1)
    names = [f"reply{n}" for n in range(order)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                body = row.pop("payload")
                yield pa.record_batch([pa.array([Counted.body(body, Chunk(body).counts([row.pop(name) for name in names], bits))], pa.binary())], names=["payload"])

    full = in_tasks(with_answers(chunks, *replies).select("payload", *names), n_chunks * CHUNK_BYTES)
    counted = stored(full.mapInArrow(count, "payload binary"), "lm-counted", "uncompressed")
    discard(chunks, *replies)
    del replies, full
    free_messages(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Counted, list[np.ndarray], list[np.ndarray]]]:
        for batch in batches:
            for body in batch.column(0):
                chunk = Counted(body.as_py())
                yield chunk, chunk.counts, chunk.contexts(texts, learned)

    def deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, times = np.empty(0, np.int64), np.empty(0, np.int64)  # of the whole task
        for chunk, counts, contexts in rows(batches):
            held = np.repeat(chunk.train, chunk.tokens)
            contexts = [x[held] - 1 for x in contexts]
            p = estimates([x[held] - 1 for x in counts], contexts)
            code = bucket(contexts)
            for x in p:
                bins = np.where(x > 0, np.round(-BINS_PER_OCTAVE * np.log2(np.where(x > 0, x, 1))), -1).astype(np.int64)
                code = code * 1024 + np.minimum(bins + 1, 1023)
            some, often = np.unique(code, return_counts=True)
            values, times, _ = group_sums(np.append(values, some), np.append(times, often))
        yield pa.record_batch([pa.array(values), pa.array(times)], names=["code", "times"])

    def uncode(code: int) -> tuple[int, list[int]]:
        bins = []
        for _ in range(order):
            bins.append(code % 1024 - 1)
            code //= 1024
        return code, bins[::-1]

    histogram = counted.mapInArrow(deleted, "code long, times long").groupBy("code").agg(F.sum("times").alias("times")).orderBy("code")
    weights = learn([(*uncode(x["code"]), x["times"]) for x in histogram.toLocalIterator()], order, uniform)
    pooled = weights.pop(-1, np.append(1.0, np.zeros(order)))
    number = np.array(sorted(weights), np.int64)
    matrix = np.array([weights[k] for k in sorted(weights)] + [pooled])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, counts, contexts in rows(batches):
            in_bucket = bucket(contexts)
            at = np.minimum(np.searchsorted(number, in_bucket), max(len(number) - 1, 0))
            weight = matrix[np.where(number[at] == in_bucket, at, len(number))] if len(number) else np.broadcast_to(pooled, (len(in_bucket), order + 1))
            p = weight[:, 0] * uniform
            for n, x in enumerate(estimates(counts, contexts), 1):
                p = p + weight[:, n] * x
            base = np.log10((counts[0] + 0.5) / (learned + 0.5 * (distinct + 1)))
            first = np.cumsum(chunk.tokens) - chunk.tokens
            yield pa.record_batch(
                [
                    chunk.ids, pa.array(chunk.train), pa.array(chunk.tokens), pa.array(np.add.reduceat(counts[0] > 0, first, dtype=np.int64)),
                    pa.array(np.full(len(first), learned), pa.int64()), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(np.log10(p), first)),
                ],
                names=["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return counted.mapInArrow(score, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def fold(column: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id, which is of no fold and never trained on."""
    return F.crc32(F.col(column).cast("long").cast("string")) % folds


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scores(table(spark, sf_dir, "documents"), fold() != 1)
    return scored.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
