"""Benchmark decontamination with suffix arrays over the training documents.

Each piece of the documents (some megabytes of whole texts) becomes a shard: its words as integers, a
separator after each document, and the suffix array of all its words, made by doubling the compared
length until it covers the longest test item. Every test suffix is then looked up in every shard by
binary search, all suffixes at once; the neighbours of the place found give the longest verbatim match,
and the run of equal suffixes gives every location of a window.

The documents are read once and never shuffled. Test items are sent to the executors in blocks of about
`BLOCK_BYTES` of text, so what is broadcast is bounded whatever the size of the test set; with more
than one block the hit spans of a document meet in one aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import ALNUM_RAW, binary_array, clean_documents, distinct, packed, pieces, ranges, table, word_cuts

WINDOW = 13
SHARE = 20  # a document is affected if one word in so many is hit
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20
HITS = "doc_id long, n_words long, spans array<long>, items array<string>, longest long"


class TestBlock:
    """The words, suffixes and windows of a block of test items."""

    __test__ = False  # no test class

    def __init__(self, ids: list[str], texts: list[str | None], width: int = WINDOW):
        data, starts, counts = word_cuts(pa.array(texts, pa.string()), ALNUM_RAW)
        coded = binary_array(data, starts).dictionary_encode()
        self.ids, self.vocabulary = ids, coded.dictionary
        self.words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.repeat(np.cumsum(counts), counts)
        self.longest = int(counts.max(initial=0))
        #: Of every suffix: its first word, its words to the end of the item, its item.
        self.start = np.arange(len(self.words))
        self.left = end - self.start
        self.item = np.repeat(np.arange(len(ids)), counts)
        #: The words of the window that it begins: `width`, or all of a shorter item, or none.
        whole = self.left == np.repeat(counts, counts)
        self.window = np.where(self.left >= width, width, np.where(whole, self.left, 0))


class Shard:
    """The suffix array of words given as codes of the test vocabulary; -1 is a separator or a word that no item has.

    Only suffixes that begin with a known word are in the array: no test suffix starts with another or
    goes past one. They are in order of their words up to the first unknown one, `depth` words at least.
    """

    def __init__(self, codes: np.ndarray, depth: int):
        self.codes, n = codes, len(codes)
        at = np.flatnonzero(codes >= 0)
        base, width = int(codes.max(initial=0)) + 2, 1
        padded = np.zeros(n + depth + 64, np.int64)
        padded[:n] = codes + 1
        key = padded[at]
        while width < depth and base ** (width + 1) < 2**62:  # as many words as one integer holds
            key = key * base + padded[at + width]
            width += 1
        by = np.argsort(key)
        order, key = at[by], key[by]
        rank = np.zeros(n + 1, np.int64)
        tied = self._place(rank, order, key, np.arange(len(at)))
        while width < depth and len(tied):  # only suffixes that are still equal are compared further
            some = order[tied]
            key = rank[some] * (n + 2) + rank[np.minimum(some + width, n)]
            by = np.argsort(key)
            order[tied] = some = some[by]
            tied = self._place(rank, some, key[by], tied)
            width *= 2
        self.order = order

    @staticmethod
    def _place(rank: np.ndarray, some: np.ndarray, key: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Sets the ranks of suffixes that are now in order in `slots`; returns the slots of those that are still tied."""
        fresh = np.append(True, key[1:] != key[:-1])[: len(key)]
        rank[some] = np.maximum.accumulate(np.where(fresh, slots, 0)) + 1
        return slots[~(fresh & np.append(fresh[1:], True)[: len(key)])]

    def matched(self, words: np.ndarray, start: np.ndarray, length: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of each suffix's first `length` words stand at the positions `at`; at -1: none."""
        out = np.zeros(len(start), np.int64)
        live = np.flatnonzero((at >= 0) & (length > 0))
        while len(live):
            k = out[live]
            place = at[live] + k
            inside = place < len(self.codes)
            live, k, place = live[inside], k[inside], place[inside]
            live = live[words[start[live] + k] == self.codes[place]]
            out[live] += 1
            live = live[out[live] < length[live]]
        return out

    def bound(self, words: np.ndarray, start: np.ndarray, length: np.ndarray, upper: bool) -> np.ndarray:
        """The first slot whose suffix is not before the given words; upper: the first that is after all that begin with them."""
        low, high = np.zeros(len(start), np.int64), np.full(len(start), len(self.order), np.int64)
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                return low
            mid = (low[live] + high[live]) // 2
            at = self.order[mid]
            same = self.matched(words, start[live], length[live], at)
            whole = same == length[live]
            place = at + same
            theirs = np.where(place < len(self.codes), self.codes[np.minimum(place, len(self.codes) - 1)], -1)
            ours = words[np.minimum(start[live] + same, len(words) - 1)]
            right = np.where(whole, upper, theirs < ours)
            low[live] = np.where(right, mid + 1, low[live])
            high[live] = np.where(right, high[live], mid)

    def longest(self, block: TestBlock) -> tuple[np.ndarray, np.ndarray]:
        """Of every test suffix: the length of the longest match, and a position of it (-1: none)."""
        low = self.bound(block.words, block.start, block.left, upper=False)
        slots = np.concatenate([[-1], self.order, [-1]])
        before, here = slots[low], slots[low + 1]
        a, b = (self.matched(block.words, block.start, block.left, x) for x in (before, here))
        return np.maximum(a, b), np.where(b >= a, here, before)


def search(texts: pa.Array, test: TestBlock) -> tuple[np.ndarray, list[np.ndarray], list[list[str]], np.ndarray]:
    """Of each text: its words, the begins and ends of its hit spans, the items with windows in it, the longest match found in it."""
    data, starts, counts = word_cuts(texts, ALNUM_RAW)
    docs = len(counts)
    coded = binary_array(data, starts).dictionary_encode()
    known = pc.index_in(coded.dictionary, value_set=test.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(docs), counts + 1)
    first = np.cumsum(counts + 1) - (counts + 1)
    codes = np.full(len(owner), -1, np.int64)
    codes[np.arange(len(starts) - 1) + np.repeat(np.arange(docs), counts)] = known[coded.indices.to_numpy(zero_copy_only=False)]
    shard = Shard(codes, test.longest)
    longest, where = shard.longest(test)
    best = np.zeros(docs, np.int64)
    some = np.flatnonzero(longest > 0)
    np.maximum.at(best, owner[where[some]], longest[some])
    # A window occurs where its suffix matches so far; equal windows share a run of slots.
    full = np.flatnonzero((test.window > 0) & (longest >= test.window))
    size = test.window[full]
    low, high = (shard.bound(test.words, test.start[full], size, upper) for upper in (False, True))
    items_of: dict[tuple[int, int, int], set[int]] = {}
    for run, item in zip(zip(low.tolist(), high.tolist(), size.tolist()), test.item[full].tolist()):
        items_of.setdefault(run, set()).add(item)
    mark = np.zeros(len(codes) + 1, np.int64)
    items: list[set[int]] = [set() for _ in range(docs)]
    for (begin, end, words), mine in items_of.items():
        at = shard.order[begin:end]
        mark[at] += 1
        mark[at + words] -= 1
        for d in distinct(owner[at]).tolist():
            items[d] |= mine
    edge = np.flatnonzero(np.diff(np.cumsum(mark) > 0, prepend=False, append=False))
    of = owner[edge[::2]]
    spans = np.stack([edge[::2] - first[of], edge[1::2] - first[of]], 1)
    cut = np.searchsorted(of, np.arange(docs + 1))
    return counts, [spans[a:b].ravel() for a, b in zip(cut[:-1], cut[1:])], [sorted({test.ids[i] for i in x}) for x in items], best


def affected(n_words: int, spans: np.ndarray, share: int = SHARE) -> bool:
    hit = int(spans[1::2].sum() - spans[::2].sum())
    return hit > 0 and share * hit >= n_words


def _blocks(benchmark: DataFrame, width: int, limit: int) -> Iterator[TestBlock]:
    """Items in blocks of about `limit` bytes of text; the driver holds one block's items at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        ids.append(row[0] or "")
        texts.append(row[1])
        size += len(row[1] or "") + 64
        if size >= limit:
            yield TestBlock(ids, texts, width)
            ids, texts, size = [], [], 0
    if ids:
        yield TestBlock(ids, texts, width)


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (begin and end of each run of hit words, in turn), items (ids sorted as strings), longest.

    longest: the most words of a longest match of some test suffix whose found location lies in the document.
    One row for each row of docs, repeated rows too. A null or empty text has no words. An item without
    words has no window. Repeated items count once under their id; a null item_id is the empty string.
    Without test items nothing is hit. Columns but doc_id, item_id and text are not read.
    """
    return _hits(docs, benchmark, width, block_bytes).drop("text_key")


def _hits(docs: DataFrame, benchmark: DataFrame, width: int, block_bytes: int) -> DataFrame:
    docs = packed(clean_documents(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")))
    scans = [_scan(docs, block) for block in _blocks(benchmark, width, block_bytes)] or [_scan(docs, TestBlock([], [], width))]
    if len(scans) == 1:
        return scans[0]
    every = scans[0]
    for other in scans[1:]:
        every = every.unionByName(other)
    # Rows that agree in doc_id and text have the same hits; each returns as often as it came.
    met = every.groupBy("doc_id", "text_key", "n_words").agg(
        F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.max("longest").alias("longest"), (F.count("*") / len(scans)).cast("int").alias("times"),
    )
    merged = F.udf(merge_spans, "array<long>")
    return met.withColumn("again", F.explode(F.sequence(F.lit(1), "times"))).select("doc_id", "n_words", merged("spans").alias("spans"), "items", "longest", "text_key")


def _scan(docs: DataFrame, block: TestBlock) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text", SHARD_BYTES):
            counts, spans, items, best = search(part.column(1), held.value)
            columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), pa.array(best, pa.int64()), part.column(2)]
            yield pa.record_batch(columns, names=["doc_id", "n_words", "spans", "items", "longest", "text_key"])

    return docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(run, HITS + ", text_key long")


def merge_spans(spans: list[int]) -> list[int]:
    """The union of begin, end pairs."""
    out: list[int] = []
    for begin, end in sorted(zip(spans[::2], spans[1::2])):
        if out and begin <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [begin, end]
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES, share: int = SHARE) -> DataFrame:
    """The rows of docs, with all their columns, less those of which one word in `share` or more is hit. Rules as for hits()."""
    blocks = _blocks(benchmark, width, block_bytes)
    first, more = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if more is not None:
        found = _hits(docs, benchmark, width, block_bytes)
        bad = found.where(_affected(share)).select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
        same = F.col("doc_id").cast("long").eqNullSafe(F.col("bad_id")) & (F.xxhash64("text") == F.col("bad_key"))
        return docs.join(bad, same, "left_anti")
    held = docs.sparkSession.sparkContext.broadcast(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text", SHARD_BYTES):
            counts, spans, _, _ = search(part.column(part.schema.get_field_index("text")), held.value)
            yield part.filter(pa.array([not affected(n, s, share) for n, s in zip(counts.tolist(), spans)]))

    return packed(docs).mapInArrow(run, docs.schema)


def _n_hit() -> Column:
    return F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda total, x: total + x)


def _affected(share: int = SHARE) -> Column:
    return (_n_hit() > 0) & (share * _n_hit() >= F.col("n_words"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", _n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), _affected().alias("contaminated"),
    )
