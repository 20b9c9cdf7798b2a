"""SimHash near-duplicate groups through a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank, in which codes that differ in few bits tend to lie side by side.
A tree stands over the sorted codes: each node keeps, as a mask and a pattern, the bits on which all
codes below it agree and which no node above already holds. A search adds up, from the root, the bits
in which the query differs from these patterns and leaves a whole subtree once the sum exceeds the limit.

To spread the work, each distinct fingerprint is dealt into four trees' key spaces, one per 16-bit block:
two codes that differ in at most three bits agree on one block at least, so each link is found in some
key group, and a group is one task's work. A group with more than `GROUP` codes is dealt again by four
blocks of the bits that its codes don't yet share, until none is larger; nothing is capped.

Copies collapse to one fingerprint before anything is shuffled. A group returns a spanning forest (at
most one edge a code), never its pairs; components come from alternating large-star and small-star
rounds, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessella.llm.common import NOT_WHITE, clean_documents, distinct, in_tasks, packed, pieces, stored, table, word_cuts

DISTANCE = 3
SHINGLE = 3
SEED = 42
GROUP = 4096
FANOUT = 8
LINK_ROWS = 8 * GROUP  # codes of a task that searches
TABLE_ROWS = 1 << 18  # rows of a stored file of codes or edges
HOT_COPIES = 1 << 14  # of one fingerprint, that don't meet in one task


def fingerprints_of(column: pa.Array, width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """uint64 SimHash of each text; a text without words has 0."""
    data, starts, counts = word_cuts(column, NOT_WHITE, spaced=True)
    out = np.zeros(len(counts), np.uint64)
    if len(starts) < 2:
        return out
    buffer = data.tobytes()
    last_word = np.cumsum(counts)
    ends = starts[1:] - 1  # the space before the next word
    ends[last_word[counts > 0] - 1] += 1  # after a text's last word there is none
    shingles = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    firsts = np.repeat(last_word - counts, shingles) + np.arange(shingles.sum()) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    lasts = firsts + np.repeat(np.minimum(width, counts), shingles) - 1
    digest = xxhash.xxh64_intdigest
    held = np.flatnonzero(shingles)
    step = 1 << 18
    begin = np.cumsum(shingles) - shingles
    votes = np.zeros((len(held), 64), np.int64)
    first_byte, end_byte = starts[firsts].tolist(), ends[lasts].tolist()
    for low in range(0, len(first_byte), step):  # bits of a part at a time
        high = min(low + step, len(first_byte))
        h = np.fromiter((digest(buffer[s:e], seed) for s, e in zip(first_byte[low:high], end_byte[low:high])), np.uint64, high - low)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        cut = begin[held]
        which = np.searchsorted(cut, low, "right") - 1
        until = np.searchsorted(cut, high, "left")
        at = np.maximum(cut[which:until] - low, 0)
        votes[which:until] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    bits = (2 * votes > shingles[held][:, None]).astype(np.uint8)
    out[held] = np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a signed long; one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            fp = fingerprints_of(part.column(1), width, seed)
            yield pa.record_batch([part.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return packed(clean_documents(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))).mapInArrow(run, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayTree:
    """The hierarchical index over codes that are sorted by Gray rank."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # own mask and pattern, from the leaves up
        ones, zeros = codes, ~codes
        shared = []
        while True:
            cut = np.arange(0, len(ones), FANOUT)
            ones, zeros = np.bitwise_and.reduceat(ones, cut), np.bitwise_and.reduceat(zeros, cut)
            shared.append((ones | zeros, ones))
            if len(ones) == 1:
                break
        above = np.zeros(1, np.uint64)
        for mask, pattern in reversed(shared):
            parents = above if len(mask) == 1 else np.repeat(above, FANOUT)[: len(mask)]
            self.levels.append((mask & ~parents, pattern))
            above = mask

    def search(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query number, code number) within `limit` bits."""
        q, node, spent = np.arange(len(queries)), np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        for depth, (mask, pattern) in enumerate(self.levels):
            if depth:
                q, node, spent = np.repeat(q, FANOUT), (node[:, None] * FANOUT + np.arange(FANOUT)).ravel(), np.repeat(spent, FANOUT)
                real = node < len(mask)
                q, node, spent = q[real], node[real], spent[real]
            spent = spent + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
            near = spent <= limit
            q, node, spent = q[near], node[near], spent[near]
        q, code = np.repeat(q, FANOUT), (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        real = code < len(self.codes)
        q, code = q[real], code[real]
        near = np.bitwise_count(queries[q] ^ self.codes[code]) <= limit
        return q[near], code[near]


def forest(codes: np.ndarray, group: np.ndarray, limit: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Edges (code, representative) that join, within each group, what chains of links join; codes are distinct in a group."""
    order = np.lexsort((gray_rank(codes), group))
    codes, group = codes[order], group[order]
    label = np.arange(len(codes))
    cuts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(codes))
    # Groups lie one after another; small ones share a tree, and pairs across groups (which are true links too) do no harm.
    begin = 0
    while begin < len(codes):
        end = int(cuts[np.searchsorted(cuts, begin + GROUP, "right") - 1])
        if end <= begin:
            end = int(cuts[np.searchsorted(cuts, begin, "right")])
        tree = GrayTree(codes[begin:end])
        for low in range(begin, end, 512):
            q, c = tree.search(codes[low : min(low + 512, end)], limit)
            a, b = q + low, c + begin
            one_way = a > b
            a, b = a[one_way], b[one_way]
            while len(a):  # join the labels of linked codes
                ra, rb = label[a], label[b]
                while True:  # roots
                    na, nb = label[ra], label[rb]
                    if np.array_equal(na, ra) and np.array_equal(nb, rb):
                        break
                    ra, rb = na, nb
                apart = ra != rb
                if not apart.any():
                    break
                a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
                np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        begin = end
    while True:
        up = label[label]
        if np.array_equal(up, label):
            break
        label = up
    child = label != np.arange(len(codes))
    return codes[child], codes[label[child]]


def block_masks(free: int, parts: int = DISTANCE + 1) -> list[int]:
    """`free`, the bits of a mask, as so many masks of neighbouring bits."""
    bits = [1 << b for b in range(64) if free >> b & 1]
    return [sum(x) for x in (bits[i * len(bits) // parts : (i + 1) * len(bits) // parts] for i in range(parts))]


def _deal(df: DataFrame) -> DataFrame:
    """Each row once for each block of the bits that its group doesn't share yet. part: a hash of the group's path and values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            free = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            part = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            for mask in distinct(free):
                rows = np.flatnonzero(free == mask)
                for i, block in enumerate(block_masks(int(mask))):
                    value = fp[rows] & np.uint64(block)
                    mixed = (part[rows] ^ value) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i + 1)
                    mixed ^= mixed >> np.uint64(29)
                    mixed *= np.uint64(0xBF58476D1CE4E5B9)
                    mixed ^= mixed >> np.uint64(32)
                    left = np.full(len(rows), mask & ~np.uint64(block), np.uint64)
                    yield pa.record_batch([pa.array(x.view(np.int64)) for x in (fp[rows], left, mixed)], names=["fp", "free", "part"])

    return df.select("fp", "free", "part").mapInArrow(run, "fp long, free long, part long")


def _link(df: DataFrame, limit: int, rows: int) -> DataFrame:
    """Forests of the groups of df, which has so many rows. Searching is work for CPUs, so tasks go by rows and not by their few bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(fp: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
            a, b = forest(fp.view(np.uint64), part, limit)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        fp, part = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            fp = np.append(fp, batch.column(0).to_numpy(zero_copy_only=False))
            part = np.append(part, batch.column(1).to_numpy(zero_copy_only=False))
            if len(fp) >= LINK_ROWS:
                cut = int(np.searchsorted(part, part[-1]))  # sorted by part: the last group may go on
                if cut:
                    yield found(fp[:cut], part[:cut])
                    fp, part = fp[cut:], part[cut:]
        if len(fp):
            yield found(fp, part)

    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // LINK_ROWS))
    return df.repartition(tasks, "part").sortWithinPartitions("part").select("fp", "part").mapInArrow(run, "a long, b long").coalesce(tasks)


def links(nodes: DataFrame, limit: int = DISTANCE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links of at most `limit` (3 or fewer) bits."""
    if limit > DISTANCE:
        raise ValueError(f"at most {DISTANCE} bits")
    work, found = nodes.select("fp", F.lit(-1).cast("long").alias("free"), F.lit(0).cast("long").alias("part")), None
    while True:
        dealt = stored(_deal(work), "simhash-dealt", "snappy")
        rows = dealt.count()
        large = stored(in_tasks(dealt.groupBy("part", "free").count().where(F.col("count") > GROUP).select("part"), rows // GROUP, TABLE_ROWS), "simhash-large", "snappy")
        none_large = large.isEmpty()
        small = dealt if none_large else dealt.join(large, "part", "left_anti")
        edges = stored(_link(small, limit, rows), "simhash-edges", "snappy")
        found = edges if found is None else found.unionByName(edges)
        if none_large:
            return found
        work = dealt.join(large, "part", "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node of its component, for each node that has an edge. Alternates large-star and small-star rounds."""
    rows = edges.count()

    def kept(df: DataFrame) -> DataFrame:
        return stored(in_tasks(df.distinct(), rows, TABLE_ROWS), "star", "snappy")  # rounds only shorten the edges

    edges = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first())

    before = state(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        large = kept(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        edges = kept(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        now = state(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _grouped(prints: DataFrame, limit: int) -> DataFrame:
    """fp, root, least_doc, copies of each distinct fingerprint of prints (doc_id, fp)."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least_doc"), F.count("*").alias("copies"))
    nodes = stored(in_tasks(nodes, prints.count(), TABLE_ROWS), "simhash-nodes", "snappy")
    roots = components(links(nodes, limit))
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, limit: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach), copies (rows of that fingerprint).

    One row for each row of docs, repeated rows too. A null text counts as empty and an empty one has the
    fingerprint zero, which links like any other. A row with a null doc_id is kept; its component's id is
    the smallest of the others, or null if there are none. Columns but doc_id and text are not read.
    """
    prints = stored(fingerprints(docs), "simhash-prints", "snappy")
    rows = prints.count()
    placed = _grouped(prints, limit)
    least = placed.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    placed = stored(in_tasks(placed.join(least, "root").select("fp", "component_id", "copies"), rows, TABLE_ROWS), "simhash-placed", "snappy")
    # Rows of a fingerprint with many copies don't shuffle: at most 65,536 fingerprints have so many, and these are broadcast.
    many = max(HOT_COPIES, rows >> 16)
    hot = placed.where(F.col("copies") > many)
    common = prints.join(F.broadcast(hot), "fp")
    others = prints.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(placed.where(F.col("copies") <= many).hint("merge"), "fp")
    every = common.unionByName(others)
    return every.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies")


def one_of_each(docs: DataFrame, limit: int = DISTANCE) -> DataFrame:
    """One row of each group, with all its columns: that of the smallest doc_id (null: the largest), then fingerprint, then place.

    Rows are numbered as they are stored; a group's chosen row is found among these numbers, so repeated doc_ids do no harm.
    """
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId() << 40
        for part in pieces(batches, "text"):
            fp = fingerprints_of(part.column(part.schema.get_field_index("text"))).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fp), pa.array(np.arange(place, place + len(fp)))], names=[*part.schema.names, "simhash fp", "simhash place"])
            place += len(fp)

    named = StructType([*schema.fields, StructField("simhash fp", LongType()), StructField("simhash place", LongType())])
    numbered = stored(packed(docs).mapInArrow(run, named), "simhash-numbered")
    rows = numbered.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("simhash fp").alias("fp"), F.col("simhash place").alias("place"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "place")).alias("first")
    heads = rows.groupBy("fp").agg(first)  # one row for each fingerprint before groups meet
    placed = _grouped(rows.select("doc_id", "fp"), limit).select("fp", "root")
    chosen = heads.join(placed, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.place").alias("simhash place"))
    return numbered.hint("merge").join(chosen, "simhash place", "left_semi").select(*[F.col(f"`{c}`") for c in schema.names])


def op4_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
