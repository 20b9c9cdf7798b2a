"""Line dedup by sharded minimal perfect hash functions.

Chunks of documents are stored once, as compressed Arrow. Each chunk asks about its distinct line keys
(see exchange.py); each shard builds, over its distinct line hashes, a minimal perfect hash function
with three arrays beside it: a fingerprint, the number of documents, the largest doc_id. The lines'
entries probe these arrays, and no line text or line row is ever joined. Replies name, for each frequent
key of a chunk, its largest doc_id; the chunk then drops its lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import LOWER, NOT_WHITE, clean_documents, distinct, fresh_name, in_tasks, packed, pieces, stored, table, text_bytes
from tessella.llm.exchange import answer, answered, ask, mix, shard_number, with_answers

MIN_CHARS = 40
MIN_DOCS = 5
CHUNK_BYTES = 4 << 20
#: doc_id as an unsigned integer in order; 0 stands for null, which is smaller than any.
_OFFSET = np.uint64(1 << 63)


class MinimalPerfectHash:
    """Numbers n distinct uint64 keys 0 .. n - 1, each in about three bits.

    Level by level, keys that share their place with no other set its bit; the rest go to the next level.
    A key's number is the number of bits set before its own.
    """

    def __init__(self, keys: np.ndarray, room: float = 2.0):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.size = len(keys)
        base = 0
        while len(keys):
            size = max(8, int(len(keys) * room))
            place = self._place(keys, len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            blocks = np.add.reduceat(alone, np.arange(0, size, 512), dtype=np.int64)
            self.levels.append((size, np.packbits(alone), base + np.cumsum(blocks) - blocks))
            base += int(alone.sum())
            keys = keys[~alone[place]]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys, np.uint64(level + 1)) % np.uint64(size)).astype(np.int64)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """Of keys that it was built from, their numbers; of others, any number or -1."""
        out = np.full(len(keys), -1, np.int64)
        live = np.arange(len(keys))
        for level, (size, bits, before) in enumerate(self.levels):
            place = self._place(keys[live], level, size)
            held = (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
            at = place[held]
            first = at >> 9 << 6  # the byte in which the block of 512 bits begins
            window = np.minimum(first[:, None] + np.arange(64), len(bits) - 1)
            within = np.bitwise_count(bits[window]) * (first[:, None] + np.arange(64) < (at >> 3)[:, None])
            partial = np.bitwise_count(bits[at >> 3] >> (8 - (at & 7)).astype(np.uint8)) * ((at & 7) > 0)
            out[live[held]] = before[at >> 9] + within.sum(1, dtype=np.int64) + partial
            live = live[~held]
        return out


def same_lines(keys: np.ndarray, fingerprint: np.ndarray, *then: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of lines by hash, then by `then`, and where in it another line than before begins. A line's hash is both its halves."""
    order = np.lexsort((*then, fingerprint, keys))
    k, f = keys[order], fingerprint[order]
    return order, np.append(True, (k[1:] != k[:-1]) | (f[1:] != f[:-1]))[: len(k)]


class LineIndex:
    """The minimal perfect hash of distinct line hashes (two halves each), with compact arrays: fingerprint, documents, largest doc_id."""

    def __init__(self, keys: np.ndarray, fingerprint: np.ndarray, documents: np.ndarray, largest: np.ndarray):
        self.seed = 0
        while len(distinct(self._code(keys, fingerprint))) < len(keys):  # two lines' codes met
            self.seed += 1
        self.hash = MinimalPerfectHash(self._code(keys, fingerprint))
        place = self.hash.number(self._code(keys, fingerprint))
        self.fingerprint, self.documents, self.largest = (np.empty_like(x) for x in (fingerprint, documents, largest))
        self.fingerprint[place], self.documents[place], self.largest[place] = fingerprint, documents, largest

    def _code(self, keys: np.ndarray, fingerprint: np.ndarray) -> np.ndarray:
        return mix(keys ^ np.uint64(self.seed), fingerprint)

    @classmethod
    def of(cls, keys: np.ndarray, fingerprint: np.ndarray, documents: np.ndarray, largest: np.ndarray) -> LineIndex:
        """From what chunks say about their lines, which repeat: documents add up, the largest doc_id of all counts."""
        order, fresh = same_lines(keys, fingerprint)
        starts = np.flatnonzero(fresh)
        return cls(keys[order][starts], fingerprint[order][starts], np.add.reduceat(documents[order], starts), np.maximum.reduceat(largest[order], starts))

    def probe(self, keys: np.ndarray, fingerprint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and largest doc_id of each line; none if the fingerprint is another."""
        place = self.hash.number(self._code(keys, fingerprint))
        known = (place >= 0) & (self.fingerprint[place] == fingerprint) if self.hash.size else np.zeros(len(keys), bool)
        return np.where(known, self.documents[place], 0) if self.hash.size else known.astype(np.uint64), np.where(known, self.largest[place], 0) if self.hash.size else known.astype(np.uint64)


def lines_of(column: pa.Array, min_chars: int = MIN_CHARS) -> tuple[np.ndarray, ...]:
    """Of all lines of all texts, in order: lines per text; the keys' numbers of lines that can be dropped, their line
    numbers, and 128-bit hashes as two uint64 arrays."""
    raw, offsets = text_bytes(column)
    breaks = np.flatnonzero(raw == 10)
    lines = np.diff(np.searchsorted(breaks, offsets)) + 1
    # begins and ends: a text's lines lie between its offsets and the breaks in it
    text = np.repeat(np.arange(len(lines)), lines)
    head = np.cumsum(lines) - lines
    begin, end = np.empty(len(text), np.int64), np.empty(len(text), np.int64)
    is_head = np.zeros(len(text), bool)
    is_head[head] = True
    begin[is_head], begin[~is_head] = offsets[:-1], breaks + 1
    is_last = np.append(is_head[1:], True)[: len(text)]
    end[is_last], end[~is_last] = offsets[1:], breaks
    solid = np.flatnonzero(NOT_WHITE[raw])
    if not len(solid):
        return lines, np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    a, b = np.searchsorted(solid, begin), np.searchsorted(solid, end)
    some = np.flatnonzero((a < b) & (end - begin >= min_chars))
    first, last = solid[a[some]], solid[b[some] - 1] + 1
    points = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    long = points[last] - points[first] >= min_chars
    some, first, last = some[long], first[long], last[long]
    buffer = LOWER[raw].tobytes()
    digest = xxhash.xxh3_128_digest
    h = np.frombuffer(b"".join([digest(buffer[s:e]) for s, e in zip(first.tolist(), last.tolist())]), np.uint64).reshape(-1, 2)
    return lines, some, np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1])


def _ids(column: pa.Array) -> np.ndarray:
    values = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ _OFFSET
    return np.where(column.is_null().to_numpy(zero_copy_only=False), np.uint64(0), values)


def _keys(part: pa.RecordBatch, min_chars: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """First halves of the distinct line hashes of a chunk, sorted by both halves, and of each: the second half, documents, largest doc_id."""
    lines, some, key, check = lines_of(part.column(part.schema.get_field_index("text")), min_chars)
    doc = np.searchsorted(np.cumsum(lines), some, "right")
    order, fresh = same_lines(key, check, doc)
    key, check, doc = key[order], check[order], doc[order]
    starts = np.flatnonzero(fresh)
    if not len(starts):
        return key, [check, key, key]
    counted = fresh | np.append(True, doc[1:] != doc[:-1])
    documents = np.add.reduceat(counted, starts, dtype=np.int64).astype(np.uint64)
    return key[starts], [check[starts], documents, np.maximum.reduceat(_ids(part.column(part.schema.get_field_index("doc_id")))[doc], starts)]


def _load(row: dict) -> pa.RecordBatch:
    return pa.ipc.open_stream(row["payload"]).read_next_batch()


def marked(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of docs with n_lines, n_dropped and kept (the lines that stay, joined by newlines).

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of `min_chars` code
    points or more that `min_docs` rows or more hold lose all their lines but those in the largest doc_id.
    Rows count as documents of their own even where doc_ids repeat; of a frequent line all rows with the
    largest doc_id keep theirs. A null doc_id is smaller than any. A null or empty text is one empty line.
    Where docs has columns of the new names, they keep theirs and the new ones are called n_lines_1 and so on.
    """
    schema = docs.schema
    names = [fresh_name(x, docs.columns) for x in ("n_lines", "n_dropped", "kept")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for part in pieces(batches, "text", CHUNK_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as out:
                out.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.columns], schema=part.schema))
            keys, _ = _keys(part, min_chars)
            yield pa.record_batch([pa.array([chunk], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "n_keys", "payload"])
            chunk += 1

    chunks = stored(packed(docs).mapInArrow(cut, "chunk long, n_keys long, payload binary"), "lines-chunks", "uncompressed")
    n_keys, n_chunks = (x or 0 for x in chunks.agg(F.sum("n_keys"), F.count("*")).first())
    shards = shard_number(n_keys)

    def reply(keys: np.ndarray, columns: list[np.ndarray], _: np.ndarray) -> tuple[list[np.ndarray], dict[str, int]]:
        check, documents, largest = columns
        index = LineIndex.of(keys, check, documents, largest)
        held, last = index.probe(keys, check)
        often = held >= min_docs
        return [often.astype(np.uint64), np.where(often, last, 0)], {}

    asked = ask(chunks, lambda row: _keys(_load(row), min_chars), shards)
    replies = stored(answer(asked, reply), "lines-replies", "snappy")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                yield _dropped(_load(row), answered(row["reply0"]) > 0, answered(row["reply0"], 1), min_chars, names)

    full = in_tasks(with_answers(chunks.drop("n_keys"), replies), n_chunks * CHUNK_BYTES)
    added = [T.StructField(name, kind) for name, kind in zip(names, (T.LongType(), T.LongType(), T.StringType()))]
    return full.mapInArrow(drop, T.StructType([*schema.fields, *added]))


def _dropped(part: pa.RecordBatch, often: np.ndarray, last: np.ndarray, min_chars: int, names: list[str]) -> pa.RecordBatch:
    texts = part.column(part.schema.get_field_index("text"))
    lines, some, key, check = lines_of(texts, min_chars)
    doc = np.searchsorted(np.cumsum(lines), some, "right")
    order, fresh = same_lines(key, check)
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(fresh) - 1
    gone = often[number] & (last[number] != _ids(part.column(part.schema.get_field_index("doc_id")))[doc]) if len(key) else np.empty(0, bool)
    dropped = np.bincount(doc[gone], minlength=len(lines))
    kept = texts.fill_null("").to_pylist()
    head = np.cumsum(lines) - lines
    at, whose = some[gone], doc[gone]
    cuts = np.searchsorted(whose, np.arange(len(lines) + 1))
    for d in np.flatnonzero(dropped):
        out = set((at[cuts[d] : cuts[d + 1]] - head[d]).tolist())
        kept[d] = "\n".join(x for k, x in enumerate(kept[d].split("\n")) if k not in out)
    return pa.RecordBatch.from_arrays([*part.columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=[*part.schema.names, *names])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = clean_documents(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return marked(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[ \\t-\\r]+|[ \\t-\\r]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), often AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.doc_id, k.pos, k.line, o.key IS NOT NULL AND k.doc_id <> o.keeper AS gone
  FROM keyed k LEFT JOIN often o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
