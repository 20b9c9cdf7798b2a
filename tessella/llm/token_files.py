"""Token-id files in canonical, length-limited Huffman code.

A file is a folder with two Parquet tables. `header` has one row: the code length of every id. `blocks`
has a row for each block of whole documents, in ascending doc_id order over (part, number): the doc_ids,
their numbers of tokens, how many tokens of the part come before, the code (each document from a byte
boundary on), and checkpoints, the bit offset in the block of every `EVERY`-th token of a document. A
block decodes by itself, from all of its checkpoints at once, through one table indexed by the next
bits. Spark's commit protocol makes the file whole or absent, whatever executors are lost.

Documents are tokenised once, as stored rows of ids. Counts of all ids give the code. The coded
documents, not their texts, are then sorted by doc_id.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import NOT_WHITE, binary_array, clean_documents, packed, pieces, ranges, scratch_path, stored, table, text_bytes, word_cuts
from tessella.llm.exchange import squeeze, unsqueeze

END_ID = 2
EVERY = 64
BLOCK_TOKENS = 1 << 17
PIECE_BYTES = 2 << 20
TEXT_BYTES = 6 << 20  # whose distinct words are looked up together
CACHED_WORDS = 300_000
PARTS_BYTES = 16 << 20


_MIXED = re.compile("[a-zA-Z0-9']")
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True


#: The steps of the public word-level file, for which a word's ids don't depend on its neighbours.
WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
WORD_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


class Encoder:
    """Ids of texts by a tokenizers file.

    Where the file's steps never look past white space (exactly those of the public word-level file, BPE with word
    ends, and added tokens that begin with <| and take no white space in), a word's ids don't depend on its
    neighbours: distinct words are encoded once and kept in a bounded cache. Any other file encodes whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        steps = lambda x, inner: (x or {}).get(inner, [x] if x else [])
        self.suffix = spec["model"].get("end_of_word_suffix")
        plain = steps(spec["normalizer"], "normalizers") == WORD_NORMALIZERS and steps(spec["pre_tokenizer"], "pretokenizers") == [WORD_SPLIT, WORD_BYTES]
        apart = all(x["content"].startswith("<|") and not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in spec["added_tokens"])
        self.by_words = bool(self.suffix and plain and apart and spec["model"]["type"] == "BPE" and spec["post_processor"] is None)
        vocabulary = self.tokenizer.get_vocab(True)
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, bool)
        if self.suffix:
            self.ends[[i for w, i in vocabulary.items() if w.endswith(self.suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        """Starts a new generation; words that are met again move on to it, the others go with the one before."""
        self.older = getattr(self, "words", {})
        self.words: dict[bytes, bytes] = {}

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Ids end to end, the number of each word, and the order of the words in these."""
        # Runs of letters and runs of marks are one piece each; the last id of a piece is known by its suffix.
        easy = [i for i, w in enumerate(words) if w.isalpha() or (w.isascii() and not _MIXED.search(w))]
        ids, size, order = [], [], []
        parts = [easy[k : k + 500] for k in range(0, len(easy), 500)]
        odd = set(range(len(words))) - set(easy)
        for at, found in zip(parts, self._plain([" ".join([words[i] for i in at]) for at in parts])):
            found = np.array(found, np.int32)
            stops = np.flatnonzero(self.ends[found]) + 1
            if len(stops) != len(at):  # some word splits in another way: one by one
                odd.update(at)
                continue
            ids.append(found)
            size.append(np.diff(stops, prepend=0))
            order += at
        rest = sorted(odd)
        each = self._plain([words[i] for i in rest])
        ids.append(np.array([t for x in each for t in x], np.int32))
        size.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate(ids), np.concatenate(size), order + rest

    def _cuts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words as word_cuts() gives them; also cut where marks follow a letter a-z, where every piece ends anyway, and
        A-Z lower-cased; neither where a special token may be in the texts."""
        raw, _ = text_bytes(column)
        special = b"<|" in raw.tobytes()
        data, starts, counts = word_cuts(column, NOT_WHITE, lower=not special)
        if special or len(data) < 2:
            return data, starts, counts
        more = _MARK[data]
        more[1:] &= _LETTER[data[:-1]]
        more[0] = False
        more[starts[:-1]] = True
        cuts = np.append(np.flatnonzero(more), len(data))
        heads = np.append(0, np.cumsum(counts))
        return data, cuts, np.diff(np.searchsorted(cuts, starts[heads]))

    def encode(self, column: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with end_id after it, end to end; and the number of each text. Null counts as empty."""
        if not self.by_words:
            each = [x + [end_id] for x in self._plain([t or "" for t in column.to_pylist()])]
            return np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each], np.int64)
        data, starts, counts = self._cuts(column)
        coded = binary_array(data, starts).dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.words) > CACHED_WORDS:
            self._forget()
        kept, older = self.words, self.older
        known = [kept.get(w) for w in words]
        new = [i for i, x in enumerate(known) if x is None]
        for i in new:
            if (x := older.get(words[i])) is not None:
                known[i] = kept[words[i]] = x
        new = [i for i in new if known[i] is None]
        if new:
            ids, size, order = self.encode_words([words[i].decode() for i in new])
            raw, ends = ids.tobytes(), (4 * np.cumsum(size)).tolist()
            for i, low, high in zip(order, [0, *ends[:-1]], ends):
                known[new[i]] = kept[words[new[i]]] = raw[low:high]
        flat = np.frombuffer(b"".join(known), np.int32)
        sizes_of = np.array([len(x) for x in known], np.int64) // 4
        first_of = np.cumsum(sizes_of) - sizes_of
        # One more word stands for the end mark.
        first, size = np.append(first_of, len(flat)), np.append(sizes_of, 1)
        which = np.full(len(starts) - 1 + len(counts), len(first) - 1, np.int64)
        which[np.arange(len(starts) - 1) + np.repeat(np.arange(len(counts)), counts)] = coded.indices.to_numpy(zero_copy_only=False)
        ids = np.append(flat, np.int32(end_id))[ranges(first[which], size[which])]
        heads = np.cumsum(counts + 1) - (counts + 1)
        return ids, np.add.reduceat(size[which], heads) if len(heads) else np.empty(0, np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, with its cache."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def code_lengths(counts: np.ndarray, limit: int | None = None) -> tuple[np.ndarray, int]:
    """Optimal code lengths of at most `limit` bits (package-merge); 0 for an id that doesn't occur. And the limit."""
    used = np.flatnonzero(counts)
    limit = limit or max(16, len(used).bit_length() + 2)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out, limit
    if n > 1 << limit:
        raise ValueError("more ids than codes")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    merged, levels = weight, []
    for _ in range(limit):
        levels.append(None)
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1) if len(levels) > 1 else np.empty(0)
        every = np.concatenate([weight, packages])
        by = np.argsort(every, kind="stable")
        merged, levels[-1] = every[by], by < n
    taken, length = 2 * n - 2, np.zeros(n, np.int64)
    for own in reversed(levels):
        symbols = int(own[:taken].sum())
        length[:symbols] += 1
        taken = 2 * (taken - symbols)
    out[order] = length
    return out, limit


class Code:
    """The canonical code of given lengths: by length, then by id."""

    def __init__(self, lengths: np.ndarray, limit: int):
        self.lengths, self.limit = lengths.astype(np.int64), limit
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        room = np.left_shift(1, limit - self.lengths[order])
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = ((np.cumsum(room) - room) >> (limit - self.lengths[order])).astype(np.uint64)
        #: By the next `limit` bits: the id, and how many bits it takes.
        self.ids, self.bits = np.zeros(1 << limit, np.int32), np.ones(1 << limit, np.int32)
        self.ids[: room.sum()], self.bits[: room.sum()] = np.repeat(order, room), np.repeat(self.lengths[order], room)

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents' code bytes end to end, the bytes of each, checkpoints end to end (bits from the document's start), how many of each."""
        length, code = self.lengths[ids], self.codes[ids]
        before = np.cumsum(length) - length
        heads = np.cumsum(sizes) - sizes
        bits = np.add.reduceat(length, heads)
        size = (bits + 7) // 8
        within = before - np.repeat(before[heads], sizes)
        at = within + np.repeat((np.cumsum(size) - size) * 8, sizes)
        words = np.zeros(int(size.sum()) // 8 + 2, np.uint64)
        word, over = at >> 6, (at & 63) + length - 64  # bits past the word
        part = np.where(over <= 0, code << np.maximum(-over, 0).astype(np.uint64), code >> np.maximum(over, 0).astype(np.uint64))
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        words[word[first]] = np.add.reduceat(part, first)  # no two codes share a bit
        spill = np.flatnonzero(over > 0)
        words[word[spill] + 1] |= code[spill] << (64 - over[spill]).astype(np.uint64)
        marks = -(-sizes // EVERY)
        return words.astype(">u8").view(np.uint8)[: int(size.sum())], size, within[np.repeat(heads, marks) + EVERY * (np.arange(marks.sum()) - np.repeat(np.cumsum(marks) - marks, marks))], marks

    def decode(self, data: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ids of documents of `sizes` tokens, from the bit offsets of all their checkpoints in data."""
        marks = -(-sizes // EVERY)
        nth = np.arange(marks.sum()) - np.repeat(np.cumsum(marks) - marks, marks)
        count = np.minimum(np.repeat(sizes, marks) - EVERY * nth, EVERY)
        to = np.repeat(np.cumsum(sizes) - sizes, marks) + EVERY * nth
        by = np.argsort(-count, kind="stable")  # the lanes that still run are a prefix
        at, to, live = offsets[by], to[by], len(by) - np.searchsorted(count[by][::-1], np.arange(EVERY), "right")
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
        window = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
        out = np.empty(int(sizes.sum()), np.int32)
        shift = np.uint32(32 - self.limit)
        for step in range(EVERY):
            n = live[step]
            if not n:
                break
            now = at[:n]
            key = (window[now >> 3] << (now & 7).astype(np.uint32)) >> shift
            out[to[:n] + step] = self.ids[key]
            at[:n] += self.bits[key]
        return out


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Writes the token file of docs (doc_id, text) at path.

    Rows are in ascending order of doc_id, nulls first; rows of one doc_id in the order of their code. A
    null or empty text has the end id alone. Without documents the file has no blocks.
    """
    spark = docs.sparkSession
    docs = clean_documents(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    wide = encoder(tokenizer).size > 1 << 16 or end_id > 0xFFFF
    kind = np.uint32 if wide else np.uint16

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text", TEXT_BYTES):
            ids, sizes = encoder(tokenizer).encode(part.column(1), end_id)
            cuts = np.append(0, np.cumsum(sizes)) * kind().itemsize
            yield pa.record_batch([part.column(0), binary_array(ids.astype(kind).view(np.uint8), cuts)], names=["doc_id", "ids"])

    def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // kind().itemsize
        start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
        return np.frombuffer(column.buffers()[2], kind, int(sizes.sum()), int(start)).astype(np.int64), sizes

    tokens = stored(packed(docs).mapInArrow(tokenise, "doc_id long, ids binary"), "tokens")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            here = np.bincount(flat(batch.column(1))[0], minlength=len(total))
            here[: len(total)] += total
            total = here
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["id", "n"])

    # At most one row for each id of the vocabulary.
    rows = tokens.select("doc_id", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    lengths, limit = code_lengths(counts)
    header = spark.createDataFrame([(bytearray(squeeze(lengths)), limit, EVERY)], "lengths binary, longest int, every int").coalesce(1)
    header.write.parquet(f"{path}/header")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths, limit)
        for batch in batches:
            begin, sizes_all = 0, pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            while begin < batch.num_rows:
                end = max(begin + 1, begin + int(np.searchsorted(np.cumsum(sizes_all[begin:]), PIECE_BYTES, "right")))
                part = batch.slice(begin, end - begin)
                ids, sizes = flat(part.column(1))
                data, size, marks, n = code.encode(ids, sizes)
                checks = binary_array(marks.astype(np.uint32).view(np.uint8), np.append(0, np.cumsum(n)) * 4)
                yield pa.record_batch([part.column(0), pa.array(sizes), binary_array(data, np.append(0, np.cumsum(size))), checks], names=["doc_id", "n", "code", "marks"])
                begin = end

    coded = tokens.mapInArrow(encode, "doc_id long, n long, code binary, marks binary")
    total = int((counts * lengths).sum()) // 8
    parts = max(1, total // PARTS_BYTES, min(spark.sparkContext.defaultParallelism, total // (1 << 20)))
    tie = F.xxhash64("code")
    # Bounds are drawn from the ids of the stored rows; nothing is tokenised or coded for them.
    key = coded.select("doc_id", tie.alias("tie"), "n", "code", "marks")
    ordered = key.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            sizes_all = batch.column(2).to_numpy(zero_copy_only=False)
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, begin + int(np.searchsorted(np.cumsum(sizes_all[begin:]), BLOCK_TOKENS, "right")))
                some = batch.slice(begin, end - begin)
                sizes = sizes_all[begin:end]
                code, marks = some.column(3).to_pylist(), some.column(4).to_pylist()
                starts = np.cumsum([0, *map(len, code[:-1])])
                checks = np.frombuffer(b"".join(marks), np.uint32).astype(np.int64) + np.repeat(starts * 8, [len(m) // 4 for m in marks])
                ids = some.column(0)
                null = ids.is_null().to_numpy(zero_copy_only=False)
                columns = [
                    pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([int(sizes.sum())], pa.int64()),
                    pa.array([ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()), pa.array([null.tobytes()], pa.binary()), pa.array([squeeze(sizes)], pa.binary()),
                    pa.array([b"".join(code)], pa.binary()), pa.array([squeeze(np.diff(checks, prepend=0))], pa.binary()),
                ]
                yield pa.record_batch(columns, names=["part", "number", "before", "n", "doc_ids", "nulls", "sizes", "code", "checkpoints"])
                number, before, begin = number + 1, before + int(sizes.sum()), end

    blocks = ordered.mapInArrow(block, "part int, number int, before long, n long, doc_ids binary, nulls binary, sizes binary, code binary, checkpoints binary")
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and ids (digest: ids_crc32, of little-endian uint32, instead)."""
    header = spark.read.parquet(f"{path}/header").first()
    lengths, limit = unsqueeze(bytes(header["lengths"])), header["longest"]
    blocks = spark.read.parquet(f"{path}/blocks")
    # Two numbers for each part that the file was written in, of `PARTS_BYTES` of code or more: some 100 MB for 100 TB.
    sizes = blocks.groupBy("part").agg(F.sum("n").alias("n")).toArrow().sort_by("part")
    parts, size = sizes["part"].to_numpy(), sizes["n"].to_numpy()
    held = spark.sparkContext.broadcast((parts, np.cumsum(size) - size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths, limit)
        parts, before = held.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                size = unsqueeze(row["sizes"]).astype(np.int64)
                ids = code.decode(np.frombuffer(row["code"], np.uint8), np.cumsum(unsqueeze(row["checkpoints"]).astype(np.int64)), size)
                ends = np.cumsum(size)
                start = before[np.searchsorted(parts, row["part"])] + row["before"] + ends - size
                if digest:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    last = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - size).tolist(), ends.tolist())], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids))
                doc = pa.array(np.frombuffer(row["doc_ids"], np.int64), mask=np.frombuffer(row["nulls"], bool))
                yield pa.record_batch([doc, pa.array(start), pa.array(size), last], names=["doc_id", "start", "n_tokens", "last"])

    kind, name = ("long", "ids_crc32") if digest else ("array<int>", "ids")
    found = blocks.select("part", "before", "doc_ids", "nulls", "sizes", "code", "checkpoints").mapInArrow(run, f"doc_id long, start long, n_tokens long, last {kind}")
    return found.withColumnRenamed("last", name)


def written_and_read(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The digest of a file in the scratch folder. tokenizer: by default the public vocabulary of the contract."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = scratch_path(docs.sparkSession, "token-file")
    write(docs, path, tokenizer)
    return read(docs.sparkSession, path, digest=True)


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_and_read(table(spark, sf_dir, "documents"))
