"""Global counts of many keys without a table join: chunks ask, shards answer.

A chunk is some megabytes of the input, held as one row of a stored table. It sends each shard one
message with its distinct keys of that shard (so a key of a third of all rows costs one entry a chunk),
sorted and delta-coded. A shard adds up what all chunks say about its keys and replies to each chunk in
the order of its question. Keys are uint64 hashes; a key's shard follows from its top bits. Messages are
rows that Spark shuffles, so a lost executor costs their recomputation from the stored chunks alone.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARD_KEYS = 1 << 20


def squeeze(array: np.ndarray) -> bytes:
    """Integers, none negative, by byte planes: a leading count of planes, then the planes, compressed."""
    array = np.ascontiguousarray(array, np.uint64)
    width = max(1, (int(array.max(initial=0)).bit_length() + 7) // 8)
    planes = array.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(body: bytes) -> np.ndarray:
    width = body[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).ravel()


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unsqueeze_sorted(body: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(body), dtype=np.uint64)


def joined(*parts: bytes) -> bytes:
    """Byte strings as one, each after its length."""
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def parted(body: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(body):
        n = int.from_bytes(body[at : at + 8], "little")
        out.append(body[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def shard_cuts(keys: np.ndarray, shards: int, bits: int = 64) -> np.ndarray:
    """Where each shard's keys begin among sorted keys of so many bits, and their number at the end."""
    edges = np.array([(s << bits) // shards for s in range(1, shards)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def key_bits(entries: int, spare: int = 24) -> int:
    """Bits of hash that so many keys need, so that one in 2**spare of them meets another one's hash; at most 64."""
    return min(64, int(entries).bit_length() + spare)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A uint64 hash of two."""
    x = (a ^ np.uint64(0x2545F4914F6CDD1D)) * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ask(chunks: DataFrame, question: Callable[..., tuple[np.ndarray, list[np.ndarray]]], shards: int, bits: int = 64) -> DataFrame:
    """Messages (shard, chunk, body). question(row as dict): sorted distinct keys of so many bits, and columns of integers beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                keys, columns = question(row)
                cuts = shard_cuts(keys, shards, bits)
                asked = [(s, a, b) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]
                bodies = [joined(squeeze_sorted(keys[a:b]), *(squeeze(c[a:b]) for c in columns)) for _, a, b in asked]
                yield pa.record_batch([pa.array([s for s, _, _ in asked], pa.int32()), pa.array([row["chunk"]] * len(asked), pa.int64()), pa.array(bodies, pa.binary())], names=["shard", "chunk", "body"])

    return chunks.mapInArrow(run, "shard int, chunk long, body binary")


def answer(messages: DataFrame, reply: Callable[[np.ndarray, list[np.ndarray], np.ndarray], tuple[list[np.ndarray], dict[str, int]]]) -> DataFrame:
    """(chunk, shard, body, stats). reply gets all keys of a shard's messages end to end (each message's ascending) and their
    columns; it returns columns to send back, in the same order, and figures about the shard, which come with chunk null."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk", kind="stable")
        parts = [parted(b) for b in frame.pop("body")]
        keys = [unsqueeze_sorted(p[0]) for p in parts]
        columns = [np.concatenate([unsqueeze(p[c]) for p in parts]) for c in range(1, len(parts[0]))]
        del parts
        sizes = np.array([len(k) for k in keys])
        keys = np.concatenate(keys)
        back, stats = reply(keys, columns, np.cumsum(sizes) - sizes)
        ends = np.cumsum(sizes)
        bodies = [joined(*(squeeze(c[a:b]) for c in back)) for a, b in zip(ends - sizes, ends)]
        shard = int(frame["shard"].iloc[0])
        out = pd.DataFrame({"chunk": frame["chunk"].astype("Int64").tolist() + [None], "shard": shard, "body": [*bodies, None], "stats": [None] * len(bodies) + [list(stats.values())]})
        out["chunk"] = out["chunk"].astype("Int64")
        return out

    return messages.groupBy("shard").applyInPandas(run, "chunk long, shard int, body binary, stats array<long>")


def free_messages(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to; its cleaner waits for the driver's JVM to collect garbage.

    What a listener still holds of the last job is free only a moment later, so the garbage is collected again.
    """
    for _ in range(3):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.25)


def with_answers(chunks: DataFrame, *answers: DataFrame) -> DataFrame:
    """The chunks, each with its answers in order of shard: arrays reply0, reply1 and so on (null: it asked nothing)."""
    for i, a in enumerate(answers):
        per_chunk = a.where("chunk is not null").groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "body"))), lambda x: x["body"]).alias(f"reply{i}"))
        chunks = chunks.hint("merge").join(per_chunk, "chunk", "left")  # one plan at all sizes: replies grow with the chunks
    return chunks


def answered(bodies: list[bytes] | None, column: int = 0) -> np.ndarray:
    """One column of a chunk's answers, in the order of its keys."""
    found = [unsqueeze(parted(b)[column]) for b in bodies or []]
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def shard_number(keys: int, each: int = SHARD_KEYS) -> int:
    return max(1, -(-keys // each))


def group_sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sum of the values of each, and of every entry its key's number."""
    order = np.argsort(keys)
    ordered = keys[order]
    fresh = np.append(True, ordered[1:] != ordered[:-1])[: len(keys)]
    starts = np.flatnonzero(fresh)
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return ordered[starts], np.add.reduceat(values[order], starts) if len(starts) else values[:0], number
