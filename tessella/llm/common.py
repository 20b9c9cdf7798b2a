"""Helpers shared by the training-data operators: scratch tables, Arrow text access, word cutting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; where that is unset, a temporary one if all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the scratch folder, which is made."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(at)
    store.deleteOnExit(at)  # as the driver's JVM ends
    return path


#: Python tasks of stored stages get Arrow batches of so many bytes; Spark's own bound is 64 MB, twice that with the buffers' growth, for each task.
ARROW_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df as a Parquet table in the scratch folder and returns the reread table.

    Cuts the lineage: a lost executor costs a reread, never a recomputation of what came before.
    """
    path = f"{scratch_path(df.sparkSession, name)}/table"
    # Without the file that marks success: the path is known only after the commit.
    writer = df.write.option("compression", codec).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    conf = df.sparkSession.conf
    before = conf.get(ARROW_BYTES, None)
    conf.set(ARROW_BYTES, str(BATCH_BYTES))
    try:
        writer.parquet(path)
    finally:
        conf.set(ARROW_BYTES, before) if before else conf.unset(ARROW_BYTES)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of a source, or of a table to be stored, that one task takes at least.
PACK_BYTES = 16 << 20


def in_tasks(df: DataFrame, size: int, each: int = PACK_BYTES) -> DataFrame:
    """df in as many partitions as `size` (bytes, rows) needs at `each` a partition, but as many as there are cores; never in more than it has."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // each)))


def packed(df: DataFrame) -> DataFrame:
    """df with small splits of its sources packed together, so that many small files aren't as many tasks and stored files.

    Goes by the sizes that the optimizer has of the sources; where it has none, nothing changes.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length()))
    return df if size >= 1 << 46 else in_tasks(df, size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and its n + 1 offsets, from 0. A null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    wide = pa.types.is_large_string(column.type)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches by rows so that a piece holds at most `limit` bytes of text; a longer row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            end = max(start + 1, min(end, batch.num_rows))
            yield batch.slice(start, end - start)
            start = end


def byte_class(separators: Iterable[int]) -> np.ndarray:
    """True for the bytes that belong to words."""
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out


#: [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ over A-Z lower-cased bytes.
WHITE = [0x20, *range(0x09, 0x0E)]
NOT_WHITE = byte_class(WHITE)
ALNUM = byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM_RAW = ALNUM[LOWER]  # of bytes before lower-casing


def word_cuts(column: pa.Array, member: np.ndarray, spaced: bool = False, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, by default A-Z lower-cased: their bytes, where each word starts in these (and the end), words per text.

    member: of raw bytes, whether each belongs to words. spaced: keep one space between the words of a text.
    """
    raw, offsets = text_bytes(column)
    inside = member[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    start[heads] = inside[heads]
    at = np.flatnonzero(start)
    counts = np.diff(np.searchsorted(at, offsets))
    data = LOWER[raw] if lower else raw
    if spaced and len(at):
        first = np.zeros(len(at), bool)
        firsts = np.cumsum(counts) - counts
        first[firsts[counts > 0]] = True
        before = at[~first] - 1
        inside[before] = True
        data[before] = 0x20
    starts = np.flatnonzero(start[inside])
    data = data[inside]
    return data, np.append(starts, len(data)), counts


def binary_array(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Arrow binary values data[starts[i]:starts[i + 1]]."""
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(np.ascontiguousarray(starts, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values, by a sort: np.unique hashes whole numbers, which takes many times as long."""
    ordered = np.sort(values)
    return ordered[np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions starts[i] .. starts[i] + lengths[i] - 1, one range after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def clean_documents(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra ones, whatever their names, never travel or clash."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def fresh_name(name: str, taken: Iterable[str]) -> str:
    """name, or name_1, name_2, ...: the first that none of the taken ones equals, letters of either case alike."""
    used, out, n = {x.lower() for x in taken}, name, 0
    while out.lower() in used:
        n += 1
        out = f"{name}_{n}"
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, tasks: int) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled documents, in at most `tasks` partitions.

    labels (doc_id, label) first meet the documents: null ids, labels and texts, and labels without a document, are
    not taken; rows that agree in doc_id, text and label count once. Of what is left the first `rows` by a hash of
    doc_id are taken, so the sample doesn't depend on how the tables lie in files. They are chosen by a few numbers a
    row; the keys of the chosen ones, at most `rows`, may be broadcast to fetch the texts.
    """
    known = labels.select(F.col("doc_id").alias("label_id"), "label").where("label_id is not null and label is not null")
    texts = clean_documents(docs, "doc_id", "text").where("doc_id is not null and text is not null").withColumn("digest", F.xxhash64("text"))
    met = texts.select("doc_id", "digest").hint("merge").join(known, F.col("doc_id") == F.col("label_id")).select("doc_id", "digest", "label").distinct()  # one plan at all sizes
    chosen = met.orderBy(F.xxhash64("doc_id"), "doc_id", "digest", "label").limit(rows).collect()
    keys = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], "key_id long, key long, label int")
    fetched = texts.join(F.broadcast(keys), (F.col("doc_id") == F.col("key_id")) & (F.col("digest") == F.col("key")))
    return fetched.dropDuplicates(["doc_id", "digest", "label"]).select("doc_id", "text", "label").coalesce(tasks)
