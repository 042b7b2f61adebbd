"""Helpers that the training-data operators share."""

from __future__ import annotations

import hashlib
import pickle
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a task looks at together; a longer document is alone.
CHUNK_BYTES = (1 << 20) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and written to the folder in spark.checkpoint.dir.

    The lineage ends there, so a lost executor costs only the tasks after it.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A session without one gets a temporary folder in local mode alone; on a cluster
    other machines would not see it, so there it is an error. What is written there is the cluster's to clear, like checkpoints."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


class Shared:
    """A value for all executors, by broadcast. It travels pickled by value, so that they need no copy of this package."""

    def __init__(self, spark: SparkSession, value):
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def __getstate__(self):
        return self._bytes

    def __setstate__(self, state):
        self._bytes = state

    @property
    def value(self):
        if "_value" not in self.__dict__:
            self._value = pickle.loads(self._bytes.value)
        return self._value


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of 1000 rows at most from now on: rows that hold whole documents make long batches of the usual 10000."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= 1000:
        spark.conf.set(key, "1000")


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the folder in spark.checkpoint.dir and read again: like durable, but compressed and columnar.

    What was shuffled for it is of no more use then, so Spark is told to remove those files.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/{uuid.uuid4().hex}"
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean)
    spark.conf.set(clean, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(clean, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with name, each row's place in the order from 0; no task sees all rows. df has no columns _part and _offset."""
    parts = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order, F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    parts = durable(parts)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offset = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.join(offset, "_part").withColumn(name, rank.cast("long") + F.col("_offset")).drop("_part", "_offset")


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """The values of key that more than a quarter of an even partition's rows have; at most four times as many as partitions."""
    counts = df.groupBy(key).agg(F.count("*").alias("_count")).where(F.col(key).isNotNull())
    total = df.agg(F.count("*").alias("_total"))
    return durable(counts.join(F.broadcast(total), F.col("_count") > F.col("_total") / (4 * shuffle_partitions(df.sparkSession))).select(key))


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """left joined (inner or left) with right, in which key is unique; a key with a large share of left's rows is no one task's work.

    The rows of right for the hot keys alone, whose number is bounded, are broadcast; the other keys meet in an ordinary
    join. left should be stored: it is read thrice.
    """
    hot = F.broadcast(hot_keys(left, key) if hot is None else hot)
    cold = left.join(hot, key, "left_anti").join(right, key, how)
    few = F.broadcast(right.join(hot, key, "left_semi"))
    return cold.unionByName(left.join(hot, key, "left_semi").join(few, key, how))


def crc_mod(column: str, n: int):
    """crc32 of the column as text, modulo n; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and its len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = int(offsets[0]) if len(offsets) else 0
    return data[lo : int(offsets[-1])] if len(offsets) else data[:0], offsets - lo


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES):
    """Slices of the batch, of about limit bytes of text or of one document; yields (slice, bytes, offsets)."""
    data, offsets = text_bytes(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    pa.default_memory_pool().release_unused()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def digests(data: np.ndarray, lo, hi) -> tuple[np.ndarray, np.ndarray]:
    """BLAKE2b of each data[lo:hi], 128 bits, as two columns."""
    view, make = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    raw = b"".join([make(view[a:b], digest_size=16).digest() for a, b in zip(lo.tolist(), hi.tolist())])
    both = np.frombuffer(raw, np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


#: Bytes of which words are looked for together, and the longest word that is hashed eight bytes at a time.
SLICE, LONG_WORD = 1 << 20, 64


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words data[start:end], none of them empty.

    A word is taken in eight bytes at a time, each mixed by a bijection, so words of up to eight bytes and equal length
    never share a hash; a very long word's is a BLAKE2b digest.
    """
    size = end - start
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))  # the eight bytes from each place
    h = mix64(size.astype(np.uint64))
    for k in range(0, min(LONG_WORD, int(size.max(initial=0))), 8):
        at = np.flatnonzero(size > k) if k else slice(None)
        left = (8 * np.minimum(size[at] - k, 8)).astype(np.uint64)
        own = eight[start[at] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left))
        h[at] = mix64(h[at] ^ own)
    long = np.flatnonzero(size > LONG_WORD)
    if len(long):
        h[long] = digests(data, start[long], end[long])[0]
    return h


def words_of(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text's number) of each word in the texts of data: a longest run of bytes that letters marks, after fold.

    Slices of a long text are looked at one after another, so that only the result grows with it.
    """
    n, at, out = len(data), 0, [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    while at < n:
        to = min(n, at + SLICE)
        if to < n:  # end the slice where no word goes on
            gap = np.flatnonzero(~letters[fold[data[at:to]]])
            to = at + int(gap[-1]) + 1 if len(gap) else to
            while not len(gap) and to < n:
                more = ~letters[fold[data[to : to + SLICE]]]
                gap = np.flatnonzero(more)
                to = to + int(gap[0]) if len(gap) else min(n, to + SLICE)
        part = fold[data[at:to]]
        inside = letters[part]
        inner = offsets[np.searchsorted(offsets, at, side="right") : np.searchsorted(offsets, to, side="left")] - at
        head, tail = inside.copy(), inside.copy()
        head[1:] &= ~inside[:-1]
        tail[:-1] &= ~inside[1:]
        head[inner] = inside[inner]
        tail[inner - 1] = inside[inner - 1]
        start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        out.append((word_hashes(part, start, end), np.searchsorted(offsets, start + at, side="right") - 1))
        at = to
    return np.concatenate([h for h, _ in out]), np.concatenate([d for _, d in out])
