"""What the text operators share: tables, shared storage, hashing and segment exchange."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that a worker takes at once where it counts before it passes on.
GROUP_BYTES = 4 << 20
#: Rows and bytes of one Arrow batch; long texts make larger batches a memory risk.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch in rows and bytes, so that long texts fit a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) != ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


@cache
def _own_folder() -> str:
    """One folder of this machine for a process without a shared one; a running session's setting can't be changed."""
    return "file://" + tempfile.mkdtemp(prefix="wiretide-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, in a single process only, a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext._jsc.isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _own_folder()
    return found.rstrip("/")


_WRITTEN: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def discard_all(spark: SparkSession) -> None:
    """Remove all tables that materialize() wrote in this process: once the results that read them are written elsewhere."""
    while _WRITTEN:
        target = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Remove a table that materialize() wrote and that nothing reads any more."""
    path = getattr(df, "shared_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps: Spark removes them when the driver's garbage is collected."""
    gc.collect()
    for _ in range(2):  # plans that Python let go of are garbage after the first
        time.sleep(0.3)
        spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col: Column) -> Column:
    """A-Z in lower case, all other characters unchanged."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of distinct words, alike on every machine."""
    if not words:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


class Interner(dict):
    """Word to dense index in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def intern_words(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(index of every word, start of every document with the end last, distinct words)."""
    seen = Interner()
    get = seen.__getitem__
    starts = np.zeros(len(docs) + 1, np.int64)
    np.cumsum([len(d) for d in docs], out=starts[1:])
    ids = np.empty(starts[-1], np.uint32)
    for k, words in enumerate(docs):
        if words:
            ids[starts[k] : starts[k + 1]] = np.fromiter(map(get, words), np.uint32, len(words))
    return ids, starts, list(seen)


def ngram_hashes(words: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the n-grams that lie inside one document; words: a hash of each word."""
    total = len(words)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = mix64(words[: total - n + 1] + np.uint64(n))
        for k in range(1, n):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[k : total - n + 1 + k])
    lengths = np.diff(starts)
    left = np.repeat(starts[1:], lengths)[: total - n + 1] - np.arange(total - n + 1)
    at = np.flatnonzero(left >= n)
    return h[at], at


def grouped_batches(batches: Iterator[pa.RecordBatch], column: str, budget: int = GROUP_BYTES) -> Iterator[pa.Table]:
    """Arrow batches joined until their text reaches the budget, so that local counting pays."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(column)).nbytes
        if size >= budget:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def trim() -> None:
    """Give free memory back to the system: workers are reused, and what one task leaves adds up."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def tidy(run):
    """A function for mapInArrow that gives memory back when its partition is done."""

    def whole(batches):
        yield from run(batches)
        trim()

    return whole


def cut_segments(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bounds of the 2**bits segments (by leading bits) in sorted 64-bit keys."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def bloom_positions(low: np.ndarray, bits: int, probes: int) -> list[np.ndarray]:
    """Bit positions of each probe in a segment of `bits` bits (a power of two)."""
    with np.errstate(over="ignore"):
        a = mix64(low.astype(np.uint64) + np.uint64(0x51ED270B))
        step = (a >> np.uint64(32)) | np.uint64(1)
        return [((a + np.uint64(k) * step) & np.uint64(bits - 1)).astype(np.int64) for k in range(probes)]


def set_bits(array: np.ndarray, at: np.ndarray) -> None:
    """Set bits in an array of bytes."""
    np.bitwise_or.at(array, at >> 3, np.left_shift(1, at & 7).astype(np.uint8)) if len(at) < 1024 else _set_many(array, at)


def _set_many(array: np.ndarray, at: np.ndarray) -> None:
    flags = np.zeros(len(array) * 8, np.bool_)
    flags[at] = True
    array |= np.packbits(flags, bitorder="little")


def has_bits(array: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (array[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0


class SegmentFilter:
    """A Bloom filter of fixed size, in segments that were built apart from each other.

    A key's leading bits name its segment, the 32 bits after them are what is stored.
    """

    def __init__(self, rows: list, segment_bits: int, filter_bits: int, probes: int = 4):
        self.segment_bits, self.probes = segment_bits, probes
        self.each = filter_bits >> segment_bits
        self.array = np.zeros(filter_bits // 8, np.uint8)
        for segment, data in rows:
            at = segment * self.each // 8
            self.array[at : at + self.each // 8] = np.frombuffer(data, np.uint8)

    @staticmethod
    def build(low: np.ndarray, each: int, probes: int = 4) -> bytes:
        """The bits of one segment with the given stored keys."""
        array = np.zeros(each // 8, np.uint8)
        for at in bloom_positions(low, each, probes):
            set_bits(array, at)
        return array.tobytes()

    def has(self, keys: np.ndarray) -> np.ndarray:
        segment = (keys >> np.uint64(64 - self.segment_bits)).astype(np.int64)
        low = (keys >> np.uint64(32 - self.segment_bits)) & np.uint64(0xFFFFFFFF)
        found = np.ones(len(keys), np.bool_)
        for at in bloom_positions(low, self.each, self.probes):
            found &= has_bits(self.array, segment * self.each + at)
        return found


def low_bits(keys: np.ndarray, segment_bits: int) -> np.ndarray:
    """What a segment stores of its keys."""
    return ((keys >> np.uint64(32 - segment_bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def per_segment(rows: DataFrame, solve, schema: str) -> DataFrame:
    """solve(segment, lists of the other columns' values) for each segment of rows, one segment at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for s, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if s != now and held:
                    yield solve(now, list(zip(*held)))
                    held = []
                now = s
                held.append(rest)
        if held:
            yield solve(now, list(zip(*held)))

    return rows.repartition(partitions(rows.sparkSession), "segment").sortWithinPartitions("segment").mapInArrow(tidy(run), schema)


def input_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of the size of a table; where it has none, the counted bytes of its texts."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 60:
        return size
    wide = [F.octet_length(c) for c, kind in df.dtypes if kind in ("string", "binary")]
    return df.agg(F.sum(sum((F.coalesce(c, F.lit(0)) for c in wide), F.lit(8)))).first()[0] or 0


def segment_bits(df: DataFrame, least: int = 8, most: int = 16, each: int = 64 << 20) -> int:
    """Leading hash bits that name a segment, so that a segment stands for a bounded part of the input; results don't depend on them."""
    return max(least, min(most, (input_bytes(df) // each).bit_length()))
