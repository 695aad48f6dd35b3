"""Helpers shared by the training-data operators: checkpoints, text flushes, word tables and hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.storage import checkpoint_folder, cut  # noqa: F401  operators take them from here

#: Words are runs of bytes that are none of these (white space of the contracts: \x20 \x09-\x0D).
SPACE = frozenset([0x20, *range(0x09, 0x0E)])
#: About this much text is turned into arrays at a time in a Python worker.
FLUSH_BYTES = 4 << 20


#: A table of keys is broadcast up to so many rows (of 16 bytes or so); larger ones are joined by a shuffle.
FEW_KEYS = 500_000


def few(keys: DataFrame) -> DataFrame:
    """Mark a written table of keys for broadcast if a count shows it to be small, so that texts needn't be dealt out."""
    return F.broadcast(keys) if keys.count() <= FEW_KEYS else keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Whole texts pass to Python in batches of about this size, at most: some documents are very long.
BATCH_BYTES = 4 << 20


def _small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by their bytes; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns that are read, so that extra columns can't clash; null texts become empty."""
    _small_batches(docs.sparkSession)
    # an id that is a long already keeps its column, so that two uses of the result stay the same plan
    ids = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    return docs.select(ids, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def fold(key: str, modulus: int):
    """crc32 of the id's decimal text, by ``modulus``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def buckets(df: DataFrame) -> int:
    """How many coarse groups to deal keys into: two for each 16 MB of a full input split, so groups keep their size."""
    spark = df.sparkSession
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), max(2, round(split / (8 << 20))) * df.rdd.getNumPartitions())


#: So many partial sums are added up at a time.
FAN = 16


def summed(partials: DataFrame, size: int) -> np.ndarray:
    """The sum of the float64 arrays of ``size`` in (deal int, sums binary), one array a task (see ``dealt``).

    Arrays are added up in groups of ``FAN``, level by level, until one is left: that one comes to the driver.
    """

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for x in rows.column("sums"):
            total += np.frombuffer(x.as_buffer(), np.float64)
        return pa.table({"deal": pa.array([rows.column("deal")[0].as_py() // FAN], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    left = partials.rdd.getNumPartitions()
    while left > 0:
        left = -(-left // FAN) if left > 1 else 0
        partials = partials.groupBy("deal").applyInArrow(add, "deal int, sums binary")
    found = partials.collect()  # one row, or none of an empty table
    return sum((np.frombuffer(x, np.float64) for _, x in found), np.zeros(size))


def dealt(total: np.ndarray) -> pa.RecordBatch:
    """One task's array for ``summed``."""
    from pyspark import TaskContext

    deal = TaskContext.get().partitionId() // FAN
    return pa.RecordBatch.from_arrays([pa.array([deal], pa.int32()), pa.array([np.ascontiguousarray(total, np.float64).tobytes()], pa.binary())], names=["deal", "sums"])


class Flush:
    """Some rows: a record batch whose text column is one byte array with offsets."""

    def __init__(self, rows: pa.RecordBatch, column: str = "text"):
        col = rows.column(rows.schema.get_field_index(column))
        if not pa.types.is_large_string(col.type):
            col = col.cast(pa.large_string())
        _, offsets, data = col.buffers()
        at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if offsets is not None else np.zeros(1, np.int64)
        low, high = (int(at[0]), int(at[-1])) if len(at) else (0, 0)
        self.rows, self.n = rows, len(col)
        self.bytes = np.frombuffer(data, np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)
        self.at = at - low

    def longs(self, column: str) -> np.ndarray:
        col = self.rows.column(self.rows.schema.get_field_index(column))
        return col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)

    def nulls(self, column: str) -> np.ndarray:
        return self.rows.column(self.rows.schema.get_field_index(column)).is_null().to_numpy(zero_copy_only=False)


def flushes(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = FLUSH_BYTES) -> Iterator[Flush]:
    """Regroup record batches to about ``most`` bytes of text; one longer text comes alone."""
    held: list[pa.RecordBatch] = []
    size = 0

    def join() -> Flush:
        rows = pa.Table.from_batches(held).combine_chunks()
        return Flush(rows.to_batches()[0] if rows.num_rows else held[0], column)

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most - size, "right")))
            stop = min(stop, batch.num_rows)
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1]) - before
            start = stop
            if size >= most or start < batch.num_rows:
                yield join()
                held, size = [], 0
    if held:
        yield join()
    del held
    give_back()


def give_back() -> None:
    """Return a task's freed memory to the system: a Python worker lives on and serves further tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def byte_table(words: bytes | None = None) -> np.ndarray:
    """Which bytes belong to words: all but white space, or those given."""
    out = np.ones(256, bool) if words is None else np.zeros(256, bool)
    out[list(SPACE) if words is None else list(words)] = words is not None
    return out


PLAIN = byte_table()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(flush: Flush, member: np.ndarray = PLAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row (and one past) its first word's number."""
    inside = member[flush.bytes]
    first = np.zeros(len(inside) + 1, bool)
    first[flush.at] = True
    before = np.empty(len(inside), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(inside), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, flush.at)


MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3 * 0x9E3779B1 | 1
_PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_TABLES: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    size = 1 << max(12, (n - 1).bit_length())
    held = _TABLES.get((base, 0))
    if held is None or len(held[0]) < size:
        held = _TABLES[base, 0] = (_powers(base, size), _powers(pow(base, -1, 2**64), size))
    return held


def ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of each range of ``values``, the same wherever the same values stand.

    Prefix sums of a polynomial with an odd base modulo 2**64; long inputs go in pieces.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = int(np.searchsorted(ends, low + _PIECE, "right"))
        j = max(i + 1, j)
        high = int(ends[j - 1])
        power, inverse = _tables(base, high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((values[low:high].astype(np.uint64) + np.uint64(1)) * power[: high - low], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * MULT)
        i = j
    return out


def grams(hashes: np.ndarray, k: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` consecutive words at each word, and whether all of them are in one row."""
    n = len(hashes)
    ok = np.zeros(n, bool)
    if n < k:
        return np.zeros(n, np.uint64), ok
    out = np.zeros(n, np.uint64)
    acc = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        acc *= np.uint64(0xD6E8FEB86659FD93)
        acc += hashes[j : n - k + 1 + j]
    out[: n - k + 1] = mix(acc)
    last = np.repeat(first[1:], np.diff(first))
    ok = np.arange(n) + k <= last
    return out, ok


def _slide(values: np.ndarray, width: int, reduce) -> np.ndarray:
    """``reduce`` over each run of ``width`` values, by doubling; as many fewer results."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = reduce(out[: len(out) - step], out[step:])
        done += step
    return out


def winnow(hashes: np.ndarray, ok: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the grams that are least in some run of ``width`` grams of one row, ties included.

    Any two equal runs of ``width`` grams therefore choose the same places.
    """
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64)
    value = np.where(ok, hashes | np.uint64(1), np.uint64(0))  # a gram that isn't whole has 0
    least = _slide(value, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    most = _slide(np.concatenate([pad, least, pad]), width, np.maximum)
    return np.flatnonzero(ok & (most == value))


def runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (one past) of the runs of True."""
    edge = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def pieces(names: list[str], arrays: list, schema: pa.Schema, most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``most`` rows from equally long arrays."""
    n = len(arrays[0])
    for i in range(0, n, most):
        yield pa.RecordBatch.from_arrays([pa.array(a[i : i + most], schema.field(k).type) for k, a in zip(names, arrays)], schema=schema)
