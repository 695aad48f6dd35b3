"""Target-distribution importance resampling over hashed n-grams, whose CRCs come from prefix CRCs."""

from __future__ import annotations

import math
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm.common import cut, dealt, flushes, summed, table, texts
from logsift.operators.selection import cutoff
from logsift.sources.tables import with_row_num

#: Bytes that separate words become spaces, A-Z are folded; all others stay.
_SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
NORMAL = bytes(0x20 if b in _SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_POLY = 0xEDB88320


def _step_table() -> np.ndarray:
    """What a byte does to a CRC-32 register: the remainders of all 256 low bytes."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(_POLY), out >> 1)
    return out


STEP = _step_table()


def _after(crc: np.ndarray, byte: int) -> np.ndarray:
    """CRCs with one more byte at the end."""
    register = ~crc
    return ~(STEP[(register ^ np.uint32(byte)) & np.uint32(0xFF)] ^ (register >> np.uint32(8)))


def _shift_tables(levels: int = 31) -> np.ndarray:
    """``[j, i, b]``: what byte ``i`` of a CRC, if it is ``b``, becomes when ``2**j`` zero bytes follow.

    Zero bytes act on the 32 bits as a matrix over GF(2). That of one byte comes from the step table, each
    further one is the square of the one before.
    """
    columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
    image = STEP[columns & np.uint32(0xFF)] ^ (columns >> np.uint32(8))
    byte = np.arange(256)
    out = np.zeros((levels, 4, 256), np.uint32)
    for j in range(levels):
        for i in range(4):
            for bit in range(8):
                out[j, i] ^= np.where(byte >> bit & 1, image[8 * i + bit], np.uint32(0)).astype(np.uint32)
        image = _apply(out[j], image)
    return out


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 0xFF] ^ tables[1][crc >> 8 & 0xFF] ^ tables[2][crc >> 16 & 0xFF] ^ tables[3][crc >> 24]


SHIFT = _shift_tables()


def shift(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs carried over ``size`` zero bytes: one table set for each binary digit of the sizes."""
    out, j = crc.astype(np.uint32), 0
    while (left := size >> j).any():
        hit = np.flatnonzero(left & 1)
        out[hit] = _apply(SHIFT[j], out[hit])
        j += 1
    return out


def gram_crcs(text: bytes, low: int = 1, high: int = 1) -> np.ndarray:
    """CRC-32 of every run of ``low`` to ``high`` words, joined by one space, by length and place.

    One scan stores the running CRC at each word's end; those at word starts follow by one step over the space. The
    CRC of a run is that of the prefix to its end with that of the prefix before it, shifted by the run's bytes,
    cancelled out, so a run of any length costs the same.
    """
    words = text.translate(NORMAL).split()
    if not words:
        return np.zeros(0, np.uint32)
    rest = iter(words)
    end = np.fromiter(accumulate(rest, lambda c, w: zlib.crc32(b" " + w, c), initial=zlib.crc32(next(rest))), np.uint32, len(words))
    start = np.append(np.zeros(1, np.uint32), _after(end[:-1], 0x20))
    to = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    at = np.append(0, to[:-1])
    out = []
    for n in range(low, min(high, len(words)) + 1):
        last = len(words) - n + 1
        out.append(end[n - 1 :] ^ shift(start[:last], to[n - 1 :] - 1 - at[:last]))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _each(batches, low: int, high: int, buckets: int):
    """(flush, buckets of all its features, first feature of each row and one past, words of each row)."""
    for flush in flushes(batches):
        data, at = flush.bytes.tobytes(), flush.at.tolist()
        found = [gram_crcs(data[a:b], low, high) for a, b in zip(at, at[1:])]
        sizes = np.array([len(x) for x in found], np.int64)
        every = np.concatenate(found) % np.uint32(buckets) if found else np.zeros(0, np.uint32)
        yield flush, every.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def bucket_counts(rows: DataFrame, low: int, high: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall in each bucket; one array of counts leaves each task."""

    def count(batches):
        total = np.zeros(buckets)
        for _, every, _ in _each(batches, low, high, buckets):
            total += np.bincount(every, minlength=buckets)
        yield dealt(total)

    return summed(rows.select("text").mapInArrow(count, "deal int, sums binary"), buckets).astype(np.int64)


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, both with one added to each bucket."""
    s, t, n = int(raw.sum()), int(target.sum()), len(raw)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(raw.tolist(), target.tolist())], np.int64)


def resample(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """Draw documents without replacement, the likelier the more their features are those of the target texts.

    Method: each text is normalised and scanned once, with running CRCs at the word boundaries; the CRC of a run of
    ``low`` to ``high`` words is cancelled out of two of them (``gram_crcs``) and names its bucket. Counts of buckets
    over all documents and all target texts give a gain each; a document's weight is the mean gain of its features,
    and Gumbel noise from a hash of its id turns the best ``percent`` in a hundred into a weighted draw. Only counts of
    buckets reach the driver. The cutoff is found by counted ranges; the drawn are ranked by a range sort.

    Returns doc_id, n_features, weight, score, rank (from 1 among the drawn, null otherwise), all long.

    Defined cases: a null or empty text has no features and weight 0; a row without doc_id counts as text, has a null
    score and is never drawn; repeated rows are scored and drawn each; ties go to the smaller doc_id, then to the
    greater weight and number of features; an empty target weighs as one of unseen words; an empty table gives an
    empty result; other columns are ignored.
    """
    source = texts(docs)
    gain = gains(bucket_counts(source, low, high, buckets), bucket_counts(target.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), low, high, buckets))
    told = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches):
        for flush, every, at in _each(batches, low, high, buckets):
            total = np.concatenate([[0], np.cumsum(told.value[every])])
            n = np.diff(at)
            mean = (total[at[1:]] - total[at[:-1]]) // np.maximum(n, 1)
            words = [len(flush.bytes[a:b].tobytes().translate(NORMAL).split()) for a, b in zip(flush.at, flush.at[1:])] if (low, high) != (1, 1) else n
            yield pa.RecordBatch.from_arrays([flush.rows.column(flush.rows.schema.get_field_index("doc_id")), pa.array(n), pa.array(mean), pa.array(words, pa.int64())], names=["doc_id", "n_features", "weight", "n_words"])

    weighed = source.mapInArrow(weigh, "doc_id long, n_features long, weight long, n_words long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = cut(weighed.withColumn("score", (F.col("weight") + noise).cast("long")))
    own = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    order = ["-score", "doc_id", "-weight", "-n_features"]
    can = scored.filter(own)
    k = percent * can.count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not k:
        return scored.select(*columns, none)
    below, level, _ = cutoff(can, order, k)
    drawn = own & (below | level)  # what is level with the last one drawn is the same row again
    ranked = with_row_num(scored.filter(drawn).select(*columns), [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in order])
    rank = F.when(F.col("row_num") <= k, F.col("row_num")).alias("rank")
    return ranked.select(*columns, rank).union(scored.filter(~drawn).select(*columns, none))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: a draw of documents that resemble the benchmark."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
