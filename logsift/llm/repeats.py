"""Repeated passages across documents: seeds, exchange of keys, extension to whole windows.

Shared by substring dedup (winnowed anchors met by hash) and suffix-array dedup (sparse suffixes met by
order). Both look for *windows*, runs of ``min_words`` words that stand in two documents or more:

1. every document gives its content-selected seeds. Any two equal windows choose the same seed inside
   them, so a window can only repeat where a seed repeats;
2. a few seeds also cut the document into long blocks. A block that stands whole in a smaller document is
   settled at once with all its windows, so copies cost a handful of rows each;
3. seeds that repeat are extended left and right, to every window round them that isn't settled, and those
   windows meet by hash once more.

Keys meet in coarse groups whose number follows the input's splits. Before the exchange each flush of a
task keeps one owner of every key, the least document; the other documents of the flush are settled on the
spot. A key that all documents have therefore costs one entry a flush, never one a document, and no pairs
are formed. Hashes have 64 bits: two different windows are taken for equal with a chance of about
n**2 / 2**65 among n windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import buckets, cut, few, flushes, grams, ranges, winnow, word_spans

BLOCK, SEED, WINDOW, DONE = 0, 1, 2, 3
LATER, SHARED, SEEDED = 0, 1, 2
_KEYS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("key", pa.binary()), ("doc", pa.binary()), ("low", pa.binary()), ("high", pa.binary()), ("flag", pa.binary())])
_KEYS_DDL = "bucket int, kind int, key binary, doc binary, low binary, high binary, flag binary"
_MARKS = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64())])


@dataclass(frozen=True)
class Shape:
    """``min_words``: a window's words; ``gram``: a seed's words; one seed in ``sparse`` cuts blocks."""

    min_words: int
    gram: int
    sparse: int = 16

    def __post_init__(self):
        if not 1 <= self.gram <= self.min_words:
            raise ValueError("a seed has at least one word and no more than a window")

    @property
    def width(self) -> int:
        return self.min_words - self.gram + 1


def packed(state, low, high):
    """State (2 bits) and a half-open range of words (30 and 31 bits) as one long."""
    return (np.asarray(state, np.int64) << 61) | (np.asarray(low, np.int64) << 31) | np.asarray(high, np.int64)


def unpacked(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return mark >> 61, (mark >> 31) & ((1 << 30) - 1), mark & ((1 << 31) - 1)


def _owners(key, doc, low, high):
    """Order by key and document; which entries belong to the least document, and which keys have several."""
    order = np.lexsort((low, doc, key))
    key, doc, low, high = key[order], doc[order], low[order], high[order]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    group = np.cumsum(head) - 1
    at = np.flatnonzero(head)
    least = doc[at][group]
    end = np.append(at[1:], len(key)) - 1
    several = (doc[end] != doc[at])[group] if len(key) else head
    return key, doc, low, high, doc == least, several


def _send(kind: int, n: int, key, doc, low, high):
    """Rows for the exchange: one owner a key, and what is settled here already."""
    key, doc, low, high, own, several = _owners(key, doc, low, high)
    to = ((key >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    k = np.flatnonzero(own)
    edge = np.flatnonzero(np.diff(to[k], prepend=-1)) if len(k) else k
    for i, j in zip(edge, np.append(edge[1:], len(k))):
        x = k[i:j]
        yield int(to[x[0]]), kind, key[x], doc[x], low[x], high[x] if kind == BLOCK else high[:0], several[x]
    if len(x := np.flatnonzero(~own)):
        state = {BLOCK: LATER, SEED: SEEDED, WINDOW: LATER}[kind]
        yield _done(n, doc[x], packed(np.full(len(x), state), low[x], high[x]))


def _done(n: int, doc, mark):
    empty = np.zeros(0, np.int32)
    return int(doc[0] % n), DONE, mark.astype(np.int64).view(np.uint64), doc, empty, empty, empty.astype(bool)


def _rows(sent) -> pa.RecordBatch | None:
    if not sent:
        return None
    bucket, kind, key, doc, low, high, flag = zip(*sent)
    as_bytes = lambda xs, t: pa.array([np.ascontiguousarray(x, t).tobytes() for x in xs], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), as_bytes(key, np.uint64), as_bytes(doc, np.int64), as_bytes(low, np.int32), as_bytes(high, np.int32), as_bytes(flag, np.uint8)], schema=_KEYS)


def _words(flush):
    starts, ends, first = word_spans(flush)
    return ranges(flush.bytes, starts, ends), first


def _seeds(shape: Shape, n: int):
    def scan(batches):
        for flush in flushes(batches):
            ids = flush.longs("doc_id")
            h, first = _words(flush)
            key, ok = grams(h, shape.gram, first)
            at = winnow(key, ok, shape.width)
            row = np.searchsorted(first, at, "right") - 1
            pos = at - first[row]
            sent = list(_send(SEED, n, key[at], ids[row], pos, pos))
            # blocks: from the document's start and each sparse seed to the next, with the words of the last window
            count = np.diff(first)
            whole = np.flatnonzero(count >= shape.min_words)
            some = (key[at] % np.uint64(shape.sparse) == 0) & (pos > 0) & (pos <= count[row] - shape.min_words)
            begin = np.concatenate([first[whole], at[some]])
            order = np.argsort(begin, kind="stable")
            begin, brow = begin[order], np.concatenate([whole, row[some]])[order]
            if len(begin):
                last = first[brow] + count[brow] - shape.min_words + 1
                follow = np.append(begin[1:], begin[-1])
                same = np.append(brow[1:] == brow[:-1], False)
                stop = np.where(same, follow, last)
                block = ranges(h, begin, stop + shape.min_words - 1)
                sent += _send(BLOCK, n, block, ids[brow], begin - first[brow], stop - first[brow])
            if (out := _rows(sent)) is not None:
                yield out

    return scan


def _joined(rows: pa.Table, kind: int):
    rows = rows.filter(pc.equal(rows.column("kind"), kind))
    get = lambda c, t: np.frombuffer(b"".join(rows.column(c).to_pylist()), t)
    return get("key", np.uint64), get("doc", np.int64), get("low", np.int32), get("high", np.int32), get("flag", np.uint8).astype(bool)


def _met(first_too: bool):
    """Settle the keys of a group: a document is later, or first of several, or has a repeated seed."""

    def reduce(rows: pa.Table) -> pa.Table:
        docs, marks = [], []
        for kind in (BLOCK, SEED, WINDOW):
            key, doc, low, high, flag = _joined(rows, kind)
            if not len(key):
                continue
            if kind != BLOCK:
                high = low + 1
            order = np.lexsort((doc, key))
            key, doc, low, high, flag = key[order], doc[order], low[order], high[order], flag[order]
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(at, len(key)))
            several = np.repeat((doc[at] != doc[at + size - 1]) | np.logical_or.reduceat(flag, at), size)
            later = doc != np.repeat(doc[at], size)
            if kind == SEED:
                told, state = several, np.full(len(key), SEEDED)
            else:
                told, state = (several if first_too else later), np.where(later, LATER, SHARED)
            docs.append(doc[told])
            marks.append(packed(state, low, high)[told])
        key, doc, *_ = _joined(rows, DONE)
        docs.append(doc)
        marks.append(key.view(np.int64))
        return pa.Table.from_arrays([pa.array(np.concatenate(docs)), pa.array(np.concatenate(marks))], schema=_MARKS)

    return reduce


def _marked(keys: DataFrame, first_too: bool) -> DataFrame:
    """(doc_id, marks): all that is known of a document; no longer than the document."""
    told = keys.groupBy("bucket").applyInArrow(_met(first_too), "doc_id long, mark long")
    return told.groupBy("doc_id").agg(F.collect_list("mark").alias("marks"))


def cover(flush_rows, ids_first: np.ndarray, marks: pa.ListArray, state: int, before: int = 0, after: int = 0) -> np.ndarray:
    """Which words of a flush lie in marked ranges of a state, widened by ``before`` and ``after`` words."""
    n = int(ids_first[-1])
    values = np.asarray(marks.flatten().to_numpy(zero_copy_only=False), np.int64)
    lengths = np.asarray(pc.list_value_length(marks).fill_null(0), np.int64)
    row = np.repeat(np.arange(flush_rows), lengths)
    kind, low, high = unpacked(values)
    k = kind == state
    row, low, high = row[k], low[k] - before, high[k] + after
    size = np.diff(ids_first)[row]
    low, high = np.clip(low, 0, size), np.clip(high, 0, size)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, ids_first[row] + low, 1)
    np.add.at(step, ids_first[row] + high, -1)
    return np.cumsum(step[:-1]) > 0


def _windows(shape: Shape, n: int):
    def scan(batches):
        for flush in flushes(batches):
            ids = flush.longs("doc_id")
            marks = flush.rows.column(flush.rows.schema.get_field_index("marks"))
            h, first = _words(flush)
            key, ok = grams(h, shape.min_words, first)
            near = cover(flush.n, first, marks, SEEDED, before=shape.width - 1, after=1)
            at = np.flatnonzero(near & ok & ~cover(flush.n, first, marks, LATER))
            row = np.searchsorted(first, at, "right") - 1
            pos = at - first[row]
            sent = list(_send(WINDOW, n, key[at], ids[row], pos, pos + 1))
            values = np.asarray(marks.flatten().to_numpy(zero_copy_only=False), np.int64)
            lengths = np.asarray(pc.list_value_length(marks).fill_null(0), np.int64)
            keep = values >> 61 != SEEDED
            if keep.any():
                sent.append(_done(n, np.repeat(ids, lengths)[keep], values[keep]))
            if (out := _rows(sent)) is not None:
                yield out

    return scan


def one_text(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, others) of ``docs`` with doc_id: where texts of one doc_id differ, those of the least hash, and the rest.

    Marks go to documents by their id, so only one text of an id can take part.
    """
    several = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("h"), F.max(F.xxhash64("text")).alias("most")).filter("h <> most")
    several = cut(several.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")))
    if several.isEmpty():
        return docs, docs.limit(0)
    told = docs.join(few(several), F.col("doc_id") == F.col("_id"), "left")
    mine = F.col("_h").isNull() | (F.col("_h") == F.xxhash64("text"))
    return told.filter(mine).drop("_id", "_h"), told.filter(~mine).drop("_id", "_h")


def repeated(docs: DataFrame, shape: Shape, first_too: bool) -> DataFrame:
    """(doc_id, marks) of the documents with repeated windows; ``docs`` has doc_id, never null, and text.

    A mark packs a state and a half-open range of window starts: ``LATER`` where a smaller doc_id has the
    window too, ``SHARED`` (only with ``first_too``) where only larger ones have it. Rows that
    repeat a doc_id are one document and have one text (see ``one_text``).
    """
    n = buckets(docs)
    seeds = _marked(docs.select("doc_id", "text").mapInArrow(_seeds(shape, n), _KEYS_DDL), first_too)
    near = docs.join(seeds, "doc_id")  # with all columns, as the caller joins marks to the same rows: they are dealt out once
    return _marked(near.mapInArrow(_windows(shape, n), _KEYS_DDL), first_too)
