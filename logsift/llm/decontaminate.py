"""Benchmark decontamination with an FM-index per shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from logsift.llm.common import LOWER, Flush, byte_table, flushes, ranges, runs, table, texts, word_spans
from logsift.llm.fm_index import FMIndex
from logsift.llm.substring_dedup import SPANS

#: Words are runs of digits, letters a-z (after folding A-Z) and non-ASCII bytes.
LETTERS = byte_table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))


def _hashes(flush: Flush):
    flush.bytes = LOWER[flush.bytes]
    starts, ends, first = word_spans(flush, LETTERS)
    return starts, ends, first, ranges(flush.bytes, starts, ends)


class Phrases:
    """The windows of some items as symbols of the items' own vocabulary."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        rows = pa.RecordBatch.from_arrays([pa.array([t for _, t in items], pa.string())], ["text"])
        _, _, first, h = _hashes(Flush(rows))
        self.vocabulary, symbol = np.unique(h, return_inverse=True)
        found: dict[tuple, set[int]] = {}
        for (item, _), a, b in zip(items, first[:-1], first[1:]):
            words = tuple(int(x) + 1 for x in symbol[a:b])
            for i in range(max(0, len(words) - window) + 1 if words else 0):
                found.setdefault(words[i : i + window], set()).add(item)
        self.items = [sorted(x) for x in found.values()]
        self.lengths = np.array([len(k) for k in found], np.int64)
        self.patterns = np.zeros((len(found), window), np.int64)
        for i, k in enumerate(found):
            self.patterns[i, : len(k)] = k

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """1 + the word's place in the vocabulary, 0 for other words."""
        if not len(self.vocabulary):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0)


def blocks(benchmark: DataFrame, window: int, most_bytes: int) -> Iterator[Phrases]:
    """The items in blocks of at most ``most_bytes`` of text (or one item), one block on the driver at a time."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).filter("item_id is not null")
    for item, text in rows.toLocalIterator():
        n = len(text.encode())
        if held and size + n > most_bytes:
            yield Phrases(held, window)
            held, size = [], 0
        held.append((item, text))
        size += n
    if held:
        yield Phrases(held, window)


def _pass(told, schema: pa.Schema):
    """Search one block's windows in each shard of documents and add the hits to the rows'.

    A schema with ``kept`` is the last pass's: hit words are cut out, each with what follows it up to the next word.
    """

    def scan(batches):
        phrases = told.value
        shortest = int(phrases.lengths.min(initial=1 << 40))
        for flush in flushes(batches, most=2 << 20):
            raw = flush.bytes
            starts, ends, first, h = _hashes(flush)
            symbol = phrases.symbols(h)
            # words outside the vocabulary can't be hit: index the stretches between them that a window fits in
            apart = np.zeros(len(h) + 1, bool)
            apart[first] = True
            known = symbol > 0
            begin = np.flatnonzero(known & (apart[:-1] | ~np.append(False, known[:-1])))
            end = np.flatnonzero(known & (apart[1:] | ~np.append(known[1:], False))) + 1
            fit = end - begin >= shortest
            begin, size = begin[fit], (end - begin)[fit]
            hit, pairs = np.zeros(len(h) + 1, np.int64), np.zeros((0, 2), np.int64)
            if len(begin):
                # stretches one after the other, each with a 0 after it
                offset = np.cumsum(size + 1) - (size + 1)
                source = np.repeat(begin - offset, size + 1) + np.arange(int((size + 1).sum()))
                shard = np.where(np.arange(len(source)) == np.repeat(offset + size, size + 1), 0, symbol[np.minimum(source, len(h) - 1)])
                index = FMIndex(shard, len(phrases.vocabulary))
                which, place = index.locate(*index.search(phrases.patterns, phrases.lengths))
                at = source[place]
                np.add.at(hit, at, 1)
                np.add.at(hit, at + phrases.lengths[which], -1)
                row = np.searchsorted(first, at, "right") - 1
                pairs = np.unique(np.stack([row, which], 1), axis=0)
            marked = np.cumsum(hit[:-1]) > 0
            by_row: dict[int, set[int]] = {}
            for row, which in pairs.tolist():
                by_row.setdefault(row, set()).update(phrases.items[which])
            column = lambda c: flush.rows.column(flush.rows.schema.get_field_index(c))
            spans, items = [[] for _ in range(flush.n)], [[] for _ in range(flush.n)]
            was_spans, was_items = column("spans"), column("items")
            for row in sorted(by_row | dict.fromkeys(np.flatnonzero(np.asarray(pc.list_value_length(was_items)) > 0).tolist())):
                a, b = int(first[row]), int(first[row + 1])
                own = marked[a:b].copy()
                for x in was_spans[row].as_py():
                    own[x["start"] : x["end"]] = True
                spans[row] = [{"start": int(x), "end": int(y)} for x, y in zip(*runs(own))]
                items[row] = sorted(by_row.get(row, set()) | set(was_items[row].as_py()))
            n_hit = [sum(x["end"] - x["start"] for x in s) for s in spans]
            new = {"n_words": np.diff(first), "n_hit": n_hit, "spans": spans, "items": items}
            if "kept" in schema.names:
                new["kept"] = pa.array(_cut(raw.tobytes(), flush, starts, first, spans), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([(x if isinstance(x := new[f.name], pa.Array) else pa.array(x, f.type)) if f.name in new else column(f.name) for f in schema], schema=schema)

    return scan


def _cut(raw: bytes, flush: Flush, starts: np.ndarray, first: np.ndarray, spans: list[list[dict]]) -> list[bytes]:
    kept = []
    for r, own in enumerate(spans):
        b, at, high, parts = int(first[r + 1]), int(flush.at[r]), int(flush.at[r + 1]), []
        for x in own:
            parts.append(raw[at : starts[first[r] + x["start"]]])
            at = int(starts[first[r] + x["end"]]) if first[r] + x["end"] < b else high
        kept.append(b"".join([*parts, raw[at:high]]))
    return kept


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 4 << 20, kept: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Find every run of ``window`` benchmark words in the documents and cut it out.

    Method: each shard of documents (some megabytes of text in one task) gets an FM-index over its words; all
    windows of the items are searched backward through wavelet-tree ranks, occurrences are located from sampled
    suffix positions and merged into removal spans. Before indexing, words that no item has are replaced by
    separators: no window can span them, so nothing is lost. The items are handed out in blocks of at most
    ``block_bytes`` of text; each block is one more pass over the documents, whatever the benchmark's size.

    Returns one row a document: doc_id, the columns named in ``carry``, n_words, n_hit, spans (word ranges),
    items (ids of the items with an occurring window, ascending) and, with ``kept``, the text without its hits.

    Defined cases: null and empty texts have no words; an item of fewer words than ``window`` is one window; an
    item without words or id is ignored; repeated items count once; rows without doc_id and repeated rows each
    get their result; an empty benchmark hits nothing; other columns are ignored.
    """
    spark = docs.sparkSession
    now = texts(docs, *carry).withColumns({"n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"), "spans": F.lit(None).cast(SPANS), "items": F.lit(None).cast("array<long>")})
    now = now.withColumns({"spans": F.coalesce("spans", F.array().cast(SPANS)), "items": F.coalesce("items", F.array().cast("array<long>"))})
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in now.schema])
    last = T.StructType([f for f in schema if f.name != "text"])
    last = last.add("kept", "string") if kept else last
    held = None
    for phrases in blocks(benchmark, window, block_bytes):
        if held is not None:
            now = now.mapInArrow(_pass(spark.sparkContext.broadcast(held), to_arrow_schema(schema)), schema)
        held = phrases
    told = spark.sparkContext.broadcast(held if held is not None else Phrases([], window))
    return now.mapInArrow(_pass(told, to_arrow_schema(last)), last)


def query(spark, sf_dir) -> DataFrame:
    """op3: how far each document is contaminated, and by which items."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), kept=False)
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
