"""SimHash near-dedup with covering locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm.common import LOWER, buckets, cut, flushes, mix, table, texts, word_spans
from logsift.llm.components import components

SEED = 42


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """``2**(radius+1) - 1`` masks such that any ``radius`` bit places are all left out by one of them.

    Each place gets a nonzero vector of ``radius + 1`` bits; mask v keeps the places whose vector has an odd
    product with v. Vectors of ``radius`` places can't span the space, so some nonzero v is orthogonal to all of
    them. Each mask keeps about half of the places.
    """
    size = (1 << (radius + 1)) - 1
    vectors = [1 + i % size for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, size + 1)]


def _votes(h: np.ndarray) -> int:
    """The fingerprint of shingle hashes: bits that over half of them have."""
    n = len(h)
    if not n:
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, n, 255):  # bytes of a word count up to 255 without a carry
        bits = np.unpackbits(h[i : i + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
        total += bits.sum(axis=0, dtype=np.uint64).view(np.uint8)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int, *carry: str) -> DataFrame:
    """(carry..., fingerprint): one signed 64-bit fingerprint a row."""
    source = texts(docs, *carry)
    names = ["doc_id", *carry]

    def scan(batches):
        digest = xxhash.xxh64_intdigest
        for flush in flushes(batches, most=2 << 20):
            starts, ends, first = word_spans(flush)
            n_words = len(starts)
            # all words of the flush with one space after each: shingles are slices
            size = ends - starts
            begin = np.cumsum(size + 1) - (size + 1)
            data = np.full(int((size + 1).sum()), 0x20, np.uint8)
            place = np.arange(len(data)) - np.repeat(begin, size + 1)
            word = place < np.repeat(size, size + 1)
            data[word] = LOWER[flush.bytes][np.repeat(starts, size + 1)[word] + place[word]]
            text = data.tobytes()
            low = begin.tolist()
            high = (begin + size).tolist()
            out = np.zeros(flush.n, np.uint64)
            for r in range(flush.n):
                a, b = int(first[r]), int(first[r + 1])
                if b - a > shingle:
                    h = [digest(text[i:j], SEED) for i, j in zip(low[a : b - shingle + 1], high[a + shingle - 1 : b])]
                elif b > a:
                    h = [digest(text[low[a] : high[b - 1]], SEED)]
                else:
                    continue
                out[r] = _votes(np.array(h, np.uint64))
            assert n_words == first[-1]
            columns = [flush.rows.column(flush.rows.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out.view(np.int64))], names=[*names, "fingerprint"])

    kinds = dict(source.dtypes)
    return source.mapInArrow(scan, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", fingerprint long")


def _tables(radius: int, n: int):
    masks = np.array(covering_masks(radius), np.uint64)
    names = np.arange(1, len(masks) + 1, dtype=np.uint64)

    def scan(batches):
        for batch in batches:
            f = batch.column(0).to_numpy().view(np.uint64)
            for name, mask in zip(names, masks):
                key = mix((f & mask) ^ mix(np.array([name], np.uint64)))
                to = ((key >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(key.view(np.int64)), batch.column(0)], names=["bucket", "key", "fingerprint"])

    return scan


def _near(radius: int):
    """Links of a group of table entries: all entries of one key are compared, a forest of the links leaves."""

    def reduce(rows: pa.Table) -> pa.Table:
        key, f = (rows.column(c).to_numpy().view(np.uint64) for c in ("key", "fingerprint"))
        order = np.lexsort((f, key))
        key, f = key[order], f[order]
        root = np.arange(len(f))
        live, step = np.arange(len(f)), 0
        while len(live):
            step += 1
            live = live[live + step < len(f)]
            live = live[key[live] == key[live + step]]
            hit = live[np.bitwise_count(f[live] ^ f[live + step]) <= radius]
            a, b = hit, hit + step
            while True:  # join the classes of all pairs that this step has found
                while ((r := root[root]) != root).any():
                    root = r
                x, y = root[a], root[b]
                k = x != y
                if not k.any():
                    break
                np.minimum.at(root, np.maximum(x, y)[k], np.minimum(x, y)[k])
        k = np.flatnonzero(root != np.arange(len(f)))
        return pa.Table.from_arrays([pa.array(f[k].view(np.int64)), pa.array(f[root[k]].view(np.int64))], names=["a", "b"])

    return reduce


def simhash_groups(docs: DataFrame, radius: int = 2, shingle: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """Fingerprints of all documents, and the components of those that differ in ``radius`` bits or fewer.

    Method: equal fingerprints are one node. Covering masks give ``2**(radius+1) - 1`` tables in which every pair
    within the radius collides; the fingerprints under one key are compared, and links joined to components.
    A key's list holds different fingerprints only, so it is bounded by those that exist within the masked-out
    bits of one another, whatever the number of copies.

    Returns doc_id, the columns of ``carry``, fingerprint (signed long) and component_id, the smallest doc_id
    that is reachable.

    Defined cases: words are split at white space after folding A-Z; a text of fewer words than ``shingle`` is one
    shingle; null and empty texts have fingerprint 0, which links like any other; a row without doc_id is in
    its component and never names it; repeated rows are copies; an empty table gives an empty result; other
    columns are ignored.
    """
    marked = cut(fingerprints(docs, shingle, *carry))
    nodes = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    n = buckets(docs)
    entries = nodes.select("fingerprint").mapInArrow(_tables(radius, n), "bucket int, key long, fingerprint long")
    links = entries.groupBy("bucket").applyInArrow(_near(radius), "a long, b long")
    groups = components(links, "a", "b")
    named = nodes.join(groups, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", F.coalesce("component", "fingerprint").alias("component"), "least")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    told = named.join(least, "component").select("fingerprint", "component_id")
    return marked.join(told, "fingerprint").select("doc_id", *carry, "fingerprint", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: fingerprint and component of every document."""
    out = simhash_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
