"""Best-fit packing of token sequences."""

from __future__ import annotations

import base64
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsift.llm.common import buckets, cut, flushes, table, texts

END = 2


def ranks_path() -> str:
    """The public byte-level BPE vocabulary as ranks; its JSON form gives the same ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The vocabulary's encoder, loaded once a worker. Special strings in a text are ordinary text."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def _cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a first that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(i, capacity) for i in range(head, n, capacity)]


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])


def token_pieces(docs: DataFrame, capacity: int, path: str, with_ids: bool = False) -> DataFrame:
    """The pieces of every document, each document ended by one id; a text met again in a task isn't encoded again."""
    schema = _PIECES if with_ids else _PIECES.remove(5)

    def scan(batches):
        encode = encoder(path).encode_ordinary
        for flush in flushes(batches, most=2 << 20):
            seen: dict[str, list[tuple]] = {}
            out: list[tuple] = []
            column = flush.rows.column(flush.rows.schema.get_field_index("text"))
            for doc, text in zip(flush.rows.column(flush.rows.schema.get_field_index("doc_id")).to_pylist(), column):
                text = text.as_py()
                if (own := seen.get(text)) is None:
                    ids = np.array([*encode(text), END], "<u4")
                    own = []
                    for k, (a, n) in enumerate(_cuts(len(ids), capacity)):
                        part = ids[a : a + n]
                        own.append((k, a, n, zlib.crc32(part.tobytes()), *([part.astype(np.int32)] * with_ids)))
                    seen[text] = own
                out += [(doc, *x) for x in own]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return texts(docs).mapInArrow(scan, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


@dataclass
class Plan:
    """Places by length and rank: rank r of a run has sequence ``base + r // each`` and offset ``offset + r % each * length``."""

    key: list[int] = field(default_factory=list)
    base: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    sequences: int = 0


def best_two_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Pack as many pieces of each length as ``counts`` says; equal bins are filled in one step.

    A bin starts with the longest piece left and is filled greedily with the longest that fits. Then its
    smallest piece is replaced by the two unpacked pieces that fill the gap it leaves more tightly, as long as
    there are two. The work follows the number of lengths, at most ``capacity``, not that of the pieces.
    """
    left = counts.astype(np.int64).copy()
    used = np.zeros(capacity + 1, np.int64)
    plan = Plan()
    sizes = np.arange(capacity + 1)
    while left.any():
        take = np.zeros(capacity + 1, np.int64)
        free = capacity
        while free > 0:
            fit = np.flatnonzero(left[1 : free + 1] > take[1 : free + 1])
            if not len(fit):
                break
            longest = int(fit[-1]) + 1
            n = int(min(left[longest] - take[longest], free // longest))
            take[longest] += n
            free -= n * longest
        while free > 0:
            smallest = int(np.flatnonzero(take)[0])
            room = free + smallest
            spare = left - take
            have = np.maximum.accumulate(np.where(spare > 0, sizes, 0))  # the longest spare length up to each
            b = np.flatnonzero(spare[: room // 2 + 1] > 0)
            a = have[room - b]
            a = np.where((a == b) & (spare[b] < 2), have[b - 1], a)  # one piece can't be used twice
            total = np.where(a > 0, a + b, 0)
            if not len(b) or total.max() <= smallest:
                break
            k = int(total.argmax())
            take[smallest] -= 1
            take[a[k]] += 1
            take[b[k]] += 1
            free = room - int(total[k])
        of = np.flatnonzero(take)
        times = int((left[of] // take[of]).min())
        offset = 0
        for length in of[::-1]:
            plan.key.append(int(length) << 44 | int(used[length]))
            plan.base.append(plan.sequences)
            plan.each.append(int(take[length]))
            plan.offset.append(offset)
            offset += int(length * take[length])
        left[of] -= take[of] * times
        used[of] += take[of] * times
        plan.sequences += times
    return plan


def pack(docs: DataFrame, capacity: int = 1024, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Cut, and place every document's tokens in sequences of at most ``capacity``.

    Method: best-two-fit over the counts of lengths. Only those counts (at most ``capacity`` numbers) come to the
    driver; a piece's place follows from its rank among the pieces of its length. Ranks are counted within hash
    groups and added up, so pieces of one length never meet in one task.

    Returns one row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, ``with_ids``, ids.

    Defined cases: a null or empty text is the end id alone; documents without doc_id and repeated rows are packed
    as further documents; an empty table gives an empty result; other columns are ignored.
    """
    n = buckets(docs)
    found = cut(token_pieces(docs, capacity, path or ranks_path(), with_ids)).withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)))
    sizes = found.groupBy("length", "deal").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in found.groupBy("length").count().toLocalIterator():
        counts[row["length"]] = row["count"]
    plan = best_two_fit(counts, capacity)
    before = sizes.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("deal")) - F.col("n")).select("length", "deal", "before")
    own = F.row_number().over(W.partitionBy("length", "deal").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = found.withColumn("own", own).join(before, ["length", "deal"]).withColumn("rank", F.col("before") + F.col("own")).drop("own", "before", "deal")
    order = np.argsort(np.array(plan.key, np.int64))
    arrays = [np.array(x, np.int64)[order] for x in (plan.key, plan.base, plan.each, plan.offset)]
    told = docs.sparkSession.sparkContext.broadcast(arrays)
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] * with_ids)]

    def place(batches):
        key, base, each, offset = told.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            r = rank - (key[at] & ((1 << 44) - 1))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(base[at] + r // each[at]), pa.array(offset[at] + r % each[at] * length)], names=[*kept, "sequence_id", "offset"])

    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return ranked.select(*kept, F.col("rank").cast("long")).mapInArrow(place, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: where every piece of every document goes."""
    return pack(table(spark, sf_dir, "documents"))
