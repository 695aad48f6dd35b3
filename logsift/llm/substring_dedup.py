"""Substring dedup by seed and extend."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from logsift.llm.common import flushes, runs, texts, word_spans
from logsift.llm.repeats import LATER, Shape, cover, one_text, repeated

SPANS = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer"))


def _cut(shape: Shape, layout: bool, columns: list[str], schema: pa.Schema):
    """Take marked words out of each row's text; ``layout`` keeps the white space between kept words."""

    def scan(batches):
        for flush in flushes(batches, most=2 << 20):
            starts, ends, first = word_spans(flush)
            marks = flush.rows.column(flush.rows.schema.get_field_index("marks"))
            gone = cover(flush.n, first, marks, LATER, after=shape.min_words - 1)
            data = flush.bytes.tobytes()
            begin, stop = runs(gone)
            removed = np.concatenate([[0], np.cumsum(gone)])
            text, spans = [], []
            for r in range(flush.n):
                a, b = int(first[r]), int(first[r + 1])
                low, high = int(flush.at[r]), int(flush.at[r + 1])
                row = data[low:high]
                if removed[a] == removed[b]:
                    text.append(row if layout else b" ".join(row.split()))
                    spans.append([])
                    continue
                # a run may touch the next row's: cut it at the row's ends
                i, j = np.searchsorted(stop, a, "right"), np.searchsorted(begin, b, "left")
                own = [(max(int(x), a), min(int(y), b)) for x, y in zip(begin[i:j], stop[i:j])]
                spans.append([{"start": x - a, "end": y - a} for x, y in own])
                if layout:
                    parts, at = [], low
                    for x, y in own:
                        parts.append(data[at : starts[x]])
                        at = int(starts[y]) if y < b else high
                    parts.append(data[at:high])
                    text.append(b"".join(parts))
                else:
                    text.append(b" ".join(compress(row.split(), ~gone[a:b])))
            carried = [flush.rows.column(flush.rows.schema.get_field_index(c)) for c in columns]
            n_words, n_removed = np.diff(first), removed[first[1:]] - removed[first[:-1]]
            yield pa.RecordBatch.from_arrays([*carried, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, schema.field("spans").type), pa.array(text, pa.binary()).cast(pa.string())], schema=schema)

    return scan


def substring_dedup(docs: DataFrame, min_words: int = 13, seed_words: int = 5, layout: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove every word that lies in a run of ``min_words`` words which a smaller doc_id also holds.

    Method: documents meet on winnowed anchors (``seed_words`` words), matches are extended both ways to whole
    windows, and maximal runs of repeated windows are taken out (see ``repeats``). Windows are judged on the
    input. Returns doc_id, the columns named in ``carry``, n_words, n_removed, spans (removed word ranges,
    half-open) and kept (the kept words joined by one space or, with ``layout``, the text without the removed
    words and the white space after them).

    Defined cases: a null or empty text has no words; a text shorter than a window keeps everything; a row
    without doc_id neither loses words nor takes any; repeated rows of one doc_id are one document and each
    gets its result; where texts of one doc_id differ, those of the least hash are the document and the others are
    treated like rows without doc_id; an empty table gives an empty result; other columns are ignored.
    """
    shape = Shape(min_words, seed_words)
    source = texts(docs, *carry)
    known, others = one_text(source.filter("doc_id is not null"))
    # the same rows meet marks twice, so that Spark deals the texts out once
    joined = known.join(repeated(known, shape, first_too=False), "doc_id", "left")
    joined = joined.union(source.filter("doc_id is null").union(others).withColumn("marks", F.lit(None).cast("array<long>")).select(joined.columns))
    columns = ["doc_id", *carry]
    out = T.StructType([source.schema[c] for c in columns])
    out = out.add("n_words", "long").add("n_removed", "long").add("spans", SPANS).add("kept", "string")
    return joined.mapInArrow(_cut(shape, layout, columns, to_arrow_schema(out)), out)


def query(spark, sf_dir) -> DataFrame:
    """op2: digests of what is left of every document."""
    from logsift.llm.common import table

    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
