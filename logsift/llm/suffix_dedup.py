"""Suffix-array dedup with sparse suffixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logsift.llm.common import pieces, runs, table, texts
from logsift.llm.repeats import LATER, SHARED, Shape, one_text, repeated, unpacked

_OUT = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64())])


def _spans(shape: Shape):
    """Join a document's repeated windows into maximal spans."""

    def scan(batches):
        for batch in batches:
            found = []
            for doc, marks in zip(batch.column(0).to_pylist(), batch.column(1)):
                state, low, high = unpacked(np.asarray(marks.values.to_numpy(zero_copy_only=False), np.int64))
                n = int(high.max(initial=0)) + shape.min_words
                any_, later = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
                for step, k in ((any_, state <= SHARED), (later, state == LATER)):
                    np.add.at(step, low[k], 1)
                    np.add.at(step, high[k] + shape.min_words - 1, -1)
                gone = np.concatenate([[0], np.cumsum(np.cumsum(later) > 0)])
                for a, b in zip(*runs(np.cumsum(any_) > 0)):
                    found.append((doc, int(a), int(b - a), int(gone[b] - gone[a])))
            if found:
                yield from pieces(_OUT.names, list(zip(*found)), _OUT)

    return scan


def suffix_dedup(docs: DataFrame, min_words: int = 50, gram: int = 8) -> DataFrame:
    """Maximal spans of at least ``min_words`` words whose every window of that length stands in another document.

    Method: of all suffixes only those at minimiser positions are retained (the least hash of ``gram`` words in
    some run of ``min_words - gram + 1``), about one in twenty. They are dealt to ranges of the order of the hash of
    their ``gram`` leading words, sorted by it, and those with equal ones are brought together. What follows, to both
    sides, isn't decided by the common prefixes of neighbours but by hashes of the whole windows around such a
    position, which are dealt out and compared again (see ``repeats``). So this is no suffix array in the full sense:
    a passage that very many documents hold gives as many suffixes with equal leading words, which no range of the
    order could hold, while their windows deal themselves out.

    Returns one row a span: doc_id, start_word, n_words and n_removed, the words of the span that lie in a
    window which a smaller doc_id also holds: taking those out leaves one copy of every passage. Documents
    without repeated passages have no row. Repeats inside one document don't count.

    Defined cases: null, empty and short texts have no spans; rows without doc_id are left out; repeated rows of
    one doc_id are one document, and of several texts of one doc_id that of the least hash is taken; an empty table gives an empty result; other columns are ignored.
    """
    shape = Shape(min_words, gram)
    marks = repeated(one_text(texts(docs).filter("doc_id is not null"))[0], shape, first_too=True)
    return marks.mapInArrow(_spans(shape), "doc_id long, start_word long, n_words long, n_removed long")


def query(spark, sf_dir) -> DataFrame:
    """op10: every passage of 50 words or more that documents share."""
    return suffix_dedup(table(spark, sf_dir, "documents"))
