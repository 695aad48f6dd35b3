import hashlib

import numpy as np
import pyarrow as pa
import pytest

from logsift.llm.common import Flush, flushes, grams, ranges, winnow, word_spans
from logsift.llm.repeats import Shape
from logsift.llm.substring_dedup import query as op2
from logsift.llm.substring_dedup import substring_dedup
from logsift.llm.suffix_dedup import query as op10
from logsift.llm.suffix_dedup import suffix_dedup
from tests.llm.cases import EDGE, documents, edge, words


def plain(docs, size):
    """For each document its words, which lie in a window of a smaller one, and which in a window of another."""
    seen = {}
    for d, t in docs.items():
        w = words(t)
        for i in range(len(w) - size + 1):
            low, high = seen.get(k := tuple(w[i : i + size]), (d, d))
            seen[k] = (min(low, d), max(high, d))
    out = {}
    for d, t in docs.items():
        w = words(t)
        gone, shared = [False] * len(w), [False] * len(w)
        for i in range(len(w) - size + 1):
            low, high = seen[tuple(w[i : i + size])]
            if low < d:
                gone[i : i + size] = [True] * size
            if low != high:
                shared[i : i + size] = [True] * size
        out[d] = (w, gone, shared)
    return out


def digest(w, gone):
    return hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()


def test_substring_query_is_brute_force(spark, small):
    expected = {d: (len(w), sum(g), digest(w, g)) for d, (w, g, _) in plain(documents(spark, small), 13).items()}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op2(spark, small).collect()}
    assert got == expected
    assert sum(v[1] for v in got.values()) > 0


def test_suffix_query_is_brute_force(spark, small):
    got = {}
    for r in op10(spark, small).collect():
        got.setdefault(r["doc_id"], []).append((r["start_word"], r["n_words"], r["n_removed"]))
    for d, (w, gone, shared) in plain(documents(spark, small), 50).items():
        spans, i = [], 0
        while i < len(w):
            j = i
            while j < len(w) and shared[j]:
                j += 1
            spans += [(i, j - i, sum(gone[i:j]))] if j > i else []
            i = max(j, i + 1)
        assert sorted(got.get(d, [])) == spans


def test_edges(spark):
    known = {d: t for d, t in EDGE if d is not None}
    expected = {d: (len(w), sum(g), digest(w, g)) for d, (w, g, _) in plain(known, 13).items()}
    rows = substring_dedup(edge(spark), carry=("source",)).collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
            continue
        assert (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) == expected[r["doc_id"]]
        assert r["source"] == "s"
    assert {r["doc_id"] for r in suffix_dedup(edge(spark)).collect()} == {-3, 1, 6, 7, 8, 9}
    empty = edge(spark).limit(0)
    assert substring_dedup(empty).count() == 0 and suffix_dedup(empty).count() == 0


def test_layout_keeps_the_rest(spark):
    for r in substring_dedup(edge(spark), layout=True).collect():
        source = dict(EDGE)[r["doc_id"]] or "" if r["doc_id"] is not None else None
        if r["n_removed"] == 0 and source is not None:
            assert r["kept"] == source
    kept = {r["doc_id"]: r["kept"] for r in substring_dedup(edge(spark), layout=True).collect()}
    assert kept[1] == "start one end one" and kept[6] == "other tailé  x" and kept[7] == ""


def test_a_passage_in_a_third_of_all_rows(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(i, (f"own{i} " * 3) + (passage if i % 3 == 0 else f"u{i} " * 20)) for i in range(1, 601)]
    rows[1] = (2, "q " + " ".join(passage.split()[:13]))
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup(edge(spark, rows).repartition(7)).collect()}
    expected = {d: sum(g) for d, (_, g, _) in plain(dict(rows), 13).items()}
    assert got == expected


@pytest.mark.parametrize("width", [1, 2, 5, 9])
def test_equal_runs_choose_equal_places(width):
    rng = np.random.default_rng(width)
    passage = rng.integers(0, 2**63, 40, dtype=np.uint64)
    for _ in range(20):
        a = np.concatenate([rng.integers(0, 2**63, rng.integers(0, 9), dtype=np.uint64), passage, rng.integers(0, 2**63, 7, dtype=np.uint64)])
        places = winnow(a, np.ones(len(a), bool), width)
        for i in range(len(a) - width + 1):
            assert ((places >= i) & (places < i + width)).any()
            run = a[i : i + width] | np.uint64(1)
            assert i + int(run.argmin()) in places


def test_hashes_follow_the_words():
    texts = ["a b", None, "", "b a\tb", "  c", "a" * (3 << 20), "b"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    for part in (batch, batch.slice(3, 3)):
        flush = Flush(part)
        starts, ends, first = word_spans(flush)
        found = [flush.bytes[s:e].tobytes().decode() for s, e in zip(starts, ends)]
        assert found == [w for t in part.column(0).to_pylist() for w in (t or "").split()]
        h = ranges(flush.bytes, starts, ends)
        assert len({(w, int(x)) for w, x in zip(found, h)}) == len(set(found)) == len(set(h.tolist()))
    parts = list(flushes(iter([batch]), most=4))
    assert [t for f in parts for t in f.rows.column(0).to_pylist()] == texts and len(parts) > 1
    assert all(f.n == 1 or len(f.bytes) <= 4 for f in parts)
    key, ok = grams(np.arange(5, dtype=np.uint64), 2, np.array([0, 3, 5]))
    assert ok.tolist() == [True, True, False, True, False]


def test_a_seed_longer_than_a_window_is_an_error():
    with pytest.raises(ValueError):
        Shape(3, 4)


def test_texts_of_one_id_take_no_marks_of_each_other(spark):
    a, b = " ".join(f"a{i}" for i in range(15)), " ".join(f"b{i}" for i in range(15))
    got = sorted((r["doc_id"], r["kept"]) for r in substring_dedup(spark.createDataFrame([(1, a), (2, a), (2, b)], "doc_id long, text string")).collect())
    # whichever text stands for 2, b stands nowhere else and stays whole
    assert got[0] == (1, a) and (2, b) in got and got[1:] in ([(2, ""), (2, b)], [(2, a), (2, b)])
