from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline as pipeline
from logsift.llm.near_dupes import linked, near_groups
from tests.llm.cases import EDGE, documents, edge, lower, words


def shingles(text, n=5):
    w = words(lower(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def alike(x, y):
    return not (x or y) or len(x & y) >= 0.8 * len(x | y)


def plain(docs):
    """Component and links of each document by comparing all pairs."""
    sets, root = {d: shingles(t) for d, t in docs.items()}, {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(docs), 2):
        if alike(sets[a], sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d in docs}


def edited(rng, n_words, n_edits):
    w = [f"w{x}" for x in rng.integers(0, 50_000, n_words)]
    v = list(w)
    for i in rng.choice(n_words, n_edits, replace=False):
        v[i] = f"x{rng.integers(0, 50_000)}"
    return " ".join(w), " ".join(v)


def test_pairs_of_080_and_more_are_caught_and_no_others(spark):
    rng = np.random.default_rng(3)
    docs = {}
    for k in range(400):
        docs[2 * k], docs[2 * k + 1] = edited(rng, 400, int(rng.integers(1, 14)))
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in near_groups(frame).collect()}
    expected = plain(docs)
    true = [d for d in docs if expected[d] != d]
    assert all(got[d] in (d, expected[d]) for d in docs)
    assert len(true) > 200 and sum(got[d] == expected[d] for d in true) >= 0.95 * len(true)


def test_clean_texts_that_share_one_repeated_word_stay(spark):
    rng = np.random.default_rng(4)
    docs = [(k, " ".join(["the"] * 300 + [f"w{x}" for x in rng.integers(0, 10**6, 250)]), "en", "s", 1) for k in range(5)]
    kept = pipeline.near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert kept.count() == 5


@pytest.mark.parametrize("edits, least", [(2, 1.0), (3, 0.95)])
def test_a_large_group_of_near_copies(spark, edits, least):
    # with three edits two copies are mostly below 0.8: each has a few links only, and tables may miss all of them
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 50_000, 200)]
    docs = {}
    for k in range(600):
        v = list(base)
        for i in rng.choice(200, edits, replace=False):
            v[i] = f"x{rng.integers(0, 50_000)}"
        docs[k] = " ".join(v)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got, expected = {r["doc_id"]: r["component_id"] for r in near_groups(frame).collect()}, plain(docs)
    assert sum(got[d] == expected[d] for d in docs) >= least * len(docs)


def test_tables_are_brute_force(spark, small):
    docs = documents(spark, small)
    assert {r["doc_id"]: r["component_id"] for r in near_groups(spark.read.parquet(f"{small}/documents.parquet")).collect()} == plain(docs)


def test_edge_rows(spark):
    got = {r["doc_id"]: (r["component_id"], r["copies"], r["kept"]) for r in near_groups(edge(spark)).collect()}
    expected = plain({d: t for d, t in EDGE if d is not None})
    assert got == {d: (expected[d], 2 if d == 7 else 1, expected[d] == d) for d in expected}
    assert near_groups(edge(spark).limit(0)).count() == 0


def test_texts_of_one_id_are_judged_each(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    docs = [(1, a, "en", "s", 1), (2, a, "en", "s", 1), (2, b, "en", "t", 1), (2, b, "en", "s", 1), (None, c, "en", "s", 1), (None, c, "en", "s", 1)]
    kept = pipeline.near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert sorted(((r["doc_id"] or 0, r["text"], r["source"]) for r in kept.collect())) == [(0, c, "s"), (0, c, "s"), (1, a, "s"), (2, b, "s")]


def _appended(w, rng, n):
    return w + [f"y{x}" for x in rng.integers(0, 50_000, n)]


def _replaced(w, rng, n):
    at = int(rng.integers(0, len(w) - n))
    return w[:at] + [f"y{x}" for x in rng.integers(0, 50_000, n)] + w[at + n :]


@pytest.mark.parametrize("size, edit, n", [(40, _appended, 6), (400, _appended, 90), (400, _replaced, 30), (400, _replaced, 38), (60, _replaced, 1)])
def test_recall_by_kind_of_edit(spark, size, edit, n):
    rng = np.random.default_rng(size + n)
    docs = {}
    for k in range(150):
        w = [f"w{x}" for x in rng.integers(0, 50_000, size)]
        docs[2 * k], docs[2 * k + 1] = " ".join(w), " ".join(edit(w, rng, n))
    expected = plain(docs)
    true = [d for d in docs if expected[d] != d]
    got = {r["doc_id"]: r["component_id"] for r in near_groups(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)).collect()}
    assert all(got[d] in (d, expected[d]) for d in docs)
    found = sum(got[d] == expected[d] for d in true) / len(true)
    print(edit.__name__, n, "of", size, "found", round(found, 3), "of", len(true))
    assert len(true) > 100 and found >= 0.95


def test_large_clusters_meet_by_their_keys(spark):
    # a cluster over the bound is compared key by key, and long lists in parts
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 50_000, 300)]
    docs = {k: " ".join(_replaced(base, rng, int(rng.integers(1, 20)))) for k in range(200)} | {k: " ".join(_replaced(base, rng, 90)) for k in range(200, 230)}
    expected = plain(docs)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    for bounds in ({"most": 16}, {"most_bytes": 20_000}):
        got = {r["doc_id"]: r["component_id"] for r in near_groups(frame, **bounds).collect()}
        assert len({(got[d], expected[d]) for d in docs}) == len(set(got.values()))  # no wrong link
        assert sum(got[d] == expected[d] for d in docs) >= 0.95 * len(docs)


def _families(near):
    """Pairs just over 0.8 in which most keys are those that the base gives to all others, just below; near ones are one group."""
    rng = np.random.default_rng(10)
    base = [f"w{x}" for x in rng.integers(0, 50_000, 1000)]
    other = _replaced(base, rng, 60)

    def changed(w, n):
        at = set((2 + 5 * rng.choice(len(w) // 5, n, replace=False)).tolist())  # each takes five shingles of its own
        return [f"y{rng.integers(0, 50_000)}" if i in at else x for i, x in enumerate(w)]

    docs = {k: " ".join(changed(other, 2)) for k in range(near)}
    for k in range(60):
        family = [f"f{k}x{i}" if i % 160 == 82 else x for i, x in enumerate(base)]
        docs |= {1000 + 2 * k + j: " ".join(changed(family, 11)) for j in range(2)}
    return docs


@pytest.mark.parametrize("near, bounds", [(0, {"most": 16}), (40, {"most_bytes": 64_000})])
def test_links_between_the_parts_of_a_large_cluster(spark, near, bounds):
    docs = _families(near)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got, whole = ({r["doc_id"]: r["component_id"] for r in near_groups(frame, **b).collect()} for b in (bounds, {}))
    assert len(set(plain(docs).values())) > 50
    assert got == whole == plain(docs)


def test_links_of_sets_are_exact():
    rng = np.random.default_rng(9)
    held = [np.unique(rng.integers(0, 60, int(rng.integers(1, 50))).astype(np.uint32)) for _ in range(60)]
    held += [np.array([1, 2, 3, 4], np.uint32), np.array([1, 2, 3, 4, 5], np.uint32)]
    got = linked(held, 0.8)
    assert got[-1] == got[-2]
    near = [[len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)) for y in held] for x in held]
    for i in range(len(held)):
        seen, todo = {i}, [i]
        while todo:
            k = todo.pop()
            new = {j for j, v in enumerate(near[k]) if v} - seen
            seen |= new
            todo += new
        assert got[i] == min(seen)
