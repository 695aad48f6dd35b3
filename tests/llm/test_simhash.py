from itertools import combinations

import numpy as np
import pytest
import xxhash

from logsift.llm.simhash import covering_masks, query, simhash_groups
from tests.llm.cases import EDGE, documents, edge, lower, words


def plain(docs, shingle=3, radius=2):
    prints = {}
    for d, t in docs.items():
        w = words(lower(t))
        shingles = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] if len(w) >= shingle else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        prints[d] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    ids = sorted(docs)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    f = np.array([prints[d] for d in ids], np.uint64)
    for a in range(len(ids)):
        for b in np.flatnonzero(np.bitwise_count(f[a + 1 :] ^ f[a]) <= radius) + a + 1:
            x, y = find(ids[a]), find(ids[b])
            root[max(x, y)] = min(x, y)
    return {d: (f"{prints[d]:016x}", find(d)) for d in ids}


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_some_mask_leaves_out_any_places(radius):
    masks = covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for places in combinations(range(0, 64, 1 if radius < 3 else 3), radius):
        bits = sum(1 << p for p in places)
        assert any(m & bits == 0 for m in masks)


def test_query_is_brute_force(spark, small):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in query(spark, small).collect()}
    assert got == plain(documents(spark, small))


def test_edges(spark):
    rows = simhash_groups(edge(spark), carry=("source",)).collect()
    assert len(rows) == len(EDGE)
    expected = plain({d: t for d, t in EDGE if d is not None})
    for r in rows:
        if r["doc_id"] is not None:
            assert r["component_id"] == expected[r["doc_id"]][1]
    # without an id a row is in its component: it is a copy of document 7
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {expected[7][1]}
    assert {expected[d][1] for d in (2, 3, 4)} == {2}
    assert simhash_groups(edge(spark).limit(0)).count() == 0


def test_a_large_group_of_near_copies_and_a_chain(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for d in range(300):
        w = list(base)
        for k in rng.integers(0, 400, d % 3):
            w[k] = f"x{d}"
        rows.append((d + 10, " ".join(w)))
    rows += [(1000 + d, " ".join(f"r{d}_{i}" for i in range(30))) for d in range(50)]
    got = {r["doc_id"]: r["component_id"] for r in simhash_groups(edge(spark, rows).repartition(5), radius=4).collect()}
    assert got == {d: c for d, (_, c) in plain(dict(rows), radius=4).items()}
