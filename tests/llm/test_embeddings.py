import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsift.llm.components import components
from logsift.llm.embedding_dedup import embedding_dedup, query


def plain(rows, threshold=0.93):
    """(links, component) of each vector by comparing all pairs."""
    ok = [(i, l, np.array(v, float)) for i, v, l in rows if l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, root = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for label in {(l, len(v)) for _, l, v in ok}:
        own = [(i, v / np.linalg.norm(v)) for i, l, v in ok if (l, len(v)) == label]
        x = np.stack([v for _, v in own])
        near = x @ x.T >= threshold
        for a in range(len(own)):
            for b in np.flatnonzero(near[a]):
                if a != b:
                    links[own[a][0]] += 1
                    p, q = find(own[a][0]), find(own[b][0])
                    root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i in links}


def planted(n_groups, size, lone, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(n_groups):
        c = rng.normal(size=32)
        rows += [(c + rng.normal(size=32) * rng.uniform(0.02, 0.25), g % 3) for _ in range(size)]
    rows += [(rng.normal(size=32), int(rng.integers(0, 3))) for _ in range(lone)]
    return [(i, [float(np.float32(x)) for x in v], l) for i, (v, l) in enumerate(rows, 1)]


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("c") for c in ("class", "rep", "copies", "links", "component", "node", "vector")})
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup(df.repartition(3), **how).collect()}


def test_recall_is_high_and_no_link_is_wrong(spark):
    rows = planted(40, 12, 400)
    expected = plain(rows)
    got = found(spark, rows)
    true, reported = sum(v[0] for v in expected.values()), sum(v[0] for v in got.values())
    assert all(got[i][0] <= expected[i][0] for i in got)
    assert reported >= 0.97 * true > 0
    assert all(k == (i == c) for i, (_, c, k) in got.items())


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(5)
    c = rng.normal(size=32)
    rows = [(i, [float(np.float32(x)) for x in c + rng.normal(size=32) * 0.05], 1) for i in range(1, 1501)] + [(5000, [float(x) for x in c], 1), (5001, [float(x) for x in c], 1)]
    got = found(spark, rows)
    assert {v[1] for v in got.values()} == {1} and got[5000][0] >= 0.97 * 1501


def test_long_lists_are_compared_in_parts(spark):
    rng = np.random.default_rng(6)
    c = rng.normal(size=32)
    rows = [(i, [float(np.float32(x)) for x in c + rng.normal(size=32) * rng.uniform(0.02, 0.4)], 1) for i in range(1, 401)]
    assert found(spark, rows, most=50) == found(spark, rows)


@pytest.mark.parametrize("pivots", [256, 2048])
def test_recall_with_many_pivots(spark, pivots):
    # pairs at a cosine of 0.93 to 0.97: links that more pivots could keep apart
    rng = np.random.default_rng(pivots)
    rows = []
    for _ in range(2500):
        a, b = rng.normal(size=64), rng.normal(size=64)
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        cos = rng.uniform(0.93, 0.97)
        rows += [a, cos * a + math.sqrt(1 - cos * cos) * b / np.linalg.norm(b)]
    rows = [(i, [float(np.float32(x)) for x in v], 1) for i, v in enumerate(rows, 1)]
    expected, got = plain(rows), found(spark, rows, pivots=pivots)
    assert sum(v[0] for v in got.values()) >= 0.95 * sum(v[0] for v in expected.values()) > 0


def test_query_is_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in query(spark, small).collect()}
    assert got == plain(rows)


def test_edges(spark):
    one, big = [1.0, 2.0, 3.0], [1e38, 2e38, 3e38]
    rows = [(1, one, 1), (2, one, 1), (3, big, 1), (4, one, 2), (5, one, None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1), (9, [float("nan"), 1.0, 1.0], 1), (10, [float("inf"), 1.0, 1.0], 1), (11, [1.0, 2.0], 1), (12, [], 1), (13, [-1.0, -2.0, -3.0], 1)]
    got = found(spark, rows)
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False)
    assert all(got[i] == (0, i, True) for i in range(4, 14))
    assert found(spark, rows[:0] or [(1, one, 1)])[1] == (0, 1, True)
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert embedding_dedup(empty).count() == 0


def test_lengths_of_several_pivots_under_one_label_are_apart(spark):
    rng = np.random.default_rng(8)
    rows = []
    for size in (4, 6):
        for _ in range(60):
            c = rng.normal(size=size)
            rows += [(len(rows) + k, [float(np.float32(x)) for x in c + rng.normal(size=size) * 0.02], 1) for k in (1, 2)]
    expected, got = plain(rows), found(spark, rows)
    assert all(got[i][0] <= expected[i][0] for i in got)
    assert sum(v[0] for v in got.values()) >= 0.9 * sum(v[0] for v in expected.values()) > 0


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 150)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0
