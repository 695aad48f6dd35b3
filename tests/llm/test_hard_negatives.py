import math

import duckdb
import numpy as np
import pytest

from logsift.llm import hard_negatives as hn
from logsift.llm import oracles
from logsift.llm.hard_negatives import Bucket, bucketed, candidates, hard_negatives

FIELDS = "vec_id long, label int, embedding array<double>"


def plain(rows, every=50, positives=5, negatives=3, low=50, high=95):
    """All pairs, one by one."""
    ok = {(i, k, tuple(v)) for i, k, v in rows if i is not None and k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    ok = [(i, k, [math.floor(256 * x) for x in v]) for i, k, v in sorted(ok)]
    out = []
    for i, k, v in ok:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in ok if len(v) == len(w)]
        for s, j, _ in sorted(x for x in scored if x[2] == k and x[1] != i)[:positives]:
            fit = sorted((t, n) for t, n, m in scored if m != k and low * -s <= 100 * -t <= high * -s)[:negatives]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(fit)]
    return sorted(out)


def rows(df):
    return sorted(map(tuple, df.collect()))


def made(n, size, seed, spread=1.0, kinds=3):
    """Vectors of skewed length and direction, as the pruning is meant for."""
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, size)) * np.geomspace(4, 0.05, size) * np.exp(rng.normal(0, spread, n))[:, None]
    return [(int(i), int(rng.integers(kinds)), [float(y) for y in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("size, spread", [(4, 1.5), (16, 0.3), (1, 1.0)])
def test_same_as_all_pairs(spark, monkeypatch, size, spread):
    data = made(900, size, size, spread)
    frame = spark.createDataFrame(data, FIELDS).repartition(3)
    assert rows(hard_negatives(frame, probes=200, per_task=7)) == plain(data)


def test_same_as_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{small}/embeddings.parquet')")
    got = rows(hn.query(spark, small))
    assert got == sorted(con.sql(oracles.HARD_NEGATIVES).fetchall()) and got


def test_a_third_of_the_rows_in_one_label_and_many_ties(spark):
    data = [(i, 0 if i % 3 else i % 7 + 1, [float(i % 5) - 1, 1.0, -2.0]) for i in range(600)]
    frame = spark.createDataFrame(data, FIELDS).repartition(4)
    expected = plain(data)
    assert rows(hard_negatives(frame)) == expected == rows(hard_negatives(frame, probes=50, per_task=3)) and expected


def test_edges(spark):
    nan, inf = math.nan, math.inf
    data = [
        (0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (0, 2, [1.0, 1.0]), (50, 1, [0.0, 0.0]), (100, None, [1.0, 1.0]), (150, 1, None), (200, 1, [None, 1.0]), (250, 1, [nan, 1.0]),
        (300, 1, [inf, 1.0]), (None, 1, [1.0, 1.0]), (350, 2, []), (400, 2, [-1.0, -1.0]), (1, 1, [1.0, 1.0]), (2, 2, [0.9, 0.9]), (3, 2, [1.0, 1.0]), (4, 3, [0.5, 0.7]), (-50, 3, [0.4, 0.8]), (5, 1, [1.0, 1.0, 1.0]), (6, 2, [1e-3, -1e-3]),
    ]
    frame = spark.createDataFrame(data, FIELDS).selectExpr("*", "'clash' AS row", "'clash' AS part", "'clash' AS size", "1 AS rank", "'x' AS vector")
    assert rows(hard_negatives(frame)) == plain(data)
    assert rows(hard_negatives(frame.limit(0))) == []
    big = spark.createDataFrame([(0, 1, [1e300]), (1, 1, [1e300]), (2, 2, [3000.0])], FIELDS)
    assert rows(hard_negatives(big)) == [(0, 1, 1, 2, 2**40, 2**20 * 768_000)]


def test_pruning_keeps_every_vector_in_reach():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(0, 1, (800, 8)) * np.geomspace(3, 0.1, 8) * 256)
    norms = np.linalg.norm(x, axis=1)
    bucket = Bucket(x, norms, np.arange(800), np.zeros(800))
    q = x[:40] / norms[:40, None]
    focus = np.argsort(-np.abs(q), axis=1)[:, : hn.FOCUS]
    need = np.full(40, 0.999)
    found = candidates(bucket, q, focus, need)
    assert found is not None and len(found[0]) < 0.05 * 40 * 800
    within = set(zip(*np.nonzero(q @ bucket.unit.T >= 0.999)))
    assert within <= set(zip(*found)) and len(within) >= 40


def test_short_buckets_are_passed_over(monkeypatch):
    seen = []
    monkeypatch.setattr(hn, "products", lambda x, y: seen.append(len(y)) or x @ y.T)
    x = np.array([[100.0 * 2**-i, 1] for i in range(4000)])
    best = hn.search(bucketed(np.floor(x), np.arange(4000), np.zeros(4000)), np.array([[100.0, 0]]), np.array([-1]), np.array([0]), 5)
    assert best.id.tolist() == [0, 1, 2, 3, 4] and len(seen) == 1
