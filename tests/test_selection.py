"""First rows by counted ranges: the same rows as a sort and a limit."""

import random

import pytest
from pyspark.sql import functions as F

from logsift.operators import selection
from logsift.operators.selection import first_rows

ROWS = [(i % 7 - 3, [None, "", "a", "a\x00", "ab", "é", "long text that goes on " * 3, "long text that goes on " * 2][i % 8], (i * 2654435761) % 2**63 - 2**62, i % 3 == 0) for i in range(300)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "a int, s string, b long, t boolean").repartition(5).cache()


def _plain(rows, order, k):
    def key(r):
        out = []
        for name in order:
            down, v = name.startswith("-"), r["asbt".index(name.lstrip("-"))]
            v = v.encode() if isinstance(v, str) else v
            out.append((down, v))
        return out

    for name in reversed(order):
        at, down = "asbt".index(name.lstrip("-")), name.startswith("-")
        rows = sorted(rows, key=lambda r: (r[at] is not None, r[at].encode() if isinstance(r[at], str) else r[at] if r[at] is not None else 0), reverse=down)
    return rows[:k]


@pytest.mark.parametrize("order, k", [(["a", "s", "b"], 150), (["-a", "b"], 37), (["s", "-b"], 299), (["-s", "b"], 150), (["t", "-a", "-b"], 1), (["b"], 150), (["-b"], 37)])
def test_same_as_sort_and_limit(table, order, k):
    got = sorted(map(tuple, first_rows(table, order, k).collect()), key=str)
    assert got == sorted(_plain(ROWS, order, k), key=str)


def test_edges(table):
    assert first_rows(table, ["a"], None) is table
    assert first_rows(table, ["a"], 0).count() == 0
    assert first_rows(table, ["a"], 300).count() == first_rows(table, ["a"], 10**9).count() == 300
    assert first_rows(table.limit(0), ["a"], 5).count() == 0
    with pytest.raises(TypeError):
        first_rows(table.withColumn("d", F.lit(0.5)), ["d"], 5)


def test_ties_and_identical_rows_fill_the_cap_exactly(spark):
    same = spark.createDataFrame([(1, "x")] * 50 + [(0, "y")] * 3 + [(1, "z")], "a int, s string").repartition(4)
    assert first_rows(same, ["a"], 3).distinct().collect() == [(0, "y")]
    for k in (4, 53):
        got = first_rows(same, ["a"], k).collect()
        assert len(got) == k and sum(r["s"] == "y" for r in got) == 3


def test_many_passes(spark, monkeypatch):
    monkeypatch.setattr(selection, "RANGES", 3)
    numbers = [random.Random(4).randrange(-(2**63), 2**63) for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in numbers], "x long").repartition(3)
    for k in (1, 250):
        assert sorted(r[0] for r in first_rows(df, ["x"], k).collect()) == sorted(numbers)[:k]


def test_no_task_sorts_or_merges_the_rows(spark):
    df = spark.range(5000).withColumn("s", F.hex("id"))
    plan = first_rows(df, ["s", "id"], 700)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Limit" not in plan and "TakeOrdered" not in plan and "SinglePartition" not in plan
