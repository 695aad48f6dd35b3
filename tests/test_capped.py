"""Disjoint address ranges, and plans that Spark can compile."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from logsift.operators import rollups
from logsift.operators.rollups import _blocks, disjoint


def _first(ranges, x):
    return min(((o, label) for low, high, label, o in ranges if low <= x <= high), default=(None, None))[1]


@pytest.mark.parametrize("seed", range(5))
def test_disjoint_ranges_name_every_address_as_the_first_range_does(seed):
    rng = random.Random(seed)
    ranges = []
    for o in range(30):
        low = rng.randrange(300)
        ranges.append((low, rng.choice([low, rng.randrange(low, 300), 299]), f"r{o}", o))
    cut = disjoint(ranges)
    assert all(a[1] < b[0] for a, b in zip(cut, cut[1:]))
    for x in range(-1, 301):
        assert next((label for low, high, label, _ in cut if low <= x <= high), None) == _first(ranges, x)
    for low, high, _, _ in cut:
        assert [x for bits, block in _blocks(low, high) for x in range(block << bits, (block + 1) << bits)] == list(range(low, high + 1))


def test_wide_ranges_are_few_blocks(spark, monkeypatch):
    assert _blocks(0, 2**32 - 1) == [(32, 0)] and max(len(_blocks(1, 2**32 - 2)), len(_blocks(5, 2**31 + 7))) <= 62
    ranges = [(1, 2**32 - 2, "all", 1), (167_772_160, 184_549_375, "ten", 0)]
    frame = spark.createDataFrame(ranges, "low long, high long, label string, ord int")
    df = spark.createDataFrame([(1, "10.0.0.1"), (2, "11.0.0.1:80"), (3, "255.255.255.255"), (4, '"[10.0.0.1]"'), (5, "x"), (6, "2001:DB8::1")], "row_num long, ip string")
    expected = [("10.0.0.1", "ten", 2), ("11.0.0.1", "all", 1), ("2001:db8::1", None, 1), ("255.255.255.255", None, 1)]
    read = lambda: sorted(tuple(r) for r in rollups.ip_rollup(df, "ip", frame).select("ip", "label", "rows").collect())
    assert read() == expected
    monkeypatch.setattr(rollups, "SWEPT", 1)  # too many to sweep
    assert read() == expected
    assert rollups.ip_rollup(df, "ip", frame.limit(0)).filter(F.col("label").isNotNull()).count() == 0


@pytest.mark.parametrize("name", ["private_groups", "report_general", "report_activity", "activity_summary"])
def test_plans_compile(spark, small, name):
    """Spark falls back to interpreted code where a generated class doesn't compile; here it must fail instead."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "CODEGEN_ONLY")
    try:
        assert __spark_entry__.queries()[name](spark, small).count() > 0
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
        spark.conf.unset("spark.sql.codegen.factoryMode")
