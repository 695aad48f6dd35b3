"""The entropy of a cell is that of all its characters, however long it is."""

import math
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from logsift.operators import anomalies
from logsift.plans import catalog
from logsift.spec import ColumnMeta

_RANDOM = "".join(random.Random(7).choices([chr(c) for c in range(33, 123)], k=12_000))
#: Random in all but the beginning, random in the beginning only, and short ones.
PAGES = ["a" * 4096 + _RANDOM, _RANDOM[:4096] + "a" * 60_000, _RANDOM[:200], "b" * 200, "é漢👍" * 3000]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pages")
    spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string").selectExpr("page_id", "'u' AS url", "html").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def test_cell_findings(spark):
    rows = spark.createDataFrame(list(enumerate(PAGES)), "row_num long, html string")
    found = anomalies.cell_findings(rows, [ColumnMeta("html", "Html")], {})
    assert sorted(r["row_num"] for r in found.collect() if r["category"] == "high_entropy") == [0, 2]


@pytest.mark.parametrize("name, rows", [("anomaly_cells", {1, 3}), ("report_anomalies", {2, 3})])
def test_queries_are_those_of_their_sql(spark, pages, name, rows):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{pages}/pages.parquet/*.parquet'")
    expected = sorted(con.sql(catalog.ORACLE[name]).fetchall())
    assert sorted(map(tuple, catalog.QUERIES[name](spark, pages).collect())) == expected
    assert {r[0] for r in expected if r[1] == "high_entropy"} == rows


def test_entropy_of_many_different_characters(spark):
    texts = ["".join(chr(0x4E00 + i % 20_000) for i in range(50_000)), *PAGES, "", None]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i long, v string").orderBy("i").select(anomalies.entropy(F.col("v"))).collect()]
    plain = [None if t is None else -sum(k / len(t) * math.log2(k / len(t)) for k in Counter(t).values()) for t in texts]
    assert got[-1] is None and got[:-1] == pytest.approx(plain[:-1])
