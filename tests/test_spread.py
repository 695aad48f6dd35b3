"""Steps that work hard on each row have tasks for all cores, also over a file that is one task."""

import pytest

from logsift.operators import anomalies, documents, resumable, roles
from logsift.plans import catalog
from logsift.spec import ColumnMeta
from logsift.storage import spread

META = [ColumnMeta("message", "Message")]


@pytest.fixture
def one(spark):
    return spark.range(1, 41, 1, 1).selectExpr("id AS row_num", "concat('certutil run ', id) AS message")


def _spread(df) -> bool:
    return "hashpartitioning(row_num" in df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_task_are_dealt_out(spark, one):
    cores = spark.sparkContext.defaultParallelism
    assert spread(one).rdd.getNumPartitions() >= cores
    assert sorted(spread(one).collect()) == sorted(one.collect())
    many = one.repartition(2 * cores)
    assert spread(many) is many


def test_roles_profile(one):
    assert _spread(roles.value_profile(one, ["message"], None))


def test_anomaly_scan(one):
    assert _spread(anomalies.scan_anomalies(one, META, {}, cap=None))


def test_anomaly_cells_of_the_pages(spark):
    assert _spread(catalog.anomaly_cells(spark, "/root/testdata/sf0.001"))


def test_coverage(one):
    modes = {"message": "text"}
    assert _spread(documents.coverage(one, META, one.selectExpr("'k' AS doc_key", "row_num"), modes))


def test_builds_in_batches(spark, one, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(resumable, "cut", lambda df: seen.append(df.rdd.getNumPartitions()) or df)
    resumable.commit_batch(one, 0, str(tmp_path), META, {"message": "text"})
    assert seen[0] >= spark.sparkContext.defaultParallelism
