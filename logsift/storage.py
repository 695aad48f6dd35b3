"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Only on a local master is a folder chosen here where that is unset, as in tests; a cluster has to name one that
    all its machines see.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            given = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(given)
    return sc._jsc.sc().getCheckpointDir().get()


def spread(df: DataFrame) -> DataFrame:
    """Rows of a log dealt out by row number, if their source gives fewer tasks than there are cores.

    A Parquet file is split by its bytes and row groups, and a log's cells compress well: a million rows may be one
    task. For steps that work hard on each row; ``df`` is a source with no exchange behind it.
    """
    n = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n, "row_num")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and return it without its lineage; partitions and their order stay."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
