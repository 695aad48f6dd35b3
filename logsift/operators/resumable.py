"""Document builds in batches that can be stopped anywhere and run again."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.operators.documents import Limits, build_documents, mapped_documents
from logsift.spec import ColumnMeta
from logsift.storage import cut, spread

_COMMIT = "batch long, first_row long, last_row long, documents long, mappings long"
_DOCUMENTS = "doc_key string, kind string, column_key string, text string"


def _parts(spark: SparkSession, folder: str, kind: str, batches: list[int], schema: str) -> DataFrame:
    """What some batches have written of one kind."""
    if not batches:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/{kind}/{b}" for b in batches])


def commits(spark: SparkSession, folder: str) -> list[T.Row]:
    """The records of the batches that are committed, in order; one without its record doesn't count."""
    where_ = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/commits")
    system = where_.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where_):
        return []
    # a writer leaves _SUCCESS last: a folder without it was begun only
    done = [str(x.getPath()) for x in system.listStatus(where_) if system.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
    return sorted(spark.read.schema(_COMMIT).parquet(*done).collect()) if done else []


def commit_batch(rows: DataFrame, batch: int, folder: str, meta: list[ColumnMeta], modes: dict[str, str], limits: Limits = Limits(), total_rows: int | None = None) -> None:
    """Write one batch of rows: its new documents, its mappings and, last, its record.

    Each goes to a folder named by the batch, over what an earlier try has left, so a batch that is run twice adds
    nothing. New documents are those that no earlier committed batch has. With ``total_rows`` the limits of the whole
    build are allowed in proportion to the rows up to the batch's last one; what earlier batches didn't use is
    left over. Also for ``writeStream.foreachBatch``, whose batch numbers are the same when a batch runs again.
    """
    spark = rows.sparkSession
    before = [c for c in commits(spark, folder) if c["batch"] < batch]
    known = _parts(spark, folder, "documents", [c["batch"] for c in before], _DOCUMENTS)
    first, last = rows.agg(F.min("row_num"), F.max("row_num")).first()

    def allowed(limit: int | None, used: int) -> int | None:
        if limit is None:
            return None
        return max(0, (limit if total_rows is None else limit * min(last or 0, total_rows) // total_rows) - used)

    mapped = cut(mapped_documents(spread(rows), meta, modes, limits))
    new = mapped.join(known.select("doc_key"), "doc_key", "left_anti")
    old = mapped.join(known.select("doc_key"), "doc_key", "left_semi")
    documents, _ = build_documents(rows, meta, modes=modes, limits=replace(limits, documents=allowed(limits.documents, sum(c["documents"] for c in before)), mappings=None), mapped=new)
    documents.write.mode("overwrite").parquet(f"{folder}/documents/{batch}")
    written = _parts(spark, folder, "documents", [batch], _DOCUMENTS)
    both = new.join(written.select("doc_key"), "doc_key", "left_semi").unionByName(old)
    _, doc_rows = build_documents(rows, meta, modes=modes, limits=replace(limits, documents=None, mappings=allowed(limits.mappings, sum(c["mappings"] for c in before))), mapped=both)
    doc_rows.write.mode("overwrite").parquet(f"{folder}/doc_rows/{batch}")
    n_rows = _parts(spark, folder, "doc_rows", [batch], "doc_key string, row_num long").count()
    record = spark.createDataFrame([(batch, first, last, written.count(), n_rows)], _COMMIT)
    record.coalesce(1).write.mode("overwrite").parquet(f"{folder}/commits/{batch}")


def build_in_batches(df: DataFrame, meta: list[ColumnMeta], modes: dict[str, str], folder: str, batch_rows: int = 10_000_000, limits: Limits = Limits(), most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, doc_rows) of a table, built ``batch_rows`` row numbers at a time; a later call goes on where one ended.

    A batch is a range of row numbers, so a sorted or partitioned table is read in part. ``most``: stop after so many
    batches of this call. Defined cases: a table without rows gives empty results; rows that were added since are
    built by the next call, but a last batch that was committed isn't looked at again below its last row.
    """
    spark = df.sparkSession
    total = df.agg(F.max("row_num")).first()[0] or 0
    done = commits(spark, folder)
    last = max((c["last_row"] or 0 for c in done), default=0)
    batch = max((c["batch"] for c in done), default=-1) + 1
    while last < total and most != 0:
        rows = df.filter(F.col("row_num").between(last + 1, min(last + batch_rows, total)))
        if not rows.isEmpty():
            commit_batch(rows, batch, folder, meta, modes, limits, total)
            batch += 1
            most = None if most is None else most - 1
        last = min(last + batch_rows, total)
    return stored(spark, folder)


def stored(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(documents, doc_rows) of the committed batches."""
    done = [c["batch"] for c in commits(spark, folder)]
    return _parts(spark, folder, "documents", done, _DOCUMENTS), _parts(spark, folder, "doc_rows", done, "doc_key string, row_num long")
