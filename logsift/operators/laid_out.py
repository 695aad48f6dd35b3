"""Views that are written once in their order, so that a page reads only the files that can hold it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.operators.filters import where
from logsift.operators.paging import after, after_time, order, time_order
from logsift.spec import QuerySpec
from logsift.storage import cut


def _most(spec: QuerySpec) -> int:
    return min(max(spec.limit, 1), 5000) + 1


#: So many ranges are dealt out at most: the driver samples each of them for its bounds.
RANGES = 256


def _write(rows: DataFrame, by: list[Column], last: Column, folder: str, rows_per_file: int) -> None:
    """Rows by range of their order, a range in files of ``rows_per_file``, and an index of the last row of each file."""
    files = max(1, -(-rows.count() // rows_per_file))
    # a range's files are numbered in three digits, after which their names are no longer in order
    ranges = min(files, max(RANGES, -(-files // 300)))
    # tasks move their own files to the folder: by the other way the driver moves all, one by one, and a view is only read by its index
    written = rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    written.option("maxRecordsPerFile", rows_per_file).parquet(f"{folder}/rows")
    # written files are numbered in the order of the ranges, then within them
    named = rows.sparkSession.read.parquet(f"{folder}/rows").withColumn("_path", F.col("_metadata.file_path"))
    index = named.groupBy("_path").agg(last.alias("_last"), F.count(F.lit(1)).alias("_n"))
    index.select("_last.*", "_path", "_n").coalesce(1).write.parquet(f"{folder}/index")


def lay_out(df: DataFrame, spec: QuerySpec, folder: str, rows_per_file: int = 1_000_000) -> None:
    """Write a view (filters, search and sort of ``spec``) in its order to a folder that doesn't exist."""
    columns = ([spec.sort.column] if spec.sort.column else []) + ["row_num"]
    at = F.struct(*[F.col(f"`{c}`").cast("string").alias(c) if c != "row_num" else F.col(c) for c in columns])
    _write(where(df, replace(spec, cursor=None)), order(spec), F.min(at) if spec.sort.descending else F.max(at), folder, rows_per_file)


def lay_out_by_time(df: DataFrame, row_time: DataFrame, spec: QuerySpec, folder: str, descending: bool = False, rows_per_file: int = 1_000_000) -> None:
    """The same in order of time; rows without a time come last.

    Rows and times are joined once and written to the checkpoint folder: they are counted, sampled and sorted.
    """
    found = cut(where(df, replace(spec, cursor=None)).join(row_time.select("row_num", "epoch_ms"), "row_num", "left"))
    turn = (lambda c: -F.col(c)) if descending else F.col
    at = F.max_by(F.struct("epoch_ms", "row_num"), F.struct(F.col("epoch_ms").isNull(), turn("epoch_ms"), turn("row_num")))
    _write(found, time_order(descending), at, folder, rows_per_file)


def page_files(spark: SparkSession, folder: str, beyond: Column | None, most: int) -> list[str]:
    """The files of a laid-out view that hold its first ``most`` rows beyond a cursor.

    Files that end before the cursor are passed over; as every file has a row, ``most`` + 1 entries of the index are
    enough, and fewer once the files after the first one, which may begin before the cursor, have ``most`` rows.
    """
    index = spark.read.parquet(f"{folder}/index")
    rows = (index if beyond is None else index.filter(beyond)).select("_path", "_n").orderBy("_path").limit(most + 1).collect()
    out, held = [], 0
    for k, r in enumerate(rows):
        if held >= most:
            break
        out.append(r["_path"])
        held += r["_n"] if k or beyond is None else 0
    return out


def _read(spark: SparkSession, folder: str, beyond: Column | None, by: list[Column], most: int) -> DataFrame:
    files = page_files(spark, folder, beyond, most)
    # one file tells the schema, without a list of all
    schema = spark.read.parquet(files[0] if files else f"{folder}/rows").schema
    found = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return (found if beyond is None else found.filter(beyond)).orderBy(*by).limit(most)


def page_of(spark: SparkSession, folder: str, spec: QuerySpec) -> DataFrame:
    """One page and one row more of a view that ``lay_out`` wrote with the same sort, after the cursor of ``spec``."""
    return _read(spark, folder, after(spec) if spec.cursor else None, order(spec), _most(spec))


def page_of_times(spark: SparkSession, folder: str, spec: QuerySpec, descending: bool = False) -> DataFrame:
    """One page and one row more of a view that ``lay_out_by_time`` wrote in this direction."""
    return _read(spark, folder, after_time(spec, descending) if spec.cursor else None, time_order(descending), _most(spec))
