"""Pages of written views, and many questions in one scan."""

import datetime
import statistics
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from logsift.operators import documents, laid_out, paging, selection
from logsift.spec import Cursor, Filter, QuerySpec, Sort


@pytest.fixture(scope="module")
def log(spark):
    v = F.when(F.col("id") % 11 == 0, None).otherwise(F.concat(F.lit("v"), F.lpad((F.col("id") * 7919 % 97).cast("string"), 2, "0")))
    return spark.range(1, 2001).select(F.col("id").alias("row_num"), v.alias("v"), (F.col("id") % 5).cast("string").alias("kind")).repartition(5).cache()


def _rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("sort, cursors", [(Sort("v"), [(None, 3), ("v03", 1500), ("v96", 5), ("v99", 1)]), (Sort("v", True), [("v50", 1000), ("v00", 1)]), (Sort(), [(None, 1234), (None, 2000)]), (Sort(None, True), [(None, 700)])])
def test_pages_are_those_of_the_whole_view(spark, log, tmp_path, sort, cursors):
    spec = QuerySpec(filters=(Filter("kind", "notEquals", "4"),), sort=sort, limit=30)
    folder = str(tmp_path / "view")
    laid_out.lay_out(log, spec, folder, rows_per_file=100)
    assert _rows(laid_out.page_of(spark, folder, spec)) == _rows(paging.page_frame(log, spec))
    for value, row in cursors:
        at = replace(spec, cursor=Cursor(row, value))
        assert _rows(laid_out.page_of(spark, folder, at)) == _rows(paging.page_frame(log, at))


def test_a_page_reads_the_files_that_can_hold_it(spark, log, tmp_path):
    spec, folder = QuerySpec(sort=Sort("v"), limit=30), str(tmp_path / "view")
    laid_out.lay_out(log, spec, folder, rows_per_file=100)
    every = len(list((tmp_path / "view" / "rows").glob("part-*.parquet")))
    at = replace(spec, cursor=Cursor(1000, "v50"))
    used = laid_out.page_of(spark, folder, at).select(F.input_file_name().alias("f")).distinct().count()
    read = laid_out.page_files(spark, folder, paging.after(at), 31)
    assert every >= 15 and len(read) <= 3 and used <= len(read)
    assert len(laid_out.page_of(spark, folder, at).inputFiles()) == len(read)


@pytest.mark.parametrize("descending", [False, True])
def test_pages_by_time(spark, log, tmp_path, descending):
    times = log.filter("row_num % 3 > 0").select("row_num", (F.col("row_num") * 7919 % 500).cast("long").alias("epoch_ms"))
    folder, spec = str(tmp_path / "view"), QuerySpec(limit=50)
    laid_out.lay_out_by_time(log, times, spec, folder, descending, rows_per_file=90)
    for cursor in (None, Cursor(900, "250"), Cursor(5, "3"), Cursor(600, None)):
        at = replace(spec, cursor=cursor)
        assert _rows(laid_out.page_of_times(spark, folder, at, descending)) == _rows(paging.page_by_time(log, times, at, descending))


def test_an_empty_view(spark, log, tmp_path):
    spec = QuerySpec(filters=(Filter("kind", "equals", "none"),))
    laid_out.lay_out(log, spec, str(tmp_path / "none"))
    assert laid_out.page_of(spark, str(tmp_path / "none"), spec).count() == 0


def test_many_questions_are_each_answered_as_alone(spark, small):
    vectors = spark.read.parquet(f"{small}/embeddings.parquet").select(F.concat(F.lit("k"), "vec_id").alias("doc_key"), F.col("embedding").cast("array<double>").alias("embedding"))
    odd = spark.createDataFrame([("null", None), ("zero", [0.0] * 64), ("short", [1.0, 2.0]), ("copy1", [1.0] * 64), ("copy2", [2.0] * 64)], vectors.schema)
    table = vectors.union(odd).repartition(4)
    rows = vectors.orderBy("doc_key").limit(100).collect()
    asked = spark.createDataFrame([(i, r["embedding"]) for i, r in enumerate(rows)] + [(100, [1.0] * 64), (101, [0.0] * 64), (102, None), (103, [1.0, 2.0])], "question int, embedding array<double>")
    got = {}
    for r in documents.vectors_top_k(table, asked, 7, 0.05).collect():
        got.setdefault(r["question"], []).append((-r["score"], r["doc_key"]))
    for q in (0, 17, 99, 100):
        v = rows[q]["embedding"] if q < 100 else [1.0] * 64
        n = sum(x * x for x in v) ** 0.5
        alone = documents.vector_top_k(table.filter("doc_key <> 'short'"), [x / n for x in v], 7, 0.05).collect()
        assert sorted(got[q]) == [(-r["score"], r["doc_key"]) for r in alone]
    assert 101 not in got and 102 not in got and got[103] == [(-1.0, "short")] and sorted(got[100])[:2] == [(-1.0, "copy1"), (-1.0, "copy2")]
    with pytest.raises(ValueError):
        documents.vectors_top_k(table, spark.range(2000).select(F.col("id").alias("question"), F.array(F.lit(1.0)).alias("embedding")))


def test_many_files_come_from_a_bounded_number_of_ranges(spark, tmp_path):
    log = spark.range(700).selectExpr("id * 7 % 701 + 1 AS row_num", "cast(id % 5 as string) AS kind")
    spec, folder = QuerySpec(sort=Sort("kind"), limit=1000), str(tmp_path / "view")
    laid_out.lay_out(log, spec, folder, rows_per_file=2)
    paths = [r["_path"] for r in spark.read.parquet(f"{folder}/index").collect()]
    assert len(paths) >= 350 and len({p.split("/part-")[1][:5] for p in paths}) <= laid_out.RANGES
    assert spark.read.parquet(f"{folder}/index").selectExpr("max(_n)").first()[0] == 2
    assert laid_out.page_of(spark, folder, spec).collect() == paging.page_frame(log, spec).collect()


def test_rows_and_times_of_a_view_are_joined_once(spark, log, tmp_path):
    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def parsed(x):
        read.add(1)
        return x * 7919 % 500

    times = log.select("row_num", parsed.asNondeterministic()("row_num").alias("epoch_ms")).filter("epoch_ms >= 0")
    laid_out.lay_out_by_time(log, times, QuerySpec(), str(tmp_path / "view"), rows_per_file=90)
    assert read.value == 2000


def test_a_page_lists_no_folder_of_rows(spark, log, tmp_path, monkeypatch):
    spec, folder = QuerySpec(sort=Sort("v"), limit=30), str(tmp_path / "view")
    laid_out.lay_out(log, spec, folder, rows_per_file=100)
    seen, kind = [], type(spark.read)
    monkeypatch.setattr(kind, "parquet", lambda self, *paths, f=kind.parquet, **o: seen.extend(paths) or f(self, *paths, **o))
    assert laid_out.page_of(spark, folder, spec).count() == 31
    assert f"{folder}/rows" not in seen


@pytest.mark.parametrize("values", [[], [None], [5], [2, 3], [3, 4], [7, 7, 7, 9], [-(2**62), 2**62, 5], [4, 1, None, 9, 9, 2]])
def test_the_median_is_found_by_counted_ranges(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "t long")
    known = [v for v in values if v is not None]
    assert selection.median(rows, F.col("t")) == (statistics.median(known) if known else None)


@pytest.mark.parametrize("kinds, expected", [(["view", "view"], [2, 1]), (["click", "click"], []), (["click", "click", "view"], [3])])
def test_a_page_before_the_middle_of_few_times(spark, tmp_path, kinds, expected):
    # two times of 2 and 3 ms: the middle of 2.5 ms is 2 as a whole number, and no time is before it
    rows = [(i, datetime.datetime(2024, 1, 1, 0, 0, 0, 2000 + 1000 * i), 1, kind, 1.0, "{}") for i, kind in enumerate(kinds)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    assert [r["row_num"] for r in queries()["page_laid_out_by_time"](spark, str(tmp_path)).collect()] == expected
