"""Limits of a document build by position, and builds that stop and go on."""

import pytest
from pyspark.sql import functions as F

from logsift.operators import resumable
from logsift.operators.documents import Limits, build_documents, coverage, disclosure
from logsift.operators.selection import even_share, fair_shares
from logsift.spec import ColumnMeta

META, MODES = [ColumnMeta("message", "Message"), ColumnMeta("detail", "Detail")], {"message": "text", "detail": "text"}


def _letters(c):
    return F.translate(c.cast("string"), "0123456789", "abcdefghij")


def _log(spark, n=2000):
    return spark.range(n).select((F.col("id") + 1).alias("row_num"), F.concat(F.lit("alert about "), _letters(F.col("id"))).alias("message"), F.concat(F.lit("kind number "), _letters(F.col("id") % 7)).alias("detail")).repartition(4)


def test_fair_shares():
    assert fair_shares([10, 0, 3, 10], 13) == [5, 0, 3, 5] and fair_shares([5, 5], 100) == [5, 5] and fair_shares([], 3) == []
    for limit in range(0, 40):
        got = fair_shares([1, 9, 4, 4, 20], limit)
        assert sum(got) == min(limit, 38) and all(x <= d for x, d in zip(got, [1, 9, 4, 4, 20]))


@pytest.mark.parametrize("limit", [100, 777, 2000])
def test_even_share_fills_the_limit_and_covers_the_table(spark, limit):
    df = spark.range(1, 2001).select("id", F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("key"))
    got = sorted(r["id"] for r in even_share(df, "id", "key", limit, strata=50).select("id").collect())
    assert len(got) == len(set(got)) == min(limit, 2000)
    tenths = [sum(200 * k < x <= 200 * (k + 1) for x in got) for k in range(10)]
    assert max(tenths) - min(tenths) <= 5


def test_what_one_part_of_a_table_does_not_need_goes_to_others(spark):
    # three quarters of the rows are in the last tenth
    ids = list(range(1, 901, 9)) + list(range(901, 1001)) * 3
    df = spark.createDataFrame([(x, k) for k, x in enumerate(ids)], "row long, k long").withColumn("key", F.sha2(F.col("k").cast("string").cast("binary"), 256))
    got = [r["row"] for r in even_share(df, "row", "key", 250, strata=10).collect()]
    assert len(got) == 250 and sum(x <= 900 for x in got) == 100


def test_limits_of_a_build_are_filled_evenly(spark):
    df = _log(spark)
    found, rows = build_documents(df, META, modes=MODES, limits=Limits(documents=500, mappings=900))
    assert found.count() == 500 and rows.join(found, "doc_key", "left_anti").count() == 0
    by = [r["count"] for r in rows.groupBy(F.floor((F.col("row_num") - 1) / 200).alias("t")).count().orderBy("t").collect()]
    assert sum(by) == 900 and len(by) == 10 and max(by) - min(by) <= 25
    told = coverage(df, META, rows, MODES).first()
    assert (told["documents_seen"], told["documents_mapped"]) == (2007, rows.select("doc_key").distinct().count())
    seen = disclosure(rows.select("row_num").distinct(), df, found, found, covered=coverage(df, META, rows, MODES)).first()
    assert any(f"{told['mappings_skipped']} mappings" in w for w in seen["warnings"]) and seen["broad"]


def _read(parts):
    documents, rows = parts
    return sorted(map(tuple, documents.collect())), sorted(map(tuple, rows.collect()))


def test_a_build_that_was_killed_equals_one_that_was_not(spark, tmp_path, monkeypatch):
    df = _log(spark)
    whole = _read(build_documents(df, META, modes=MODES, limits=Limits(documents=None, mappings=None)))
    limits, folder = Limits(documents=None, mappings=None), str(tmp_path / "a")
    assert len(_read(resumable.build_in_batches(df, META, MODES, folder, 600, limits, most=1))[0]) == 607
    # killed after its documents were written, before its record was
    real = resumable._parts

    def broken(spark, folder, kind, *more):
        if kind == "doc_rows":
            raise RuntimeError("killed")
        return real(spark, folder, kind, *more)

    monkeypatch.setattr(resumable, "_parts", broken)
    with pytest.raises(RuntimeError):
        resumable.build_in_batches(df, META, MODES, folder, 600, limits)
    monkeypatch.undo()
    assert len(resumable.commits(spark, folder)) == 1 and (tmp_path / "a" / "doc_rows" / "1").exists()
    assert len(_read(resumable.stored(spark, folder))[0]) == 607
    assert _read(resumable.build_in_batches(df, META, MODES, folder, 600, limits)) == whole
    assert [c["batch"] for c in resumable.commits(spark, folder)] == [0, 1, 2, 3]
    # a batch that runs twice adds nothing, and a finished build has nothing to do
    resumable.commit_batch(df.filter("row_num between 601 and 1200"), 1, folder, META, MODES, limits)
    assert _read(resumable.build_in_batches(df, META, MODES, folder, 600, limits)) == whole
    # rows that came later
    more = df.union(df.filter("row_num <= 100").withColumn("row_num", F.col("row_num") + 2000))
    documents, rows = _read(resumable.build_in_batches(more, META, MODES, folder, 600, limits))
    assert documents == whole[0] and len(rows) == len(whole[1]) + 200


def test_limits_of_a_build_in_batches(spark, tmp_path):
    df, limits = _log(spark), Limits(documents=400, mappings=1000)
    documents, rows = resumable.build_in_batches(df, META, MODES, str(tmp_path / "b"), 500, limits)
    assert documents.count() == 400 and rows.count() <= 1000
    by = [r["count"] for r in rows.groupBy(F.floor((F.col("row_num") - 1) / 500).alias("t")).count().orderBy("t").collect()]
    assert len(by) == 4 and rows.join(documents, "doc_key", "left_anti").count() == 0
    assert resumable.build_in_batches(df.limit(0), META, MODES, str(tmp_path / "c"), 500, limits)[0].count() == 0


def test_batches_of_a_stream(spark, tmp_path):
    df = _log(spark, 300)
    for k in range(3):
        df.filter(F.col("row_num") % 3 == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    folder, limits = str(tmp_path / "out"), Limits(documents=None, mappings=None)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for _ in range(2):  # the second run finds nothing new
        query = stream.writeStream.foreachBatch(lambda rows, batch: resumable.commit_batch(rows, batch, folder, META, MODES, limits)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert _read(resumable.stored(spark, folder)) == _read(build_documents(df, META, modes=MODES, limits=limits))
