import pytest
from pyspark.sql import functions as F

from logsift.operators import chains, filters, paging
from logsift.sources import tables
from logsift.spec import Alternative, And, Cursor, Filter, MatchNone, Not, Or, QuerySpec, RowIds, Search, Selection, Sort, SpecError


@pytest.fixture(scope="module")
def basic(spark):
    rows = [(1, "alice", "100"), (2, "bob", "200"), (3, "forensic_test_marker_XYZ", "300"), (4, "dave", "400"), (5, "eve", "500")]
    return spark.createDataFrame(rows, "row_num long, account string, event_id string")


def ids(df):
    return [r["row_num"] for r in df.orderBy("row_num").collect()]


def test_search_and_compare(basic):
    assert ids(filters.where(basic, QuerySpec(search="forensic test MARKER"))) == [3]
    assert ids(filters.where(basic, QuerySpec(filters=(Filter("event_id", "greaterThan", "300"),)))) == [4, 5]
    assert ids(filters.where(basic, QuerySpec(search="forens"))) == []
    assert ids(filters.where(basic, QuerySpec(search="*"))) == []


def test_text_times_compare_as_text(spark):
    rows = [(1, "2026-06-30T08:00:00Z"), (2, "2026-06-30T10:00:00Z"), (3, "2026-06-30T11:00:00Z"), (4, "2026-06-30T13:00:00Z")]
    df = spark.createDataFrame(rows, "row_num long, ts string")
    spec = QuerySpec(filters=(Filter("ts", "greaterThan", "2026-06-30T09:00:00Z"), Filter("ts", "lessThan", "2026-06-30T12:00:00Z")))
    assert ids(filters.where(df, spec)) == [2, 3]


def test_numbers_nulls_and_case(spark):
    rows = [(1, "12abc"), (2, ""), (3, None), (4, "-1.5e2x"), (5, "É"), (6, "é"), (7, "A_b%")]
    df = spark.createDataFrame(rows, "row_num long, v string")
    run = lambda node: ids(filters.where(df, QuerySpec(expression=node)))
    assert run(Filter("v", "lessThan", "5")) == [2, 4, 5, 6, 7]
    assert run(Filter("v", "greaterThan", "11")) == [1]
    assert run(Filter("v", "contains", "é")) == [6]
    assert run(Filter("v", "startsWith", "a_")) == [7] and run(Filter("v", "contains", "_x")) == [] and run(Filter("v", "endsWith", "B%")) == [7]
    assert run(Filter("v", "isEmpty")) == [2, 3] and run(Filter("v", "isNotEmpty")) == [1, 4, 5, 6, 7]
    assert run(Filter("v", "notEquals", "é")) == [1, 2, 4, 5, 7]
    assert run(Not(Filter("v", "equals", "é"))) == [1, 2, 3, 4, 5, 7]
    assert run(Or((RowIds((7, 7, 1)), MatchNone()))) == [1, 7] and run(And((RowIds((1, 2)), Not(RowIds((2,)))))) == [1]
    assert run(Search("E")) == [5, 6]


@pytest.mark.parametrize("spec", [
    QuerySpec(filters=(Filter("nope", "equals", "x"),)), QuerySpec(search=" "), QuerySpec(expression=And(())), QuerySpec(expression=RowIds(())), QuerySpec(expression=RowIds((0,))),
    QuerySpec(expression=RowIds(tuple(range(1, 1002)))), QuerySpec(filters=(Filter("account", "like", "x"),)), QuerySpec(filters=(Filter("account", "equals", "é" * 2049),)),
    QuerySpec(expression=Not(Not(Not(Not(Not(Not(Not(Not(MatchNone()))))))))), QuerySpec(expression=Or((MatchNone(),) * 128)),
])
def test_bad_specs(basic, spec):
    with pytest.raises(SpecError):
        filters.where(basic, spec).count()


def test_pages_cover_all_rows_once(spark):
    df = spark.range(1, 48).selectExpr("id AS row_num", "cast(id % 5 AS string) AS v")
    for sort in (Sort(), Sort("v"), Sort("v", True), Sort(None, True)):
        spec, seen = QuerySpec(sort=sort, limit=10), []
        while True:
            found = paging.page(df, spec)
            seen += [(r["v"], r["row_num"]) for r in found.rows]
            if not found.has_more:
                break
            spec = QuerySpec(sort=sort, limit=10, cursor=found.cursor)
        assert len(seen) == len(set(seen)) == 47 == paging.count_rows(df, spec).first()["n"]
        key = (lambda x: x) if sort.column else (lambda x: x[1])
        assert seen == sorted(seen, key=key, reverse=sort.descending)


def test_pages_by_time(spark):
    df = spark.range(1, 8).selectExpr("id AS row_num")
    times = spark.createDataFrame([(1, 300), (2, 100), (4, 100), (5, 900)], "row_num long, epoch_ms long")
    order = lambda **how: [r["row_num"] for r in paging.page_by_time(df, times, **how).collect()]
    assert order(spec=QuerySpec()) == [2, 4, 1, 5, 3, 6, 7]
    assert order(spec=QuerySpec(), descending=True) == [5, 1, 4, 2, 7, 6, 3]
    assert order(spec=QuerySpec(cursor=Cursor(2, "100"))) == [4, 1, 5, 3, 6, 7] and order(spec=QuerySpec(cursor=Cursor(3))) == [6, 7]


def test_alternatives_and_reasons(basic, spark):
    alternatives = [Alternative(("alice",), (), "a"), Alternative((), (Filter("event_id", "lessThan", "250"),), "b")]
    found = filters.where(basic, filters.alternatives_to_spec(alternatives, row_ids=(5,)))
    assert ids(found) == [1, 2, 5]
    why = {r["row_num"]: r["why_matched"] for r in filters.explain_matches(found, alternatives).collect()}
    assert why[1] == ["a: contains 'alice'", "b: event_id lessThan '250'"] and why[5] == []
    more = spark.createDataFrame([(5, ["semantic 0.5: x"])], "row_num long, reasons array<string>")
    assert {r["row_num"]: r["why_matched"] for r in filters.explain_matches(found, alternatives, more).collect()}[5] == ["semantic 0.5: x"]
    assert ids(filters.where(basic, filters.alternatives_to_spec([]))) == []
    chosen = Selection(spark.createDataFrame([(4,), (4,)], "row_num long"))
    assert ids(filters.where(basic, filters.alternatives_to_spec([Alternative(("bob",))], selection=chosen))) == [2, 4]


def test_headers():
    names = [m.name for m in tables.clean_headers(["TimeGenerated", "", "Account", "Account", "1stThing", "row_num", "Weird!! Header--Name"])]
    assert names == ["timegenerated", "column_1", "account", "account_2", "c_1stthing", "row_num_2", "weird_header_name"]
    hints = [m.hint for m in tables.clean_headers(["TimeGenerated", "SrcIpAddress", "EventID", "Notes", "Runtime"])]
    assert hints == ["timestamp", "ip", "identifier", "text", "timestamp"]
    assert tables.clean_headers([" "])[0].original == "Column 1"


def test_csv_in_and_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.csv").write_text('Account,Event ID,"No, te"\nalice,1,"a ""b""\nc"\nbob,2\ncarol,3,x,extra\n')
    (tmp_path / "in" / "two.csv").write_text("Col1,Col2\n1,2\n")
    found = tables.read_log_tables(spark, str(tmp_path / "in"))
    assert sorted(found) == ["one", "two"]
    df, meta = found["one"]
    assert sorted(map(tuple, df.collect())) == [(1, "alice", "1", 'a "b"\nc'), (2, "bob", "2", ""), (3, "carol", "3", "x")]
    assert [m.original for m in meta] == ["Account", "Event ID", "No, te"]
    spec = QuerySpec(filters=(Filter("event_id", "greaterThan", "1"),), sort=Sort("account", True))
    first, second = (tables.export_csv(df, meta, spec, str(tmp_path / "out")) for _ in range(2))
    assert first != second
    again, meta2 = tables.read_log_csv(spark, first)
    assert [m.original for m in meta2] == ["Account", "Event ID", "No, te"] and sorted(r["account"] for r in again.collect()) == ["bob", "carol"]
    times = spark.createDataFrame([(1, 30), (3, 10)], "row_num long, epoch_ms long")
    assert [r[0] for r in tables.export_frame(df, meta, QuerySpec(), times, "asc").collect()] == ["carol", "alice", "bob"]
    assert [r[0] for r in tables.export_frame(df, meta, QuerySpec(), times, "desc").collect()] == ["alice", "carol", "bob"]


def test_typed_cells_as_text(spark):
    df = spark.sql("SELECT 1.0D AS a, 1.5D AS b, true AS c, timestamp'2026-01-01 02:03:04.5' AS d, date'2026-01-01' AS e, cast(null AS int) AS f, 1e16D AS g, timestamp'2026-01-01 02:03:04' AS h")
    assert tuple(tables.stringify(df).first()) == ("1", "1.5", "true", "2026-01-01T02:03:04.5", "2026-01-01T00:00:00", "", "1.0E16", "2026-01-01T02:03:04")


def test_row_numbers_and_fingerprints(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("v", F.col("id") * 2)
    numbered = tables.with_row_num(df)
    assert [(r["row_num"], r["id"]) for r in numbered.orderBy("row_num").collect()] == [(i + 1, i) for i in range(1000)]
    one = tables.fingerprint(df).first()
    assert one == tables.fingerprint(df.repartition(3)).first() != tables.fingerprint(df.filter("id <> 5")).first()
    assert tables.fingerprint(df.limit(0)).first()["digest"] == "0" and tables.with_row_num(df.limit(0)).count() == 0


def test_report_names(spark, tmp_path):
    assert tables.table_names(["General", "general", "a:b/c", "x" * 40, "x" * 40]) == ["General", "general (2)", "a b c", "x" * 31, "x" * 27 + " (2)"]
    paths = tables.write_report({"One": spark.range(3), "one": spark.range(2)}, str(tmp_path))
    assert [spark.read.parquet(p).count() for p in paths.values()] == [3, 2]


def test_timeline_and_identity(spark):
    log = spark.createDataFrame([(1, "bob"), (2, "alice"), (3, "bob"), (4, "ALICE")], "row_num long, account string")
    matches = spark.createDataFrame([(i, "TA6", "T1003.001", 95) for i in (2, 3, 4)], "row_num long, tactic_id string, technique_id string, score int")
    times = spark.createDataFrame([(2, 300, "c"), (3, 100, "a"), (4, 200, "b")], "row_num long, epoch_ms long, utc_text string")
    rows = lambda **how: [r["row_num"] for r in chains.timeline(log, matches, **how).collect()]
    assert rows(row_time=times, techniques=["T1003.001"], user=("account", "alice")) == [4, 2]
    assert rows() == [2, 3, 4] and rows(tactics=["TA1"]) == [] and rows(tactics=["TA1"], techniques=["T1003.001"]) == [2, 3, 4]
    users = spark.createDataFrame([(i, u) for i, u in enumerate(["CORP\\alice", "corp\\ALICE", "alice@x.org", "Alice", "alicea", "malice", "a lice"])], "row_num long, account string")
    got = chains.resolve_identity(users, "account", "alice").collect()
    assert [r["user"] for r in got] == ["Alice", "alice@x.org", "CORP\\alice"] and not got[0]["overflow"]
    assert [r["user"] for r in chains.resolve_identity(users, "account", "CORP\\Alice").collect()] == ["CORP\\alice"]
    assert [r["user"] for r in chains.resolve_identity(users, "account", "zed").collect()] == [None]
