import hashlib

import duckdb
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from logsift.llm.chat_format import ORACLE_SQL, PROBE, NotInGrammar, format_chats, parse, query, read_back, render

_PART = st.sampled_from(["\\", "###", "</turn>", "\n", ": ", "#", "\\###", "### user: ", "a", " ", "</turn>\n### x: ", "é"])
_TEXT = st.lists(_PART, max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(_TEXT, _TEXT), max_size=5))
@example([("user", PROBE), ("assistant", PROBE)])
def test_round_trip(turns):
    formatted, back, _ = render(turns)
    assert [x[:2] for x in parse(formatted)] == turns == [x[:2] for x in back]


def test_plain_text_is_left_alone():
    assert render([("user", "a\\b: c #1 {}"), ("assistant", "ok")]) == ("### user: a\\b: c #1 {}</turn>\n### assistant: ok</turn>\n", [("user", "a\\b: c #1 {}", 10, 22), ("assistant", "ok", 45, 47)], 0)
    for bad in ("x", "### user a</turn>\n", "### user: a", "### user: a</turn>", "### user: ### a</turn>\n"):
        with pytest.raises(NotInGrammar):
            parse(bad)


def test_query_is_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{small}/conversations.parquet'")
    expected = con.sql(ORACLE_SQL)
    assert sorted(map(tuple, query(spark, small).select(*expected.columns).collect())) == sorted(expected.fetchall())


def test_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, 5, None, "x"), (2, None, "assistant", "first"), (2, 5, "assistant", "</turn>"), (None, 0, "user", "a"), (3, 0, "assistant", "y" * 200_000), (3, 0, "assistant", "y" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'c' as formatted", "'c' as loss", "'c' as turns")
    back = {r["conv_id"]: ([tuple(t) for t in r["turns"]], r["loss_text"]) for r in read_back(format_chats(df)).collect()}
    assert back[1] == ([("user", ""), ("assistant", "")], "")
    assert back[2] == ([("assistant", "first"), ("", "x"), ("assistant", "</turn>")], "first</turn>")
    assert back[None] == ([("user", "a")], "")
    assert hashlib.md5(back[3][1].encode()).hexdigest() == hashlib.md5(b"y" * 400_000).hexdigest()
    assert format_chats(df.limit(0)).count() == 0
