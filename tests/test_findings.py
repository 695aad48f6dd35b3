"""Roles and findings as results of plans."""

from logsift.operators import roles, triage
from logsift.spec import ColumnMeta


def _scores(spark, *rows):
    return spark.createDataFrame([(r, i, c, j, s, 1, []) for r, i, c, j, s in rows], "role string, role_at int, column string, column_at int, score double, total long, reasons array<string>")


def _greedy(rows):
    taken = {}
    for r, _, c, _, s in sorted(rows, key=lambda x: (-x[4], x[1], x[3])):
        if r not in taken and c not in taken.values():
            taken[r] = c
    return taken


def test_the_strongest_remaining_pair_takes_its_role_and_column(spark):
    import random

    rng = random.Random(4)
    for _ in range(5):
        rows = [(f"r{i}", i, f"c{j}", j, rng.choice([0.3, 0.4, 0.5, 0.5])) for i in range(8) for j in range(9) if rng.random() < 0.6]
        got = {r["role"]: r["column"] for r in roles.assigned(_scores(spark, *rows)).collect()}
        assert got == _greedy(rows)


def test_ties_go_to_the_first_role_and_then_the_first_column(spark):
    rows = [("b", 1, "x", 0, 0.5), ("a", 0, "y", 1, 0.5), ("a", 0, "x", 0, 0.5), ("b", 1, "y", 1, 1.4)]
    assert [tuple(r)[:3] for r in roles.assigned(_scores(spark, *rows[:3])).collect()] == [("a", "x", 0.5)]
    assert {r["role"]: (r["column"], r["confidence"]) for r in roles.assigned(_scores(spark, *rows)).collect()} == {"b": ("y", 1.0), "a": ("x", 0.5)}
    assert roles.assigned(_scores(spark)).count() == 0


def test_scores_of_columns_without_a_value_come_from_the_header(spark):
    df = spark.createDataFrame([(1, None, " ", "10.0.0.1"), (2, None, "", "x")], "row_num long, user_name string, browser_user string, ip string")
    meta = [ColumnMeta("user_name", "UserName"), ColumnMeta("browser_user", "Browser User"), ColumnMeta("ip", "ip")]
    got = {(r["role"], r["column"]): (round(r["score"], 6), r["total"], r["reasons"]) for r in roles.role_scores(df, meta, None).collect()}
    assert got[("user", "user_name")] == (0.45, 0, ["header has 'username'"])
    assert ("user", "browser_user") not in got  # ruled out by its header
    assert got[("ip", "ip")] == (round(0.42 + 0.5 * 0.45, 6), 2, ["header has the word 'ip'", "1 of 2 values look like ip"])
    assert roles.role_scores(df.limit(0), meta, None).count() == len({c for _, c in got})
    assert roles.detect_roles(df.select("row_num"), []) == {}


def test_findings_are_ranked_in_each_section_and_counted_in_the_headline(spark):
    matches = spark.createDataFrame([(i, "t", "Tactic", f"k{i % 7}", f"Technique {i % 7}", "w", 40, "cell", "keyword") for i in range(1, 100)], "row_num long, tactic_id string, tactic_name string, technique_id string, technique_name string, keyword string, score int, column_name string, source string")
    rows = triage.findings(triage.TriageResult([], matches=matches)).collect()
    told = [r for r in rows if r["section"] == "techniques"]
    assert [(r["rank"], r["size"], r["rows"]) for r in sorted(told, key=lambda r: r["rank"])] == [(1, 15, [1, 8, 15]), (2, 14, [7, 14, 21]), (3, 14, [2, 9, 16]), (4, 14, [3, 10, 17]), (5, 14, [4, 11, 18])]
    assert [(r["size"], r["line"]) for r in rows if r["section"] == "headline"] == [(5, "0 attack chains, 5 leading techniques, 0 leading anomalies")]
    assert triage.findings(triage.TriageResult([])) is None
    assert triage.narrative(triage.TriageResult([])) == [("headline", "0 attack chains, 0 leading techniques, 0 leading anomalies", [])]
