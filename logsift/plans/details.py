"""Further registered queries: whole results of operators that the catalog shows in part, and what has no query there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.functions import text as tx
from logsift.operators import anomalies as an
from logsift.operators import chains as ch
from logsift.operators import documents as docs
from logsift.operators import filters, matching, rollups, timestamps
from logsift.operators.rules import Role, ignored_rows, load_rules
from logsift.plans import catalog as c
from logsift.plans.catalog import query
from logsift.sources import tables as src
from logsift.spec import And, ColumnMeta, Filter, QuerySpec, Selection, Sort

# --- views ---------------------------------------------------------------------------------------------------

_TOP = f"{c._COSINE}, {c._VEC_ROWS}, t AS (SELECT * FROM s WHERE score >= {c._LEAST} ORDER BY score DESC, doc_key LIMIT 256)"


@query("selection_filter", f"{_TOP} SELECT doc_id + 1 AS row_num, lang, source FROM documents WHERE lang = 'en' AND doc_id + 1 IN (SELECT row_num FROM r JOIN t USING (doc_key))")
def selection_filter(spark, d):
    """Rows of a vector selection within a filter."""
    rows = docs.select_rows(c.vector_top_k(spark, d), c.vec_rows(spark, d))
    spec = QuerySpec(expression=And((Selection(rows), Filter("lang", "equals", "en"))))
    return filters.where(c.docs_log(spark, d), spec).select("row_num", "lang", "source")


@query("export_sorted", "SELECT CAST(user_id AS VARCHAR) AS \"User\", event_type AS \"Type\", props AS \"User (2)\" FROM events WHERE event_type <> 'click'")
def export_sorted(spark, d):
    """An export in the view's sort; a header that comes twice is told apart."""
    meta = [ColumnMeta("user_id", "User"), ColumnMeta("event_type", "Type"), ColumnMeta("props", "User")]
    return src.export_frame(c.events_log(spark, d), meta, QuerySpec(filters=(Filter("event_type", "notEquals", "click"),), sort=Sort("event_type", True)))


# --- times ---------------------------------------------------------------------------------------------------


@query("zone_problems", """SELECT l_orderkey * 10 + l_linenumber AS row_num, strftime(l_shipdate, '%Y-%m-%d') || ' 03:30:00' AS source_text, CASE month(l_shipdate) WHEN 3 THEN 'does not exist' ELSE 'is ambiguous' END AS problem
FROM lineitem WHERE year(l_shipdate) >= 1997 AND month(l_shipdate) IN (3, 10) AND day(l_shipdate) >= 25 AND dayofweek(l_shipdate) = 0""")
def zone_problems(spark, d):
    """Half past three in Bucharest on every ship date: skipped in spring, there twice in autumn (other rules held before 1997)."""
    log = c.read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_num"), F.date_format("l_shipdate", "yyyy-MM-dd 03:30:00").alias("t"))
    return timestamps.zone_problems(log, "t", "Europe/Bucharest")


@query("time_columns_ranked", "SELECT 'ts' AS \"column\", 420.0::DOUBLE + 230 + 450 AS score WHERE (SELECT count(*) FROM events WHERE ts IS NOT NULL) > 0")
def time_columns_ranked(spark, d):
    """Which columns of the events look like times, from all their rows."""
    meta = [ColumnMeta("ts", "TimeGenerated", "timestamp"), ColumnMeta("user_id", "User"), ColumnMeta("event_type", "Type"), ColumnMeta("props", "Details")]
    log = c.events_log(spark, d)
    return spark.createDataFrame(timestamps.rank_timestamp_columns(log, meta), "column string, score double")


@query("date_samples", """WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS row_num, strftime(l_shipdate, '%m/%d/%Y') AS t FROM lineitem WHERE day(l_shipdate) <= 12)
SELECT string_agg(t, ',' ORDER BY row_num) AS ambiguous_samples FROM (SELECT * FROM a ORDER BY row_num LIMIT 5)""")
def date_samples(spark, d):
    """The first dates that can be read both ways."""
    log = c.read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_num"), F.date_format("l_shipdate", "MM/dd/yyyy").alias("t"))
    return timestamps.infer_date_convention(log, "t").select(F.array_join("ambiguous_samples", ",").alias("ambiguous_samples"))


@query("time_samples", """WITH v AS (SELECT event_id + 1 AS row_num, event_id % 4 AS k, epoch_us(ts) // 1000 AS ms, ts + INTERVAL 2 HOUR AS two FROM events),
x AS (SELECT row_num, CASE k WHEN 2 THEN 'explicit_offset' WHEN 3 THEN 'naive' ELSE 'epoch' END AS kind, CASE k WHEN 0 THEN substr(CAST(ms AS VARCHAR), 1, 10) WHEN 1 THEN CAST(ms AS VARCHAR) WHEN 2 THEN strftime(two, '%Y-%m-%dT%H:%M:%S.%g') || '+0200' ELSE strftime(two, '%Y-%m-%d %H:%M:%S.%g') END AS t FROM v)
SELECT kind, string_agg(t, ',' ORDER BY row_num) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY row_num) AS n FROM x) WHERE n <= 5 GROUP BY kind""")
def time_samples(spark, d):
    """The first five times of each kind."""
    found = timestamps.analyze_timestamps(c.mixed_times(spark, d), "t", with_samples=True)
    return found.select(F.explode("samples").alias("kind", "v")).select("kind", F.array_join("v", ",").alias("samples"))


# --- matches, chains, anomalies ------------------------------------------------------------------------------

_RULED = matching.Library(
    ({"techniqueId": "R1", "name": "Started", "tactics": [{"id": "TA1", "name": "One"}, {"id": "TA2", "name": "Two"}], "aliases": [], "keywords": []},),
    ({"id": "started", "name": "Started by a service", "techniqueId": "R1", "score": 55, "conditions": [{"headerAnyOf": ["message"], "op": "contains_any", "values": ["Started by", "opened"]}, {"role": "process_name", "op": "ends_with_any", "values": ["7.exe", "8.EXE"]}]},),
)


@query("rule_matches", c._SEC + """SELECT row_num, tactic_id, tactic_name, 'R1' AS technique_id, 'Started' AS technique_name, trim(message) AS keyword, 'message' AS column_name, 55 AS score, 'rule' AS source
FROM sec, (VALUES ('TA1', 'One'), ('TA2', 'Two')) AS t(tactic_id, tactic_name) WHERE (lower(message) LIKE '%started by%' OR lower(message) LIKE '%opened%') AND regexp_matches(process_name, '[78]\\.exe$')""")
def rule_matches(spark, d):
    """A behaviour rule of two conditions over the security log."""
    return matching.match_rules(c.security(spark, d), _RULED, c.META, c.ROLES)


@query("chains_ranked", """WITH h AS (SELECT CAST(user_id AS VARCHAR) AS host, CAST(least(100, 50 + 10 * (count(DISTINCT event_type) - 1)) AS INTEGER) AS score, CAST(count(DISTINCT event_type) AS INTEGER) AS tactic_count, count(*) AS event_count, min(event_id) + 1 AS first_row FROM events GROUP BY user_id HAVING count(DISTINCT event_type) >= 3)
SELECT CAST(row_number() OVER (ORDER BY tactic_count DESC, score DESC, event_count DESC, first_row) AS INTEGER) AS chain_id, * FROM h ORDER BY chain_id LIMIT 200""")
def chains_ranked(spark, d):
    """The 200 chains that rank first, numbered."""
    found = ch.attack_chains(c.event_matches(spark, d), c.events_log(spark, d), None, "user_id", cap=None)
    return found.select("chain_id", "host", "score", "tactic_count", "event_count", "first_row")


@query("chain_samples", """WITH h AS (SELECT CAST(user_id AS VARCHAR) AS host FROM events GROUP BY user_id HAVING count(DISTINCT event_type) >= 3),
n AS (SELECT CAST(user_id AS VARCHAR) AS host, event_id + 1 AS row_num, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
SELECT host, string_agg(CAST(row_num AS VARCHAR), ',' ORDER BY k) AS sample_rows FROM n JOIN h USING (host) WHERE k <= 50 GROUP BY host""")
def chain_samples(spark, d):
    """The first fifty rows of each chain."""
    found = ch.attack_chains(c.event_matches(spark, d), c.events_log(spark, d), None, "user_id", cap=None, keep=None)
    return found.select("host", F.array_join("sample_rows", ",").alias("sample_rows"))


_COMMANDS = ("process_name", "command_line")
_SCAN = c._CELLS.replace("WITH c AS (SELECT page_id + 1 AS row_num, url AS cell, true AS command FROM pages UNION ALL SELECT page_id + 1, html, false FROM pages),", f"{c._SEC}, kp {c._KEPT[1:]}, c AS ("  + " UNION ALL ".join(f"SELECT row_num, {m.name} AS cell, {str(m.name in _COMMANDS).lower()} AS command FROM kp" for m in c.META) + "),")
_SCAN = _SCAN.replace("  UNION ALL SELECT row_num, 'url_in_command'", "  UNION ALL SELECT row_num, 'ip_in_command', CASE WHEN (row_num - 1) % 11 IN (1, 2) THEN 35 END FROM kp\n  UNION ALL SELECT row_num, 'url_in_command'")
_NIGHT = "SELECT event_id + 1 AS row_num, hour(ts) >= 22 OR hour(ts) < 6 AS off FROM events WHERE event_id + 1 IN (SELECT row_num FROM kept)"


@query("anomaly_scan", f"""WITH kept AS ({c._SEC}, {c._KEPT} SELECT * FROM k), n AS ({_NIGHT}), counts AS (SELECT process_name, count(*) AS n FROM kept GROUP BY 1), pairs AS (SELECT account, computer, count(*) AS n FROM kept GROUP BY 1, 2), users AS (SELECT account, count(*) AS n FROM kept GROUP BY 1)
SELECT row_num, category, score FROM ({_SCAN})
UNION ALL SELECT row_num, 'rare_process', 30 FROM kept JOIN counts USING (process_name) WHERE n <= 2 AND (SELECT count(*) FROM kept) >= 100
UNION ALL SELECT row_num, 'rare_user_host', 35 FROM kept JOIN pairs USING (account, computer) JOIN users USING (account) WHERE pairs.n <= 2 AND users.n >= 5 AND (SELECT count(*) FROM kept) >= 100
UNION ALL SELECT row_num, 'off_hours', 20 FROM n WHERE off AND (SELECT count(*) FILTER (off) / count(*) FROM n) < 0.15 AND (SELECT count(*) FROM n) >= 50""")
def anomaly_scan(spark, d):
    """All detectors over the security log, ignored rows left out, no cap."""
    log = c.security(spark, d)
    found = an.scan_anomalies(log, c.META, c.ROLES, c.security_times(spark, d), ignored_rows(log, load_rules(), c.META, c.ROLES), cap=None, beginning=c.BEGINNING)
    return found.select("row_num", "category", "score")


# --- documents -----------------------------------------------------------------------------------------------


@query("informative_rows", r"SELECT doc_id + 1 AS row_num, regexp_matches(text, '(?s)\\p{L}.*\\p{L}.*\\p{L}') AS informative FROM documents".replace("\\\\", "\\"))
def informative_rows(spark, d):
    """Which texts have three letters."""
    return c.docs_log(spark, d).select("row_num", tx.informative(F.col("text")).alias("informative"))


@query("column_modes", """WITH v AS (SELECT 'user_id' AS "column", CAST(user_id AS VARCHAR) AS v, true AS dynamic FROM events UNION ALL SELECT 'event_type', event_type, false FROM events UNION ALL SELECT 'props', props, false FROM events),
s AS (SELECT "column", count(*) AS n, count(*) FILTER (dynamic) AS dyn, avg(length(v)) AS chars, avg(len(regexp_split_to_array(v, '\\s+'))) AS words, count(DISTINCT lower(v)) AS d FROM v WHERE v <> '' GROUP BY 1)
SELECT "column", CASE WHEN n >= 16 AND (dyn / n >= 0.8 OR (d / n >= 0.8 AND chars <= 128 AND words <= 3)) THEN 'exact_only' WHEN d <= 128 OR d / n <= 0.1 THEN 'categorical' ELSE 'text' END AS mode FROM s""")
def column_modes(spark, d):
    """How each column of the events is told, from all rows; the headers say nothing."""
    meta = [ColumnMeta("user_id", "Who"), ColumnMeta("event_type", "What"), ColumnMeta("props", "With")]
    return spark.createDataFrame(sorted(docs.column_modes(c.events_log(spark, d), meta, None).items()), "column string, mode string")


_STORED = "SELECT DISTINCT regexp_replace(props, '[0-9]+', '<number>', 'g') AS t FROM events"


@query("documents_incremental", """WITH r AS (SELECT 'event_type' AS column_key, 'event type: ' || event_type AS text FROM events), l AS (SELECT DISTINCT 'event_type' AS column_key, 'event type: ' || event_type AS text FROM events WHERE event_type <> 'signup')
SELECT DISTINCT column_key, text FROM r WHERE text NOT IN (SELECT text FROM l)""")
def documents_incremental(spark, d):
    """What a build adds to the documents of an earlier one: that had the events before the first signup kind was known."""
    log, meta, modes = c.events_log(spark, d), [ColumnMeta("event_type", "Event Type")], {"event_type": "text"}
    earlier, _ = docs.build_documents(log.filter("event_type <> 'signup'"), meta, modes=modes, limits=c._UNLIMITED)
    new, _ = docs.build_documents(log, meta, modes=modes, limits=c._UNLIMITED, stored=earlier)
    return new.select("column_key", "text")


@query("documents_left_out", """WITH w AS (SELECT len(list_filter(regexp_split_to_array(substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 16384), '\\s+'), lambda x: x <> '')) AS n, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 16384 AS long,
  regexp_matches(text, '(?s)\\p{L}.*\\p{L}.*\\p{L}') AS told FROM documents), k AS (SELECT long, greatest(1, ceil((n - 12) / 60))::BIGINT AS k FROM w WHERE told)
SELECT CAST(count(*) FILTER (long) AS BIGINT) AS cells_truncated, CAST(0 AS BIGINT) AS columns_omitted, CAST(sum(k - 1 - least(least(k, 4) - 1, 15)) AS BIGINT) AS chunks_omitted FROM k""")
def documents_left_out(spark, d):
    """Cells, columns and chunks beyond a row's limits."""
    return docs.left_out(c.docs_log(spark, d).select("row_num", "text"), [ColumnMeta("text", "Text")], {"text": "text"})


@query("selection_disclosed", f"""{_TOP}, n AS (SELECT (SELECT count(DISTINCT row_num) FROM r JOIN t USING (doc_key)) AS rows_selected, (SELECT count(DISTINCT row_num) FROM r) AS rows_total, (SELECT count(*) FROM s WHERE score >= {c._LEAST}) AS documents_above, (SELECT count(*) FROM t) AS documents_retained),
lo AS ({c.ORACLE["documents_left_out"]}),
b AS (SELECT *, rows_selected > 10000 OR rows_selected > 0.25 * rows_total AS broad, documents_above > documents_retained AS truncated FROM n),
told AS (SELECT concat_ws(', ', CASE WHEN cells_truncated > 0 THEN cells_truncated || ' long cells cut' END, CASE WHEN columns_omitted > 0 THEN columns_omitted || ' columns of wide rows left out' END, CASE WHEN chunks_omitted > 0 THEN chunks_omitted || ' chunks left out' END) AS parts FROM lo)
SELECT b.*, concat_ws('; ', CASE WHEN broad THEN 'the selection is broad' END, CASE WHEN truncated THEN (documents_above - documents_retained) || ' documents above the threshold are not retained' END, CASE WHEN parts <> '' THEN 'the documents are bounded: ' || parts || '; filters and searches read every row' END) AS warnings FROM b, told""")
def selection_disclosed(spark, d):
    """Whether a vector selection is broad or cut off, and what the documents of all texts leave out."""
    top = c.vector_top_k(spark, d)
    above = docs.vector_scores(c.vectors(spark, d), c._first_vector(spark, d), c._LEAST)
    table = c.vec_rows(spark, d).select("row_num").distinct()
    # this build has no limit of documents or rows
    covered = documents_left_out(spark, d).withColumns({"documents_skipped": F.lit(0), "mappings_skipped": F.lit(0)})
    found = docs.disclosure(docs.select_rows(top, c.vec_rows(spark, d)), table, above, top, covered=covered)
    return found.withColumn("warnings", F.array_join("warnings", "; "))


# --- report --------------------------------------------------------------------------------------------------


def _distinct(column: str) -> str:
    return f"SELECT arg_min({column}, (-n, {column})) AS value, CAST(sum(n) AS BIGINT) AS rows, min(first) AS first_row FROM (SELECT lower({column}) AS f, {column}, count(*) AS n, min(row_num) AS first FROM sec GROUP BY ALL) GROUP BY f"


def _together(one: str, other: str) -> str:
    return f"SELECT {one} AS value, count(*) AS rows, min(row_num) AS first_row, string_agg(DISTINCT {other}, '; ' ORDER BY {other}) AS list FROM sec GROUP BY 1"


_AGENT = "CASE WHEN user_agent LIKE '%Edg/%' THEN 'Microsoft Edge' WHEN user_agent LIKE 'Opera%' THEN 'Opera' WHEN user_agent LIKE '%Firefox/%' THEN 'Firefox' WHEN user_agent LIKE '%Chrome/%' THEN 'Chrome/Chromium' WHEN user_agent LIKE '%Version/%' THEN 'Safari' WHEN user_agent LIKE '%MSIE%' THEN 'Internet Explorer' END"


@query("report_general", c._IPS + f""", tm AS (SELECT event_id + 1 AS row_num, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS utc FROM events)
SELECT 'Table' AS section, 'rows' AS item, CAST(count(*) AS VARCHAR) AS value, '' AS detail, count(*) AS observed, min(row_num) AS row_num FROM sec
UNION ALL SELECT 'Table', 'columns', '8', '', 8, min(row_num) FROM sec
UNION ALL SELECT 'Time', 'first time', arg_min(utc, (ms, row_num)), '', count(*), arg_min(row_num, (ms, row_num)) FROM tm
UNION ALL SELECT 'Time', 'last time', arg_max(utc, (ms, row_num)), '', count(*), arg_max(row_num, (ms, row_num)) FROM tm
UNION ALL SELECT 'Users', 'user', value, '', rows, first_row FROM ({_distinct('account')})
UNION ALL SELECT 'Hosts', 'host', value, '', rows, first_row FROM ({_distinct('computer')})
UNION ALL SELECT 'Addresses', coalesce(label, CASE WHEN private THEN 'private' ELSE 'unclassified' END), ip, 'IPv4', rows, first_row FROM u WHERE label IS NOT NULL OR NOT private
UNION ALL SELECT 'Private networks', '/24', regexp_extract(ip, '^(.*)\\.[0-9]+$', 1) || '.0/24', count(*) || ' addresses', CAST(sum(rows) AS BIGINT), min(first_row) FROM u WHERE private AND label IS NULL GROUP BY 3
UNION ALL SELECT 'Browsers', 'browser', {_AGENT} AS b, '', count(*), min(row_num) FROM sec WHERE {_AGENT} IS NOT NULL GROUP BY b
UNION ALL SELECT 'Hosts of users', 'user', value, list, rows, first_row FROM ({_together('account', 'computer')})
UNION ALL SELECT 'Users of hosts', 'host', value, list, rows, first_row FROM ({_together('computer', 'account')})""")
def report_general(spark, d):
    """The table at a glance."""
    return rollups.general(c.security(spark, d), c.META, c.security_times(spark, d), c.ROLES)


@query("report_timeline", "SELECT event_id + 1 AS row_num, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS utc_text, epoch_us(ts) // 1000 AS epoch_ms, event_type AS tactic_id, event_type AS tactic_name, 'T-' || event_type AS technique_id, event_type AS technique_name, '' AS keyword, 50 AS score, 'event_type' AS column_name, event_type AS evidence, '' AS \"user\", CAST(user_id AS VARCHAR) AS host FROM events")
def report_timeline(spark, d):
    """One line a match with its evidence cell, all columns."""
    log, meta = c.events_log(spark, d), [ColumnMeta(n, n) for n in ("ts", "user_id", "event_type")]
    return rollups.timeline_table(c.event_matches(spark, d), log, meta, {"host": Role("user_id")}, c.security_times(spark, d))


@query("report_ignored", c._SEC + "SELECT row_num, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS utc_text, 'qualys-agent' AS rule_id, 'Qualys agent' AS rule_name, 'process_name' AS matched_column, process_name AS matched_value FROM sec JOIN events e ON e.event_id + 1 = row_num WHERE lower(process_name) LIKE '%qualys%'")
def report_ignored(spark, d):
    """Every suppressed row with its rule, value and time."""
    return rollups.ignored_table(ignored_rows(c.security(spark, d), load_rules(), c.META, c.ROLES), c.security_times(spark, d))
