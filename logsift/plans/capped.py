"""Queries that meet a cap or stop on the way: limits, pages of written views, builds in batches, many questions."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from logsift.operators import anomalies as an
from logsift.operators import chains as ch
from logsift.operators import documents as docs
from logsift.operators import laid_out, resumable, rollups, timestamps
from logsift.operators.rules import ignored_rows, load_rules
from logsift.operators.selection import first_rows, median
from logsift.plans import catalog as c
from logsift.plans import details  # noqa: F401  gives the scan's SQL
from logsift.spec import Cursor, QuerySpec, Sort
from logsift.storage import checkpoint_folder, cut, spread

query = c.query

_LATE = "category NOT IN ('rare_process', 'rare_user_host', 'off_hours')"


@query("anomalies_capped", f"SELECT row_num, category, score FROM ({c.ORACLE['anomaly_scan']}) ORDER BY {_LATE}, row_num, category LIMIT 150")
def anomalies_capped(spark, d):
    """All detectors over the security log under a cap of 150 findings."""
    log = c.security(spark, d)
    found = an.scan_anomalies(log, c.META, c.ROLES, c.security_times(spark, d), ignored_rows(log, load_rules(), c.META, c.ROLES), cap=150, profile_caps=(None, None, None), beginning=c.BEGINNING)
    return found.select("row_num", "category", "score")


@query("chains_capped", """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS host, event_id + 1 AS row_num, event_type AS kind FROM events ORDER BY event_id LIMIT 3000)
SELECT host, CAST(least(100, 50 + 10 * (count(DISTINCT kind) - 1)) AS INTEGER) AS score, CAST(count(DISTINCT kind) AS INTEGER) AS tactic_count, count(*) AS event_count, min(row_num) AS first_row, max(row_num) AS last_row FROM e GROUP BY host HAVING count(DISTINCT kind) >= 3""")
def chains_capped(spark, d):
    """Chains of the first 3000 matches."""
    found = ch.attack_chains(c.event_matches(spark, d), c.events_log(spark, d), None, "user_id", cap=3000, keep=None)
    return found.select("host", "score", "tactic_count", "event_count", "first_row", "last_row")


@query("row_by_row_capped", "SELECT event_id + 1 AS row_num, 'T-' || event_type AS techniques FROM events ORDER BY event_id LIMIT 2500")
def row_by_row_capped(spark, d):
    """The first 2500 rows of Row by Row."""
    labels = c.events_log(spark, d).select("row_num", F.lit("other").alias("category"), F.lit("").alias("detail"))
    return rollups.row_by_row(labels, c.event_matches(spark, d), None, None, cap=2500).select("row_num", "techniques")


@query("first_by_several_keys", "SELECT o_orderkey, o_orderpriority, o_custkey FROM orders ORDER BY o_orderpriority DESC, o_custkey, o_orderkey DESC LIMIT 1234")
def first_by_several_keys(spark, d):
    """The first 1234 orders by a text, descending, and two numbers."""
    orders = c.read(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    return first_rows(orders, ["-o_orderpriority", "o_custkey", "-o_orderkey"], 1234)


_RANGES = [("0.0.0.0", "127.255.255.255", "lower half"), ("10.0.0.0", "10.255.255.255", "ten"), ("10.1.2.3", "10.1.9.200", "odd stretch"), ("192.0.0.0", "255.255.255.255", "upper quarter"), ("10.1.0.0", "10.1.255.255", "ten one")]


def _number(address: str) -> int:
    return int.from_bytes(bytes(map(int, address.split("."))), "big")


@query("address_ranges", f"""WITH r(low, high, label, ord) AS (VALUES {", ".join(f"({_number(a)}, {_number(b)}, '{x}', {k})" for k, (a, b, x) in enumerate(reversed(_RANGES)))}),
p AS (SELECT CAST(10 + l_partkey % 3 * 91 AS BIGINT) AS a, CAST(l_suppkey % 3 AS BIGINT) AS b, CAST(l_orderkey % 12 AS BIGINT) AS c, CAST(l_linenumber * 35 AS BIGINT) AS d FROM lineitem),
n AS (SELECT a || '.' || b || '.' || c || '.' || d AS ip, ((a * 256 + b) * 256 + c) * 256 + d AS n, count(*) AS rows FROM p GROUP BY ALL)
SELECT ip, min_by(label, ord) AS label, rows FROM n LEFT JOIN r ON n.n BETWEEN low AND high GROUP BY ip, rows""")
def address_ranges(spark, d):
    """Addresses made of order lines by wide, nested and overlapping ranges; the first range of the file names an address."""
    parts = [10 + F.col("l_partkey") % 3 * 91, F.col("l_suppkey") % 3, F.col("l_orderkey") % 12, F.col("l_linenumber") * 35]
    log = c.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_num"), F.concat_ws(".", *[p.cast("long").cast("string") for p in parts]).alias("ip"))
    ranges = spark.createDataFrame([(_number(a), _number(b), x, k) for k, (a, b, x) in enumerate(reversed(_RANGES))], "low long, high long, label string, ord int")
    return rollups.ip_rollup(log, "ip", ranges).select("ip", "label", "rows")


_KEYED = """r AS (SELECT event_id + 1 AS row_num, 'cell' AS kind, 'event_type' AS column_key, 'event type: ' || event_type AS text FROM events
  UNION ALL SELECT event_id + 1, 'cell', 'props', 'details: ' || regexp_replace(props, '[0-9]+', '<number>', 'g') FROM events),
k AS (SELECT row_num, text, sha256(strlen(kind) || ':' || kind || strlen(column_key) || ':' || column_key || strlen(text) || ':' || text) AS doc_key FROM r),
m AS (SELECT DISTINCT doc_key, row_num, text, sha256(doc_key || ':' || row_num) AS pair FROM k)"""


@query("documents_limited", f"""WITH RECURSIVE {_KEYED}, b AS (SELECT min(event_id) + 1 AS low, max(event_id) + 1 AS high FROM events),
s AS (SELECT m.*, CAST(floor((row_num - low) * 1024 / (high - low + 1)) AS BIGINT) AS stratum FROM m, b),
d AS (SELECT stratum, n, row_number() OVER (ORDER BY n, k * 2654435761 % 4294967296) AS i, count(*) OVER () AS strata FROM (SELECT stratum, count(*) AS n, row_number() OVER (ORDER BY stratum) - 1 AS k FROM s GROUP BY 1)),
f(i, stratum, share, rest) AS (SELECT i, stratum, least(n, 3000 // strata), 3000 - least(n, 3000 // strata) FROM d WHERE i = 1
  UNION ALL SELECT d.i, d.stratum, least(n, rest // (strata - d.i + 1)), rest - least(n, rest // (strata - d.i + 1)) FROM f JOIN d ON d.i = f.i + 1),
o AS (SELECT s.*, row_number() OVER (PARTITION BY stratum ORDER BY pair) AS k FROM s)
SELECT row_num, text FROM o JOIN f USING (stratum) WHERE k <= share""")
def documents_limited(spark, d):
    """The rows that documents keep under a limit of 3000 mappings, spread evenly over the log."""
    documents, doc_rows = docs.build_documents(c.events_log(spark, d), c._DOC_META, modes=c._MODES, limits=docs.Limits(documents=None, mappings=3000))
    return doc_rows.join(documents, "doc_key").select("row_num", "text")


@query("documents_in_batches", c.ORACLE["documents_deduplicated"])
def documents_in_batches(spark, d):
    """A build in three batches that is stopped after the first and goes on."""
    folder = f"{checkpoint_folder(spark)}/documents-{uuid.uuid4().hex}"
    log = c.events_log(spark, d)
    third = log.count() // 3 + 1
    resumable.build_in_batches(log, c._DOC_META, c._MODES, folder, third, c._UNLIMITED, most=1)
    documents, doc_rows = resumable.build_in_batches(log, c._DOC_META, c._MODES, folder, third, c._UNLIMITED)
    return documents.join(doc_rows, "doc_key").groupBy("kind", "column_key", "text").agg(F.count(F.lit(1)).alias("rows"))


def _folder(spark) -> str:
    return f"{checkpoint_folder(spark)}/view-{uuid.uuid4().hex}"


@query("page_laid_out", c.ORACLE["page_after_cursor"])
def page_laid_out(spark, d):
    """The page after a cursor from a view that was written in its order."""
    folder, spec = _folder(spark), QuerySpec(sort=Sort("event_type"))
    laid_out.lay_out(c.events_log(spark, d), spec, folder, rows_per_file=500)
    return laid_out.page_of(spark, folder, replace(spec, cursor=Cursor(40, "error"))).select("row_num", "event_type")


@query("page_laid_out_by_time", """WITH t AS (SELECT event_id + 1 AS row_num, CASE WHEN event_type <> 'view' THEN epoch_us(ts) // 1000 END AS epoch_ms FROM events), m AS (SELECT CAST(median(epoch_ms) AS BIGINT) AS mid FROM t)
SELECT row_num, epoch_ms FROM t, m WHERE epoch_ms IS NULL OR epoch_ms < mid ORDER BY epoch_ms DESC NULLS LAST, row_num DESC LIMIT 201""")
def page_laid_out_by_time(spark, d):
    """A page from the middle of a log that was written newest first."""
    folder, log = _folder(spark), c.events_log(spark, d)
    source = spread(log.filter("event_type <> 'view'").select("row_num", F.concat("ts", F.lit("Z")).alias("ts")))
    times = cut(timestamps.normalize_timestamps(source, "ts").select("row_num", "epoch_ms"))
    laid_out.lay_out_by_time(log, times, QuerySpec(), folder, descending=True, rows_per_file=500)
    at = median(times, F.col("epoch_ms"))
    cursor = None if at is None else Cursor(0, str(round(at)))
    return laid_out.page_of_times(spark, folder, QuerySpec(cursor=cursor), descending=True).select("row_num", "epoch_ms")


@query("vectors_many", f"""WITH q AS (SELECT vec_id AS question, embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 100),
s AS (SELECT question, vec_id AS doc_key, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q)
SELECT question, doc_key, score FROM s WHERE score >= {c._LEAST} QUALIFY row_number() OVER (PARTITION BY question ORDER BY score DESC, doc_key) <= 20""")
def vectors_many(spark, d):
    """The 20 nearest vectors to each of the first hundred, in one scan."""
    vectors = c.vectors(spark, d)
    questions = vectors.orderBy("doc_key").limit(100).select(F.col("doc_key").alias("question"), "embedding")
    return docs.vectors_top_k(vectors, questions, 20, c._LEAST)
