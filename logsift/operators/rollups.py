"""Roll-ups of a log table and the tables of a report."""

from __future__ import annotations

import heapq
import ipaddress
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.functions.text import ascii_lower, text, trim
from logsift.functions.values import ipv4_number, parse_ip, private_ipv4
from logsift.operators import activity as act
from logsift.operators.chains import HOUR
from logsift.operators.rules import Role
from logsift.operators.selection import first_rows
from logsift.sources.tables import with_row_num
from logsift.spec import ColumnMeta
from logsift.storage import cut


def date_range(row_time: DataFrame) -> DataFrame:
    """One row: the first and last time and their rows."""
    at = F.struct("epoch_ms", "row_num")
    return row_time.agg(F.count(F.lit(1)).alias("timed_rows"), F.min_by(F.struct("row_num", "utc_text"), at).alias("a"), F.max_by(F.struct("row_num", "utc_text"), at).alias("b")).select("timed_rows", F.col("a.row_num").alias("first_row"), F.col("a.utc_text").alias("first_utc"), F.col("b.row_num").alias("last_row"), F.col("b.utc_text").alias("last_utc"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """value, rows, first_row: case-folded distinct values under their most frequent spelling (the smallest on ties)."""
    cells = df.select("row_num", trim(text(f"`{column}`")).alias("v")).filter("v <> ''")
    spelled = cells.groupBy(F.lower("v").alias("folded"), "v").agg(F.count(F.lit(1)).alias("n"), F.min("row_num").alias("first"))
    return spelled.groupBy("folded").agg(F.min_by("v", F.struct(-F.col("n"), "v")).alias("value"), F.sum("n").alias("rows"), F.min("first").alias("first_row")).select("value", "rows", "first_row")


def ip_text(c: Column) -> Column:
    """The address of a value without quotes, brackets and port, in lower case."""
    return F.lower(parse_ip(F.regexp_replace(trim(c), r"""^["'\[\]]+|["'\[\]]+$""", "")))


def _value(c: Column) -> Column:
    """A column as a generated row of one, so that it is worked out once, whatever reads it later."""
    return F.explode(F.array(c))


@F.pandas_udf(T.StringType())
def ipv6_text(values: pd.Series) -> pd.Series:
    """IPv6 addresses in their one canonical spelling."""
    return values.map(lambda v: str(ipaddress.ip_address(v)))


def _counted(df: DataFrame, column: str) -> DataFrame:
    """ip, rows, first_row of a column's addresses.

    Cells are counted first, so each different one is parsed once, in a step of its own; then each different spelling is
    counted before IPv6 is brought to one.
    """
    counts = lambda d, n, first: d.groupBy("ip").agg(n.alias("rows"), F.min(first).alias("first_row"))
    raw = counts(df.select("row_num", text(f"`{column}`").alias("ip")), F.count(F.lit(1)), "row_num")
    parsed = raw.select(_value(ip_text(F.col("ip"))).alias("ip"), "rows", "first_row")
    spelled = counts(parsed.filter("ip is not null"), F.sum("rows"), "first_row")
    six = spelled.filter(F.col("ip").contains(":")).withColumn("ip", ipv6_text("ip"))
    return counts(spelled.filter(~F.col("ip").contains(":")).unionByName(six), F.sum("rows"), "first_row")


def cidr_ranges(spark: SparkSession, path: str | None = None) -> DataFrame:
    """low, high, label, ord of the known address ranges, in file order."""
    lines = Path(path or Path(__file__).parent.parent / "resources" / "cidr_ranges.txt").read_text().splitlines()
    rows = []
    for line in lines:
        if line.strip() and not line.startswith("#"):
            net = ipaddress.ip_network(line.split("\t")[0], strict=False)
            rows.append((int(net.network_address), int(net.broadcast_address), line.split("\t")[1], len(rows)))
    return spark.createDataFrame(rows, "low long, high long, label string, ord int")


#: Up to so many ranges are swept into disjoint segments on the driver; more stay as they are.
SWEPT = 100_000


def disjoint(ranges: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """(low, high, label, ord) that don't overlap: each stretch has the range that comes first in the file.

    A sweep over the ends of the ranges with a heap of those that are open, the first of the file on top.
    """
    ends = sorted({x for low, high, _, _ in ranges for x in (low, high + 1)})
    waiting, open_, out, k = sorted(ranges), [], [], 0
    for low, after in zip(ends, ends[1:]):
        while k < len(waiting) and waiting[k][0] <= low:
            heapq.heappush(open_, (waiting[k][3], waiting[k][1], waiting[k][2]))
            k += 1
        while open_ and open_[0][1] < low:
            heapq.heappop(open_)
        if open_:
            ord_, _, label = open_[0]
            if out and out[-1][3] == ord_ and out[-1][1] == low - 1:
                out[-1] = (out[-1][0], after - 1, label, ord_)
            else:
                out.append((low, after - 1, label, ord_))
    return out


def _blocks(low: int, high: int) -> list[tuple[int, int]]:
    """A range as (bits, number) of aligned blocks of 2**bits addresses: 62 at most, however wide it is."""
    out = []
    while low <= high:
        bits = min((low & -low).bit_length() - 1 if low else 32, (high - low + 1).bit_length() - 1)
        out.append((bits, low >> bits))
        low += 1 << bits
    return out


@F.udf(T.ArrayType(T.StructType([T.StructField("bits", T.IntegerType()), T.StructField("block", T.LongType())])))
def _block_udf(low, high):
    return _blocks(low, high)


def address_blocks(ranges: DataFrame) -> DataFrame:
    """bits, block, label, ord: known ranges as aligned blocks; disjoint ones where there are few enough to sweep."""
    rows = ranges.select("low", "high", "label", "ord").limit(SWEPT + 1).collect()
    if len(rows) <= SWEPT:
        cells = [(bits, block, label, ord_) for low, high, label, ord_ in disjoint([tuple(r) for r in rows]) for bits, block in _blocks(low, high)]
        return ranges.sparkSession.createDataFrame(cells, "bits int, block long, label string, ord int")
    return ranges.select(F.explode(_block_udf("low", "high")).alias("b"), "label", "ord").select("b.bits", "b.block", "label", "ord")


def ip_rollup(df: DataFrame, column: str, ranges: DataFrame) -> DataFrame:
    """ip, version, label, private, rows, first_row: one row an address.

    Addresses are counted first; only the distinct ones meet the ranges. Overlapping ranges are swept into disjoint
    segments, each with the label that comes first in the file, and segments are cut into aligned blocks. An
    address looks its blocks up, one for each size of block that there is (33 at most), so a wide range costs no
    more than a narrow one and the join has a key; Spark broadcasts the blocks only while they are small.
    """
    blocks = cut(address_blocks(ranges))
    sizes = sorted(r[0] for r in blocks.select("bits").distinct().collect())
    counted = _counted(df, column).select("ip", "rows", "first_row", _value(ipv4_number(F.col("ip"))).alias("n"))
    keys = F.transform(F.array(*[F.lit(b) for b in sizes]) if sizes else F.array().cast("array<int>"), lambda b: F.struct(b.alias("bits"), F.floor(F.col("n") / F.pow(F.lit(2), b)).cast("long").alias("block")))
    asked = counted.filter("n is not null").select("n", F.explode(keys).alias("k")).select("n", "k.bits", "k.block")
    label = asked.join(blocks, ["bits", "block"]).groupBy("n").agg(F.min_by("label", "ord").alias("label"))
    known = counted.join(label, "n", "left")
    return known.select("ip", F.when(F.col("n").isNull(), 6).otherwise(4).alias("version"), "label", F.coalesce(private_ipv4(F.col("n")), F.lit(False)).alias("private"), "rows", "first_row")


def private_groups(rollup: DataFrame) -> DataFrame:
    """network, addresses, rows: unlabelled private addresses by their /24."""
    own = rollup.filter("private and label is null and version = 4")
    return own.groupBy(F.concat(F.regexp_extract("ip", r"^(.*)\.[0-9]+$", 1), F.lit(".0/24")).alias("network")).agg(F.count(F.lit(1)).alias("addresses"), F.sum("rows").alias("rows"), F.min("first_row").alias("first_row"))


def browser(c: Column) -> Column:
    """The browser family of a user agent, null if unknown."""
    low = ascii_lower(c)
    return (
        F.when(low.rlike("edg/|edge/"), "Microsoft Edge").when(low.rlike("opr/|opera"), "Opera").when(low.contains("firefox/"), "Firefox").when(low.rlike("chrome/|chromium/"), "Chrome/Chromium")
        .when(low.contains("safari/") & low.contains("version/"), "Safari").when(low.rlike("msie |trident/"), "Internet Explorer")
    )


def user_agent_column(meta: list[ColumnMeta]) -> str | None:
    compact = lambda m: "".join(c for c in (m.name + m.original).lower() if c.isalnum())
    return next((m.name for m in meta if "useragent" in compact(m) or "browser" in compact(m)), None)


def browsers(df: DataFrame, column: str) -> DataFrame:
    rows = df.select("row_num", browser(text(f"`{column}`")).alias("browser")).filter("browser is not null")
    return rows.groupBy("browser").agg(F.count(F.lit(1)).alias("rows"), F.min("row_num").alias("first_row")).orderBy(F.desc("rows"), "browser")


def associations(df: DataFrame, one: str, other: str, most: int = 30_000) -> DataFrame:
    """value, rows, first_row, others, other_list for each value of ``one``: what it stands with in ``other``.

    The list is sorted, with "; " between, and ends before it is longer than ``most`` bytes; then it says how many
    more there are. Pairs are counted first. An entry of the list is also within ``most`` bytes among those of its
    hash group, so a value's partners are cut down in 64 groups before they meet.
    """
    rows = df.select("row_num", trim(text(f"`{one}`")).alias("value"), trim(text(f"`{other}`")).alias("o")).filter("value <> ''")
    pairs = rows.groupBy("value", "o").agg(F.count(F.lit(1)).alias("n"), F.min("row_num").alias("first"))
    totals = pairs.groupBy("value").agg(F.sum("n").alias("rows"), F.min("first").alias("first_row"), F.count_if(F.col("o") != "").alias("others"))
    size = F.octet_length("o") + 2
    upto = lambda *by: F.sum(size).over(W.partitionBy(*by).orderBy("o").rowsBetween(W.unboundedPreceding, 0)) - 2
    few = pairs.filter("o <> ''").withColumn("deal", F.pmod(F.xxhash64("o"), F.lit(64)))
    few = few.filter(F.octet_length("o") <= most).withColumn("end", upto("value", "deal")).filter(F.col("end") <= most)
    # one that is too long by itself ends the list, too
    long = pairs.filter(F.octet_length("o") > most).groupBy("value").agg(F.min("o").alias("stop"))
    shown = few.join(long, "value", "left").filter("stop is null or o < stop").withColumn("end", upto("value")).filter(F.col("end") <= most)
    lists = shown.groupBy("value").agg(F.array_sort(F.collect_list("o")).alias("all"))
    told = totals.join(lists, "value", "left").withColumn("all", F.coalesce("all", F.array().cast("array<string>")))
    more = F.col("others") - F.size("all")
    line = F.concat(F.array_join("all", "; "), F.when(more > 0, F.concat(F.when(F.size("all") > 0, "; ").otherwise(""), F.lit("... (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))
    return told.select("value", "rows", "first_row", "others", line.alias("other_list"))


def cells(columns: list[str]) -> Column:
    """A row's cells by column name."""
    return F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[text(f"`{c}`") for c in columns]))


def pick(of: str = "_cells", name: str = "column_name") -> Column:
    """The value of the column that a row names, '' if it names none."""
    return F.coalesce(F.element_at(F.col(of), F.col(name)), F.lit(""))


def _context(df: DataFrame, row_time: DataFrame | None, roles: dict[str, Role], meta: list[ColumnMeta]) -> DataFrame:
    """What a report line tells of its row, under names that no log column has."""
    own = {r: text(f"`{roles[r].column}`") if r in roles else F.lit("") for r in ("user", "host")}
    rows = df.select("row_num", cells([m.name for m in meta]).alias("_cells"), own["user"].alias("_user"), own["host"].alias("_host"))
    if row_time is None:
        return rows.withColumns({"epoch_ms": F.lit(None).cast("long"), "utc_text": F.lit(None).cast("string")})
    return rows.join(row_time.select("row_num", "epoch_ms", "utc_text"), "row_num", "left")


def timeline_table(matches: DataFrame, df: DataFrame, meta: list[ColumnMeta], roles: dict[str, Role], row_time: DataFrame | None) -> DataFrame:
    """One line a match, with time, evidence cell, user and host, in time order."""
    joined = matches.join(_context(df, row_time, roles, meta), "row_num")
    out = joined.select("row_num", "utc_text", "epoch_ms", "tactic_id", "tactic_name", "technique_id", "technique_name", "keyword", "score", "column_name", pick().alias("evidence"), F.col("_user").alias("user"), F.col("_host").alias("host"))
    return out.orderBy(F.col("epoch_ms").asc_nulls_last(), "row_num", "tactic_id", "technique_id", "keyword")


def attack_story(chains: DataFrame, matches: DataFrame, df: DataFrame, host: str | None, row_time: DataFrame | None, most: int | None = 500) -> DataFrame:
    """A summary line for each chain (seq 0), then at most ``most`` of its events in order (None: all).

    Chains with times and matches meet on the host and the hour, then by time; those without times have a host's rows
    each. All events of a chain are numbered by one sort of all chains, not chain by chain.
    """
    name = F.coalesce(F.concat(F.lit("="), trim(F.col(f"`{host}`").cast("string"))), F.lit("")) if host else F.lit("")
    rows = matches.join(df.select("row_num", name.alias("_host")), "row_num")
    rows = rows.join(row_time.select("row_num", "epoch_ms", "utc_text"), "row_num", "left") if row_time is not None else rows.withColumns({"epoch_ms": F.lit(None).cast("long"), "utc_text": F.lit(None).cast("string")})
    c = chains.select("chain_id", F.coalesce(F.concat(F.lit("="), "host"), F.lit("")).alias("_host"), "first_epoch_ms", "last_epoch_ms", "first_row", "last_row")
    hour = lambda x: F.floor(F.col(x) / HOUR).cast("long")
    by_row = rows.join(c.filter("first_epoch_ms is null"), "_host").filter(F.col("row_num").between(F.col("first_row"), F.col("last_row")))
    inside = by_row.select("chain_id", *rows.columns)
    if row_time is not None:
        sliced = c.filter("first_epoch_ms is not null").withColumn("_hour", F.explode(F.sequence(hour("first_epoch_ms"), hour("last_epoch_ms"))))
        by_time = rows.withColumn("_hour", hour("epoch_ms")).join(sliced, ["_host", "_hour"]).filter(F.col("epoch_ms").between(F.col("first_epoch_ms"), F.col("last_epoch_ms")))
        inside = inside.unionByName(by_time.select("chain_id", *rows.columns))
    order = [F.col("epoch_ms").asc_nulls_last(), "row_num", "tactic_id", "technique_id", "keyword"]
    if most:
        events = inside.withColumn("seq", F.row_number().over(W.partitionBy("chain_id").orderBy(*order))).filter(F.col("seq") <= most)
    else:
        numbered = with_row_num(inside.withColumnRenamed("row_num", "_row"), ["chain_id", order[0], "_row", *order[2:]])
        start = numbered.groupBy("chain_id").agg(F.min("row_num").alias("_start"))
        events = numbered.join(start, "chain_id").withColumn("seq", (F.col("row_num") - F.col("_start") + 1).cast("int")).drop("row_num").withColumnRenamed("_row", "row_num")
    line = F.concat(F.coalesce("host", F.lit("(no host)")), F.lit(": "), F.array_join("tactics", " > "), F.lit(", score "), F.col("score").cast("string"), F.lit(", "), F.col("event_count").cast("string"), F.lit(" events"))
    head = chains.select("chain_id", F.lit(0).alias("seq"), "first_row", line.alias("story"))
    told = events.select("chain_id", "seq", F.col("row_num").alias("first_row"), F.concat_ws(" ", "utc_text", "tactic_id", "technique_id", "technique_name", "keyword").alias("story"))
    return head.unionByName(told).withColumnRenamed("first_row", "row_num").orderBy("chain_id", "seq")


def anomaly_table(findings: DataFrame, df: DataFrame, meta: list[ColumnMeta], roles: dict[str, Role], row_time: DataFrame | None) -> DataFrame:
    joined = findings.join(_context(df, row_time, roles, meta), "row_num")
    return joined.select("row_num", "utc_text", "category", "score", "reason", "column_name", pick().alias("evidence")).orderBy(F.desc("score"), "row_num", "category")


def ignored_table(ignored: DataFrame, row_time: DataFrame | None) -> DataFrame:
    rows = ignored.join(row_time.select("row_num", "utc_text"), "row_num", "left") if row_time is not None else ignored.withColumn("utc_text", F.lit(None).cast("string"))
    return rows.select("row_num", "utc_text", "rule_id", "rule_name", "matched_column", "matched_value").orderBy("row_num")


def activity_table(activity: DataFrame) -> DataFrame:
    """category, label, rows, share (percent, one decimal), top_details as text."""
    summary = act.activity_summary(activity)
    total = activity.agg(F.count(F.lit(1)).alias("_all"))
    details = F.array_join(F.transform("top_details", lambda x: F.concat(x["detail"], F.lit(" ("), x["rows"].cast("string"), F.lit(")"))), "; ")
    return summary.join(F.broadcast(total)).select("category", "label", "rows", F.round(100 * F.col("rows") / F.col("_all"), 1).alias("share"), F.coalesce(details, F.lit("")).alias("top_details")).orderBy(F.desc("rows"), "category")


def row_by_row(activity: DataFrame, matches: DataFrame | None, findings: DataFrame | None, row_time: DataFrame | None, cap: int | None = 1_000_000) -> DataFrame:
    """Every labelled row with its time, distinct techniques and anomaly categories: each side is grouped before the join."""
    out = first_rows(activity, ["row_num"], cap)
    if row_time is not None:
        out = out.join(row_time.select("row_num", "utc_text"), "row_num", "left")
    for part, column, name in ((matches, "technique_id", "techniques"), (findings, "category", "anomalies")):
        if part is None:
            out = out.withColumn(name, F.lit(""))
        else:
            grouped = part.groupBy("row_num").agg(F.array_join(F.array_sort(F.collect_set(column)), ", ").alias(name))
            out = out.join(grouped, "row_num", "left").withColumn(name, F.coalesce(name, F.lit("")))
    return out.orderBy("row_num") if cap else out


def tactic_table(timeline: DataFrame, tactic_id: str) -> DataFrame:
    return timeline.filter(F.col("tactic_id") == tactic_id)


def general(df: DataFrame, meta: list[ColumnMeta], row_time: DataFrame | None, by_role: dict[str, Role] | None = None, ranges: DataFrame | None = None) -> DataFrame:
    """section, item, value, detail, observed, row_num: the table at a glance.

    Size and time span; users and hosts; addresses by the range that holds them, unlabelled private ones by their
    /24; browsers; which users and hosts stand together. A section is there if its column is known.
    """
    by_role = by_role or {}
    column = lambda role: by_role[role].column if role in by_role else None
    none = F.lit(None).cast("long")

    def lines(found: DataFrame, section: str, item: Column, value: Column, detail: Column, observed: Column, row: Column) -> DataFrame:
        as_text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
        return found.select(F.lit(section).alias("section"), as_text(item).alias("item"), as_text(value).alias("value"), as_text(detail).alias("detail"), observed.cast("long").alias("observed"), row.cast("long").alias("row_num"))

    c, word = F.col, F.lit
    size = df.agg(F.count(F.lit(1)).alias("n"), F.min("row_num").alias("first"))
    parts = [lines(size, "Table", word("rows"), c("n"), word(""), c("n"), c("first")), lines(size, "Table", word("columns"), word(str(len(meta))), word(""), word(len(meta)), c("first"))]
    if row_time is not None:
        span = date_range(row_time)
        parts += [lines(span, "Time", word("first time"), c("first_utc"), word(""), c("timed_rows"), c("first_row")), lines(span, "Time", word("last time"), c("last_utc"), word(""), c("timed_rows"), c("last_row"))]
    for role, section in (("user", "Users"), ("host", "Hosts")):
        if column(role):
            parts.append(lines(distinct_values(df, column(role)), section, word(role), c("value"), word(""), c("rows"), c("first_row")))
    if column("ip"):
        found = ip_rollup(df, column("ip"), ranges if ranges is not None else cidr_ranges(df.sparkSession))
        kind = F.coalesce("label", F.when(c("private"), "private").otherwise("unclassified"))
        parts.append(lines(found.filter("label is not null or not private or version = 6"), "Addresses", kind, c("ip"), F.concat(word("IPv"), c("version").cast("string")), c("rows"), c("first_row")))
        parts.append(lines(private_groups(found), "Private networks", word("/24"), c("network"), F.concat(c("addresses").cast("string"), word(" addresses")), c("rows"), c("first_row")))
    if agent := user_agent_column(meta):
        parts.append(lines(browsers(df, agent), "Browsers", word("browser"), c("browser"), word(""), c("rows"), c("first_row")))
    if column("user") and column("host"):
        for one, other, section in (("user", "host", "Hosts of users"), ("host", "user", "Users of hosts")):
            parts.append(lines(associations(df, column(one), column(other)), section, word(one), c("value"), c("other_list"), c("rows"), c("first_row")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
