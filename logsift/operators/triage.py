"""The whole triage of a table, its report, and what it found in words."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsift.functions.text import text, trim
from logsift.operators import activity, anomalies, chains, matching, roles, rollups, rules, timestamps
from logsift.sources.tables import with_row_num
from logsift.spec import ColumnMeta
from logsift.storage import cut, spread


@dataclass
class TriageResult:
    meta: list[ColumnMeta]
    roles: dict = field(default_factory=dict)
    row_time: DataFrame | None = None
    ignored: DataFrame | None = None
    matches: DataFrame | None = None
    chains: DataFrame | None = None
    anomalies: DataFrame | None = None
    activity: DataFrame | None = None
    steps: list[tuple[str, str, str]] = field(default_factory=list)


def triage(df: DataFrame, meta: list[ColumnMeta], library: matching.Library | None = None, ignore: list | None = None, decided: dict | None = None, row_time: DataFrame | None = None, matches: DataFrame | None = None, cap: int | None = 200_000, sample_rows: int | None = 500, keep: int | None = 200, profile_caps: tuple[int | None, int | None, int | None] = (2000, 2000, 3000), beginning: int | None = None) -> TriageResult:
    """Roles, times (where no answer is needed), ignored rows, matches and chains, anomalies, activity.

    Each step is recorded as ran, reused, skipped or failed; a failed step doesn't stop the others. What is given is reused.
    Matches are written once, since chains and most of a report read them.
    ``cap`` bounds the events of chains and the anomalies, ``sample_rows`` the rows that roles are judged from, ``keep``
    the chains, ``profile_caps`` the findings of each rarity and ``beginning`` the characters of a cell's entropy; None lifts them.
    """
    out = TriageResult(meta, dict(decided or {}))
    df = spread(df)

    def step(name: str, work, given=None):
        if given is not None:
            out.steps.append((name, "reused", ""))
            return given
        try:
            value, said = work()
        except Exception as e:  # noqa: BLE001  a step's failure is part of the result
            out.steps.append((name, "failed", str(e).split("\n")[0][:200]))
            return None
        out.steps.append((name, "skipped" if value is None else "ran", said))
        return value

    def times():
        role = out.roles.get("timestamp")
        if role is None:
            return None, "no column of times"
        found = timestamps.analyze_timestamps(df, role.column).first()
        if found["conflicting"] or found["needs_timezone"] or found["needs_date_convention"]:
            return None, "a timezone or date convention is needed"
        return timestamps.normalize_timestamps(df, role.column), role.column

    def linked():
        host = out.roles["host"].column if "host" in out.roles else None
        found = chains.attack_chains(out.matches, df, out.row_time, host, cap=cap, keep=keep)
        if keep is None:
            found = with_row_num(found, [F.desc("tactic_count"), F.desc("score"), F.desc("event_count"), "first_row"]).withColumnRenamed("row_num", "chain_id")
        return found, "by time" if out.row_time is not None else "without times"

    found = step("roles", lambda: (roles.detect_roles(df, meta, out.roles, sample_rows), ""))
    out.roles = found if found is not None else out.roles
    out.row_time = step("times", times, row_time)
    out.ignored = step("ignored", lambda: (rules.ignored_rows(df, ignore if ignore is not None else rules.load_rules(), meta, out.roles), ""))
    out.matches = step("matches", lambda: (cut(matching.scan(df, library or matching.load_library(), meta, out.roles, out.ignored)), ""), matches)
    out.chains = step("chains", lambda: linked() if out.matches is not None else (None, "no matches"))
    out.anomalies = step("anomalies", lambda: (anomalies.scan_anomalies(df, meta, out.roles, out.row_time, out.ignored, cap, profile_caps, beginning), ""))
    out.activity = step("activity", lambda: (activity.classify_activity(df, meta, out.roles, out.ignored), ""))
    return out


def report_tables(df: DataFrame, found: TriageResult, most: int | None = 500, row_cap: int | None = 1_000_000) -> dict[str, DataFrame]:
    """The report's tables by name, in order; a table is there only if its input has rows.

    ``most`` bounds a chain's events in the story, ``row_cap`` the rows of Row by Row; None lifts them.
    """
    has = lambda d: d is not None and not d.isEmpty()
    tables = {"General": rollups.general(df, found.meta, found.row_time, found.roles)}
    if has(found.ignored):
        tables["Ignored Rows"] = rollups.ignored_table(found.ignored, found.row_time)
    if has(found.activity):
        tables["Activity Summary"] = rollups.activity_table(found.activity)
    if has(found.matches):
        line = rollups.timeline_table(found.matches, df, found.meta, found.roles, found.row_time)
        tables["Timeline"] = line
        if has(found.chains):
            host = found.roles["host"].column if "host" in found.roles else None
            tables["Attack Story"] = rollups.attack_story(found.chains, found.matches, df, host, found.row_time, most)
        # as many as the library has tactics
        for tactic in found.matches.select("tactic_id", "tactic_name").distinct().orderBy("tactic_id").collect():
            tables[tactic["tactic_name"]] = rollups.tactic_table(line, tactic["tactic_id"])
    if has(found.anomalies):
        tables["Anomalies"] = rollups.anomaly_table(found.anomalies, df, found.meta, found.roles, found.row_time)
    if has(found.activity):
        tables["Row by Row"] = rollups.row_by_row(found.activity, found.matches, found.anomalies, found.row_time, row_cap)
    return tables


def dataset_profile(df: DataFrame, meta: list[ColumnMeta], by_role: dict, row_time: DataFrame | None = None, top: int = 3) -> DataFrame:
    """item, value, rows: size, roles, time span, most frequent users and hosts."""
    spark = df.sparkSession
    out = df.agg(F.lit("rows").alias("item"), F.lit("").alias("value"), F.count(F.lit(1)).alias("rows"))
    fixed = [("columns", "", len(meta))] + [(f"role {r}", x.column, None) for r, x in sorted(by_role.items())]
    out = out.union(spark.createDataFrame(fixed, "item string, value string, rows long"))
    if row_time is not None:
        span = rollups.date_range(row_time)
        out = out.union(span.select(F.lit("first time"), "first_utc", "timed_rows")).union(span.select(F.lit("last time"), "last_utc", "timed_rows"))
    for role in ("user", "host"):
        if role in by_role:
            v = trim(text(f"`{by_role[role].column}`"))
            best = df.select(v.alias("value")).filter("value <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "value").limit(top)
            out = out.union(best.select(F.lit(f"top {role}"), "value", "rows"))
    return out


#: Sections of the findings, in order.
SECTIONS = ("headline", "techniques", "chains", "anomalies", "activity")


def findings(found: TriageResult, techniques: int = 5, chains_: int = 3, anomalous: int = 5, cited: int = 3) -> DataFrame | None:
    """section, rank, size, line and cited rows: leading techniques, chains and anomalous rows, activity shares; a headline counts them.

    ``size`` is a technique's matches, a chain's or row's score, a label's rows. Each section is an aggregate or a
    first few of an order; only their lines are written, and the headline is counted from those. None if there was nothing to tell.
    """
    parts = []

    def tell(section: str, rows: DataFrame, order: list, size: str, line, cites) -> None:
        ranked = rows.withColumn("rank", F.row_number().over(W.orderBy(*order)))  # a few rows
        parts.append(ranked.select(F.lit(section).alias("section"), F.col("rank").cast("int").alias("rank"), F.col(size).cast("long").alias("size"), line.alias("line"), cites.cast("array<long>").alias("rows")))

    if found.matches is not None:
        best = matching.technique_counts(found.matches).limit(techniques)
        own = found.matches.join(F.broadcast(best.select("technique_id")), "technique_id").select("technique_id", "row_num").distinct()
        first = own.withColumn("k", F.row_number().over(W.partitionBy("technique_id").orderBy("row_num"))).filter(F.col("k") <= cited)
        rows = first.groupBy("technique_id").agg(F.array_sort(F.collect_list("row_num")).alias("first"))
        line = F.format_string("%s %s: %d matches on %d rows", "technique_id", "technique_name", "matches", "rows")
        tell("techniques", best.join(rows, "technique_id"), [F.desc("matches"), "technique_id"], "matches", line, F.col("first"))
    if found.chains is not None:
        best = found.chains.orderBy("chain_id").limit(chains_)
        line = F.format_string("%s: %s, score %d", F.coalesce("host", F.lit("(no host)")), F.array_join("tactics", ", "), "score")
        tell("chains", best, ["chain_id"], "score", line, F.slice("sample_rows", 1, cited))
    if found.anomalies is not None:
        line = F.format_string("%s (score %d)", "best_reason", "score")
        tell("anomalies", anomalies.top_rows(found.anomalies, anomalous), [F.desc("score"), "row_num"], "score", line, F.array("row_num"))
    if found.activity is not None:
        line = F.concat("label", F.lit(": "), F.col("rows").cast("string"), F.lit(" rows, "), F.col("share").cast("string"), F.lit(" %"))
        tell("activity", rollups.activity_table(found.activity), [F.desc("rows"), "category"], "rows", line, F.array())
    if not parts:
        return None
    lines = cut(reduce(DataFrame.union, parts))
    of = lambda section: F.count_if(F.col("section") == section)
    said = F.format_string("%d attack chains, %d leading techniques, %d leading anomalies", of("chains"), of("techniques"), of("anomalies"))
    headline = lines.agg(F.count(F.lit(1)).alias("size"), said.alias("line")).select(F.lit("headline").alias("section"), F.lit(1).alias("rank"), "size", "line", F.array().cast("array<long>").alias("rows"))
    return headline.union(lines)


def narrative(found: TriageResult) -> list[tuple[str, str, list[int]]]:
    """(section, line, cited rows) of the findings, a headline first; some twenty lines."""
    told = findings(found)
    if told is None:
        return [("headline", "0 attack chains, 0 leading techniques, 0 leading anomalies", [])]
    rows = sorted(told.collect(), key=lambda r: (SECTIONS.index(r["section"]), r["rank"]))
    return [(r["section"], r["line"], list(r["rows"])) for r in rows]
