"""Anomaly heuristics over cells, rarities over the whole table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.functions.patterns import OCTET
from logsift.functions.text import clip, text, trim
from logsift.functions.values import ipv4_number, private_ipv4
from logsift.operators.matching import any_of
from logsift.operators.rules import Role, suppress
from logsift.operators.selection import first_rows
from logsift.spec import ColumnMeta
from logsift.storage import spread

# Programs of the system that are often abused, kinds of files, staging folders.
LOLBINS = ("certutil", "bitsadmin", "mshta", "regsvr32", "rundll32", "wmic", "cscript", "wscript", "installutil", "msbuild", "forfiles", "pcalua", "esentutl", "extrac32", "makecab", "curl", "ftp", "tftp", "certreq", "regasm", "regsvcs", "odbcconf")
EXECUTABLE = ("exe", "dll", "scr", "bat", "cmd", "ps1", "vbs", "js", "hta", "msi")
DOCUMENT = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "jpg", "jpeg", "png", "zip")
STAGING = ("\\users\\public\\", "\\appdata\\local\\temp\\", "\\windows\\temp\\", "%temp%", "\\programdata\\", "/tmp/", "\\downloads\\")


@F.pandas_udf(T.DoubleType())
def _entropy(texts: pd.Series) -> pd.Series:
    def bits(x: bytes) -> float:
        n = np.bincount(np.frombuffer(x.decode(errors="replace").encode("utf-32-le"), "<u4"))
        share = n[n > 0] / max(n.sum(), 1)
        return 0.0 - float((share * np.log2(share)).sum())

    return texts.map(bits, na_action="ignore").astype("float64")


def entropy(c: Column) -> Column:
    """Shannon entropy in bits of the characters, which are counted in one pass."""
    return _entropy(c.cast("binary"))


def first_ipv4(c: Column) -> Column:
    """The first address that touches no further digit or dot, without leading zeros; null if there is none."""
    found = F.regexp_extract(c, rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9.])", 0)
    return F.when(found != "", F.regexp_replace(found, r"(^|\.)0+(?=[0-9])", "$1"))


#: A folded cell without any of this, and of fewer bytes, has no finding.
_ANY = any_of(["-enc", "frombase64string", "http://", "https://", *LOLBINS, *STAGING]) + rf"|[a-z0-9+/=]{{60}}|[0-9]\.[0-9]|\.(?:{'|'.join(DOCUMENT)})\.(?:{'|'.join(EXECUTABLE)})"
_LONG = 100


def _derived(rows: DataFrame, beginning: int | None) -> DataFrame:
    """Add what several findings need, one step after the other, so that nothing is computed twice."""
    cell = F.col("cell")
    measured = F.substring(cell, 1, beginning) if beginning else cell
    stretches = F.regexp_extract_all(cell, F.lit("[A-Za-z0-9+/=]{60,}"), F.lit(0))
    rows = rows.withColumns({
        "longest": F.aggregate(stretches, F.lit(""), lambda a, x: F.when(F.char_length(x) > F.char_length(a), x).otherwise(a)),
        "ip": F.when(F.col("command"), first_ipv4(cell)), "bits": entropy(F.when(F.octet_length(cell) >= _LONG, measured)), "shown": clip(cell, 60),
    })
    rows = rows.withColumn("words", F.filter(F.split("low", r"[^a-z0-9._-]+"), lambda t: t != ""))
    return rows.withColumns({
        "bare": F.get(F.filter(F.transform("words", lambda t: F.regexp_replace(t, r"\.exe$", "")), lambda t: t.isin(*LOLBINS)), F.lit(0)),
        "double": F.get(F.filter("words", lambda t: t.rlike(rf"\.(?:{'|'.join(DOCUMENT)})\.(?:{'|'.join(EXECUTABLE)})$")), F.lit(0)),
    })


def _findings() -> Column:
    """Array of (category, score, reason) of one cell, from the columns of ``_derived``."""
    c = F.col
    low, command, header, shown = c("low"), c("command"), c("header"), c("shown")
    finding = lambda category, score, *reason: F.struct(F.lit(category).alias("category"), F.lit(score).alias("score"), F.concat(*[F.lit(r) if isinstance(r, str) else r for r in reason]).alias("reason"))
    encoded = low.contains("-encodedcommand") | low.contains("-enc ") | low.contains("frombase64string")
    blob = c("longest").rlike("[A-Z]") & c("longest").rlike("[a-z]") & c("longest").rlike("[0-9]")
    staged = low.rlike("|".join(f.replace("\\", "\\\\") for f in STAGING)) & low.rlike(rf"\.(?:{'|'.join(EXECUTABLE)})")
    return F.array_compact(F.array(
        F.when(encoded, finding("encoded_blob", 75, "switch or call for an encoded command in '", header, "': ", shown))
        .when(blob, finding("encoded_blob", 70, F.char_length("longest").cast("string"), " characters that look like base64 in '", header, "': ", clip(c("longest"), 60))),
        F.when(c("bare").isNotNull(), finding("lolbin", 45, "often abused system program '", c("bare"), "' in '", header, "'")),
        F.when(staged, finding("suspicious_path", 45, "program file in a folder for temporary or shared files in '", header, "': ", shown)),
        F.when(c("double").isNotNull(), finding("double_extension", 65, "program that is named like a document '", c("double"), "' in '", header, "'")),
        F.when(c("ip").isNotNull(), finding("ip_in_command", 35, F.when(private_ipv4(ipv4_number(c("ip"))), "private").otherwise("public"), " address ", c("ip"), " in the command of '", header, "'")),
        F.when(command & (low.contains("http://") | low.contains("https://")), finding("url_in_command", 40, "web address in '", header, "': ", shown)),
        F.when(command & (F.octet_length("cell") >= 400), finding("long_command", 30, F.octet_length("cell").cast("string"), " bytes of command in '", header, "'")),
        F.when(c("bits") >= 5.0, finding("high_entropy", 40, "text close to random (", F.format_string("%.1f", c("bits")), " bits a character) in '", header, "': ", shown)),
    ))


def cell_findings(df: DataFrame, meta: list[ColumnMeta], roles: dict[str, Role], beginning: int | None = None) -> DataFrame:
    """The best finding of each row and category over all columns but the time; ties go to the earlier column.

    Cells and findings are exploded within their row; only the findings, which are few, are shuffled. ``beginning``: how
    many characters of a cell its entropy is taken from; all without.
    """
    commands = {roles[r].column for r in ("command_line", "process_name") if r in roles}
    time = roles["timestamp"].column if "timestamp" in roles else None
    cells = [F.struct(F.lit(i).alias("i"), F.lit(m.name).alias("column_name"), F.lit(m.original).alias("header"), F.lit(m.name in commands).alias("command"), text(f"`{m.name}`").alias("cell"), F.lower(text(f"`{m.name}`")).alias("low")) for i, m in enumerate(meta) if m.name != time]
    if not cells:
        return df.select("row_num").filter(F.lit(False)).selectExpr("row_num", "'' as category", "0 as score", "'' as reason", "'' as column_name")
    rows = df.select("row_num", F.explode(F.array(*cells)).alias("c")).select("row_num", "c.*").filter((F.octet_length("cell") >= _LONG) | F.col("low").rlike(_ANY))
    found = _derived(rows, beginning).select("row_num", "i", "column_name", F.explode(_findings()).alias("f"))
    best = found.groupBy("row_num", "f.category").agg(F.max_by(F.struct("f.score", clip(F.col("f.reason"), 160).alias("reason"), "column_name"), F.struct("f.score", -F.col("i"))).alias("b"))
    return best.select("row_num", "category", "b.score", "b.reason", "b.column_name")


def rare_process(df: DataFrame, column: str, header: str, least_rows: int = 100, most_seen: int = 2, cap: int | None = 2000) -> DataFrame:
    """Rows whose process is on at most ``most_seen`` rows, in tables of ``least_rows`` or more."""
    rows = df.select("row_num", trim(text(f"`{column}`")).alias("v")).filter("v <> ''")
    counts = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most_seen)
    enough = df.agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") >= least_rows)
    found = rows.join(counts, "v").join(F.broadcast(enough)).select("row_num", F.lit("rare_process").alias("category"), F.lit(30).alias("score"), clip(F.concat(F.lit("rare process '"), clip(F.col("v"), 60), F.lit("': rows "), F.col("n").cast("string"), F.lit(f", column '{header}'")), 160).alias("reason"), F.lit(column).alias("column_name"))
    return found.orderBy("row_num").limit(cap) if cap else found


def rare_user_host(df: DataFrame, user: str, host: str, least_rows: int = 100, most_seen: int = 2, user_rows: int = 5, cap: int | None = 2000) -> DataFrame:
    """Rows of a user who is on ``user_rows`` rows or more, on a host where the user is on ``most_seen`` at most."""
    rows = df.select("row_num", trim(text(f"`{user}`")).alias("u"), trim(text(f"`{host}`")).alias("h")).filter("u <> '' and h <> ''")
    pairs = rows.groupBy("u", "h").agg(F.count(F.lit(1)).alias("n"))
    users = pairs.groupBy("u").agg(F.sum("n").alias("user_n")).filter(F.col("user_n") >= user_rows)
    rare = pairs.filter(F.col("n") <= most_seen).join(users, "u")
    enough = df.agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") >= least_rows)
    found = rows.join(rare, ["u", "h"]).join(F.broadcast(enough)).select("row_num", F.lit("rare_user_host").alias("category"), F.lit(35).alias("score"), clip(F.concat(F.lit("user '"), clip(F.col("u"), 60), F.lit("' is rare on host '"), clip(F.col("h"), 60), F.lit("': rows "), F.col("n").cast("string")), 160).alias("reason"), F.lit(user).alias("column_name"))
    return found.orderBy("row_num").limit(cap) if cap else found


def off_hours(df: DataFrame, row_time: DataFrame, least_rows: int = 50, below_share: float = 0.15, cap: int | None = 3000) -> DataFrame:
    """Rows between 22 and 6 o'clock UTC, if such rows are few among ``least_rows`` timed rows or more."""
    timed = df.select("row_num").join(row_time.select("row_num", "epoch_ms", "utc_text"), "row_num")
    hour = F.pmod(F.floor(F.col("epoch_ms") / 3_600_000), F.lit(24))
    marked = timed.withColumn("off", (hour >= 22) | (hour < 6))
    share = marked.agg(F.count(F.lit(1)).alias("_n"), F.count_if("off").alias("_off")).filter((F.col("_n") >= least_rows) & (F.col("_off") > 0) & (F.col("_off") / F.col("_n") < below_share))
    found = marked.filter("off").join(F.broadcast(share)).select("row_num", F.lit("off_hours").alias("category"), F.lit(20).alias("score"), F.concat(F.lit("night-time event: "), F.col("utc_text")).alias("reason"), F.lit("").alias("column_name"))
    return found.orderBy("row_num").limit(cap) if cap else found


def scan_anomalies(df: DataFrame, meta: list[ColumnMeta], roles: dict[str, Role], row_time: DataFrame | None = None, ignored: DataFrame | None = None, cap: int | None = 200_000, profile_caps: tuple[int | None, int | None, int | None] = (2000, 2000, 3000), beginning: int | None = None) -> DataFrame:
    """row_num, category, score, reason, column_name of all findings; profile findings come first under the cap.

    ``profile_caps``: those of ``rare_process``, ``rare_user_host`` and ``off_hours``; ``cap`` None lifts them too. ``beginning``: see ``cell_findings``. The
    place where the cap falls is found by counted ranges of the order (``selection``), so no task merges the findings.
    """
    of_process, of_pair, of_hours = profile_caps if cap else (None, None, None)
    df = spread(df)
    rows = suppress(df, ignored)
    names = {m.name: m.original for m in meta}
    profile = []
    if "process_name" in roles:
        profile.append(rare_process(rows, roles["process_name"].column, names[roles["process_name"].column], cap=of_process))
    if "user" in roles and "host" in roles:
        profile.append(rare_user_host(rows, roles["user"].column, roles["host"].column, cap=of_pair))
    if row_time is not None:
        profile.append(off_hours(rows, row_time, cap=of_hours))
    found = cell_findings(rows, meta, roles, beginning).withColumn("_late", F.lit(1))
    for p in profile:
        found = found.unionByName(p.withColumn("_late", F.lit(0)))
    return first_rows(found, ["_late", "row_num", "category"], cap).drop("_late")


def anomaly_summary(findings: DataFrame) -> DataFrame:
    """Findings and distinct rows of each category."""
    return findings.groupBy("category").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("row_num").alias("rows")).orderBy(F.desc("findings"), "category")


def top_rows(findings: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` rows of the highest total score (100 at most), with their categories and best reason."""
    rows = findings.groupBy("row_num").agg(F.least(F.lit(100), F.sum("score")).cast("int").alias("score"), F.array_sort(F.collect_set("category")).alias("categories"), F.max_by("reason", F.struct("score", "category", "reason")).alias("best_reason"))
    return rows.orderBy(F.desc("score"), "row_num").limit(k)
