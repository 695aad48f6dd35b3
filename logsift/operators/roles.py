"""Which column plays which role, from headers and a profile of values."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions import times, values
from logsift.functions.text import trim
from logsift.operators.rules import Role
from logsift.spec import ColumnMeta
from logsift.storage import spread


@dataclass(frozen=True)
class Scoring:
    """Header words (strong, weak) with their weights, and shares of values with the least that counts and the weight."""

    strong: tuple[str, ...]
    strong_weight: float
    weak: tuple[str, ...] = ()
    weak_weight: float = 0.0
    shares: tuple[tuple[str, float, float], ...] = ()
    never: tuple[str, ...] = ()
    threshold: float = 0.25


# The words that headers are known by, and the weights of what is found.
ROLES = {
    "timestamp": Scoring(("timegenerated", "timestamp", "eventtime", "creationtime", "created", "datetime"), 0.5, ("date", "time", "utc"), 0.28, (("timed", 0.4, 0.42),), threshold=0.3),
    "user": Scoring(("userprincipalname", "targetusername", "subjectusername", "username", "accountname", "account", "principal", "actor", "user"), 0.45, ("owner", "identity"), 0.25, (("identity", 0.35, 0.42),), never=("useragent", "browser"), threshold=0.3),
    "command_line": Scoring(("initiatingprocesscommandline", "processcommandline", "commandline", "cmdline"), 0.55, ("command",), 0.32, (("command", 0.25, 0.36), ("long", 0.3, 0.12)), threshold=0.3),
    "process_name": Scoring(("processname", "imagename", "newprocessname", "parentprocessname", "process", "image"), 0.4, shares=(("process", 0.4, 0.45),)),
    "file_name": Scoring(("targetfilename", "filename", "filepath", "folder", "path", "file"), 0.38, shares=(("file", 0.35, 0.42),)),
    "host": Scoring(("hostname", "computer", "devicename", "device", "workstation", "machine", "host", "dvc"), 0.42, shares=(("host", 0.35, 0.38),)),
    "ip": Scoring(("ipaddress", "sourceip", "destinationip", "remoteip", "clientip", "srcip", "dstip"), 0.48, shares=(("ip", 0.3, 0.45),), threshold=0.3),
    "text_evidence": Scoring(("description", "eventdata", "additionalfields", "message", "details", "activity", "operation", "action", "alert", "threat", "evidence", "summary", "raw"), 0.38, shares=(("text", 0.35, 0.32),)),
}
_TESTS = ["total", "timed", "absolute", "identity", "command", "long", "process", "file", "host", "ip", "text"]


def _tokens(name: str) -> list[str]:
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    return [t for t in re.split(r"[^a-z0-9]+", spaced.lower()) if t]


def value_profile(df: DataFrame, columns: list[str], sample_rows: int | None = 500, cell_chars: int = 4000) -> DataFrame:
    """For each column how many filled cells there are and how many pass each test.

    ``sample_rows``: only the rows numbered up to it; None profiles all rows. One grouped aggregate.
    """
    rows = df.filter(F.col("row_num") <= sample_rows) if sample_rows else spread(df)
    cells = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.substring(F.col(f"`{c}`").cast("string"), 1, cell_chars).alias("v")) for c in columns])).alias("x")).select("x.*")
    cells = cells.filter(trim(F.coalesce("v", F.lit(""))) != "").withColumn("kind", times.classify(F.col("v")))
    v, kind = F.col("v"), F.col("kind")
    tests = {
        "timed": kind.isin("epoch", "explicit_offset", "naive"), "absolute": kind.isin("epoch", "explicit_offset"), "identity": values.is_identity_like(v),
        "command": values.is_command_line_like(v), "long": F.octet_length(trim(v)) >= 40, "process": values.is_process_name_like(v),
        "file": values.is_file_like(v), "host": values.is_host_like(v), "ip": values.parse_ip(v).isNotNull(), "text": values.is_evidence_text(v),
    }
    marked = cells.select("column", *[t.cast("int").alias(k) for k, t in tests.items()])
    return marked.groupBy("column").agg(F.count(F.lit(1)).alias("total"), *[F.sum(F.coalesce(k, F.lit(0))).alias(k) for k in _TESTS[1:]])


def header_points(role: str, meta: ColumnMeta) -> tuple[float, list[str]] | None:
    """What a header says for a role, with the reason; None where it rules the role out."""
    rule, compact = ROLES[role], "".join(_tokens(meta.original))
    if any(w in compact for w in rule.never):
        return None
    named = not (role in ("process_name", "file_name") and "commandline" in compact)
    strong = next((w for w in rule.strong if w in compact), None) if named else None
    weak = next((w for w in rule.weak if w in compact), None)
    if strong:
        return rule.strong_weight, [f"header has '{strong}'"]
    if role == "ip" and "ip" in _tokens(meta.original):
        return 0.42, ["header has the word 'ip'"]
    return (rule.weak_weight, [f"header has '{weak}'"]) if weak else (0.0, [])


def _share_points(role: str) -> list[tuple[Column, Column]]:
    """(points, reason) of a role for each kind of values that a column may have enough of; null where it hasn't."""
    share = lambda test: F.col(test) / F.col("total")
    told = lambda test: F.concat(F.col(test).cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(f" values look like {test}"))
    found = [(F.when(share(test) >= least, share(test) * weight), told(test)) for test, least, weight in ROLES[role].shares]
    if role == "timestamp":
        found.append((F.when((F.col("timed") > 0) & (F.col("absolute") / F.col("timed") >= 0.5), F.lit(0.08)), F.lit("most times have an offset or are epochs")))
    return found


def role_scores(df: DataFrame, meta: list[ColumnMeta], sample_rows: int | None = 500, wide: int = 500) -> DataFrame:
    """role, column, score, total (filled cells judged) and reasons of every pair that reaches its role's threshold.

    A table of more than ``wide`` columns has only those profiled whose header hints at a role. The plan is one grouped
    aggregate over the cells, joined to the headers' points: eight rows a column. ``role_at`` and ``column_at`` tell
    the orders of roles and columns, which decide ties.
    """
    spark = df.sparkSession
    said = {(role, m.name): points for m in meta for role in ROLES if (points := header_points(role, m)) is not None}
    headers = [(role, i, m.name, j, *said[role, m.name]) for i, role in enumerate(ROLES) for j, m in enumerate(meta) if (role, m.name) in said]
    known = spark.createDataFrame(headers, "role string, role_at int, column string, column_at int, points double, said array<string>")
    profiled = [m.name for m in meta if len(meta) <= wide or any(said.get((role, m.name), (0,))[0] > 0 for role in ROLES)]
    if profiled:
        rows = sample_rows if len(meta) <= wide or not sample_rows else min(sample_rows, 120)
        known = known.join(value_profile(df, profiled, rows), "column", "left")
    else:
        known = known.withColumns({t: F.lit(None).cast("long") for t in _TESTS})
    score, reasons = F.lit(None).cast("double"), F.lit(None).cast("array<string>")
    for role in ROLES:
        total, why = F.col("points"), F.col("said")
        for points, reason in _share_points(role):
            total = total + F.coalesce(points, F.lit(0.0))
            why = F.when(points.isNotNull(), F.concat(why, F.array(reason))).otherwise(why)
        mine = F.col("role") == role
        score, reasons = F.when(mine, total).otherwise(score), F.when(mine, why).otherwise(reasons)
    least = F.create_map(*[F.lit(x) for role, rule in ROLES.items() for x in (role, float(rule.threshold))])
    scored = known.select("role", "role_at", "column", "column_at", score.alias("score"), F.coalesce("total", F.lit(0)).cast("long").alias("total"), reasons.alias("reasons"))
    return scored.filter(F.col("score") >= least[F.col("role")])


def assigned(scores: DataFrame) -> DataFrame:
    """role, column, confidence, total, reasons: the strongest remaining pair takes its role and its column.

    The pairs (at most eight a column) are folded in the order of their scores, then of roles, then of columns.
    """
    pair = F.struct((-F.col("score")).alias("least"), "role_at", "column_at", "role", "column", "total", "reasons")
    ranked = scores.agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    kind = ranked.schema["pairs"].dataType
    taken = F.aggregate("pairs", F.array().cast(kind), lambda kept, x: F.when(F.exists(kept, lambda k: (k["role"] == x["role"]) | (k["column"] == x["column"])), kept).otherwise(F.concat(kept, F.array(x))))
    return ranked.select(F.explode(taken).alias("p")).select("p.role", "p.column", F.least(F.lit(1.0), F.round(-F.col("p.least"), 6)).alias("confidence"), "p.total", "p.reasons")


def detect_roles(df: DataFrame, meta: list[ColumnMeta], existing: dict[str, Role] | None = None, sample_rows: int | None = 500, wide: int = 500) -> dict[str, Role]:
    """The strongest remaining (role, column) pair takes its column; a role has at most one.

    ``existing`` roles (decided ones) are kept, and neither they nor their columns are judged (see ``role_scores``).
    """
    roles = dict(existing or {})
    taken = {r.column for r in roles.values()}
    free = [m for m in meta if m.name not in taken]
    if free:
        scores = role_scores(df, free, sample_rows, wide if len(free) > wide or len(meta) <= wide else len(free) - 1)
        for r in assigned(scores.filter(~F.col("role").isin(list(roles)))).collect():  # at most a row a role
            roles[r["role"]] = Role(r["column"], r["confidence"], "suggested", tuple(r["reasons"]))
    return roles
