"""One activity label for every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsift.functions.text import clip, text, trim
from logsift.operators.matching import any_of
from logsift.operators.rules import Role, header_key, suppress
from logsift.spec import ColumnMeta

# Headers that describe an event, event numbers by meaning, and the words of descriptions in the
# order in which they are tried.
EVENT_ID_HEADERS = ("eventid", "eventcode", "eventnumber")
DESCRIPTOR_HEADERS = ("activity", "activitydisplayname", "activitytype", "operation", "operationname", "event", "eventname", "eventtype", "eventcategory", "action", "actiontype", "category", "taskcategory", "recordtype", "description", "message")
EVENT_IDS = {
    "authentication": (4624, 4625, 4634, 4647, 4648, 4768, 4769, 4771, 4776, 4778, 4779),
    "account_management": (4720, 4722, 4723, 4724, 4725, 4726, 4728, 4729, 4732, 4733, 4738, 4740, 4756, 4757, 4767),
    "process": (4688, 4689),
    "file": (4656, 4660, 4663, 5140, 5145),
    "network": (5156, 5157),
    "scheduled_task": (4698, 4699, 4700, 4701, 4702),
    "registry": (4657,),
    "service_config": (1102, 4697, 4719, 7036, 7045),
}
WORDS = {
    "scheduled_task": ("scheduled task", "schtask"),
    "registry": ("registry",),
    "email": ("mail", "email", "phish", "smtp", "inbox rule", "inboxrule", "forwarding rule", "message trace", "send message", "message sent"),
    "account_management": ("user added", "member added", "member removed", "add member", "remove member", "account created", "account was created", "account was deleted", "account enabled", "account disabled", "password reset", "password change", "group membership", "role assigned", "user created", "user deleted"),
    "authentication": ("logon", "log on", "login", "logged in", "loggedin", "sign-in", "signin", "sign in", "logoff", "log off", "logged out", "authentication", "authenticated", "kerberos", "ntlm", "credential validation", "mfa"),
    "process": ("process creat", "process start", "process terminat", "process launched", "image loaded", "executed", "execution"),
    "service_config": ("service install", "service was installed", "service start", "service stop", "audit policy", "policy change", "log cleared", "audit log", "configuration change"),
    "file": ("file", "document", "sharepoint", "onedrive", "download", "upload", "share accessed", "folder"),
    "network": ("connection", "network", "dns", "firewall", "url", "http", "remote access", "vpn"),
}
LABELS = {
    "authentication": "Authentication / sign-in", "account_management": "Account & group management", "process": "Process execution", "file": "File activity", "network": "Network activity",
    "email": "Email activity", "scheduled_task": "Scheduled task", "registry": "Registry modification", "service_config": "Service / system configuration", "other": "Other / unclassified",
}
_FALLBACK = (("command_line", "process"), ("process_name", "process"), ("file_name", "file"), ("ip", "network"))


def _by_id(value: Column) -> Column:
    digits = F.regexp_extract(value, r"^[0-9]+", 0).try_cast("long")
    return F.coalesce(*[F.when(digits.isin(*ids), F.lit(name)) for name, ids in EVENT_IDS.items()])


def _by_words(low: Column) -> Column:
    return F.coalesce(*[F.when(low.rlike(any_of(list(words))), F.lit(name)) for name, words in WORDS.items()])


def classify_activity(df: DataFrame, meta: list[ColumnMeta], roles: dict[str, Role], ignored: DataFrame | None = None) -> DataFrame:
    """row_num, category, detail, source_column for every row that isn't ignored; one pass, no shuffle.

    Tried in order: event numbers, description columns (in file order, each by its words), role columns, the first
    filled description as `other`, and `other` without detail.
    """
    by_key = [(header_key(m.name), m) for m in meta]
    ids = [m for k, m in by_key if k in EVENT_ID_HEADERS]
    told = [m for k, m in by_key if k in DESCRIPTOR_HEADERS]
    names = {m.name: m.original for m in meta}
    fallback = [(category, roles[r].column) for r, category in _FALLBACK if r in roles and roles[r].status in ("suggested", "confirmed") and roles[r].column in names]
    used = list(dict.fromkeys([m.name for m in (*ids, *told)] + [c for _, c in fallback]))
    v = {c: F.col(f"v{i}") for i, c in enumerate(used)}
    # cells first, then what each says, then the choice: nothing is computed twice
    rows = suppress(df, ignored).select("row_num", *[trim(text(f"`{c}`")).alias(f"v{i}") for i, c in enumerate(used)])
    rows = rows.withColumns({f"low{i}": F.lower(v[m.name]) for i, m in enumerate(told)})
    rows = rows.withColumns({f"id{i}": _by_id(v[m.name]) for i, m in enumerate(ids)} | {f"words{i}": _by_words(F.col(f"low{i}")) for i in range(len(told))})
    label = lambda category, detail, source: F.struct(category.alias("category"), detail.alias("detail"), F.lit(source).alias("source_column"))
    number = lambda c: F.concat(F.lit("Event ID "), F.regexp_extract(v[c], "^[0-9]+", 0).try_cast("long").cast("string"))
    tries = [F.when(F.col(f"id{i}").isNotNull(), label(F.col(f"id{i}"), number(m.name), m.original)) for i, m in enumerate(ids)]
    tries += [F.when(F.col(f"words{i}").isNotNull() & (v[m.name] != ""), label(F.col(f"words{i}"), v[m.name], m.original)) for i, m in enumerate(told)]
    tries += [F.when(v[c] != "", label(F.lit(category), v[c], names[c])) for category, c in fallback]
    tries += [F.when(v[m.name] != "", label(F.lit("other"), v[m.name], m.original)) for m in told]
    tries.append(label(F.lit("other"), F.lit(""), ""))
    chosen = rows.select("row_num", F.coalesce(*tries).alias("a"))
    return chosen.select("row_num", "a.category", clip(F.col("a.detail"), 120).alias("detail"), "a.source_column")


def activity_summary(activity: DataFrame, top: int = 3) -> DataFrame:
    """Rows of each category, most first, with its label and its most frequent details."""
    # a generated row: what reads the parts doesn't choose them again
    activity = activity.select(F.explode(F.array(F.struct("category", "detail"))).alias("a")).select("a.*")
    details = activity.filter("detail <> ''").groupBy("category", "detail").agg(F.count(F.lit(1)).alias("n"))
    best = details.withColumn("k", F.row_number().over(W.partitionBy("category").orderBy(F.desc("n"), "detail"))).filter(F.col("k") <= top)
    told = best.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "detail", "n"))), lambda x: F.struct(x["detail"].alias("detail"), x["n"].alias("rows"))).alias("top_details"))
    label = F.coalesce(*[F.when(F.col("category") == k, F.lit(v)) for k, v in LABELS.items()], F.lit("Activity"))
    counts = activity.groupBy("category").agg(F.count(F.lit(1)).alias("rows"))
    return counts.join(told, "category", "left").select("category", label.alias("label"), "rows", "top_details").orderBy(F.desc("rows"), "category")
