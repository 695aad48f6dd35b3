"""Rule conditions over columns, and the rows that ignore rules suppress."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions.text import clip, text, trim
from logsift.spec import ColumnMeta


@dataclass(frozen=True)
class Role:
    column: str
    confidence: float = 1.0
    status: str = "suggested"
    reasons: tuple[str, ...] = ()


@dataclass(frozen=True)
class Condition:
    """``op``: equals_any, contains_any or ends_with_any, on the column of a role or of a header."""

    op: str
    values: tuple[str, ...]
    role: str | None = None
    headers: tuple[str, ...] = ()

    def __post_init__(self):
        if self.op not in ("equals_any", "contains_any", "ends_with_any"):
            raise ValueError(f"unknown condition {self.op}")
        if not 1 <= len(self.values) <= 64 or not (self.role or self.headers):
            raise ValueError("a condition names a role or header and has 1 to 64 values")


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    conditions: tuple[Condition, ...]

    def __post_init__(self):
        if not 1 <= len(self.conditions) <= 8:
            raise ValueError("a rule has 1 to 8 conditions")


def condition(record: dict) -> Condition:
    return Condition(record["op"], tuple(record["values"]), record.get("role"), tuple(record.get("headerAnyOf", ())))


def header_key(name: str) -> str:
    return "".join(c for c in name.lower() if c.isascii() and c.isalnum())


def columns_of(condition: Condition, meta: list[ColumnMeta], roles: dict[str, Role], statuses: tuple[str, ...]) -> list[str]:
    if condition.role:
        role = roles.get(condition.role)
        return [role.column] if role and role.status in statuses else []
    wanted = {header_key(h) for h in condition.headers}
    return [m.name for m in meta if header_key(m.name) in wanted or header_key(m.original) in wanted]


def evidence(condition: Condition, columns: list[str]) -> Column:
    """The column and value of the first column that meets the condition, null if none does."""
    found = []
    for c in columns:
        value = trim(text(f"`{c}`"))
        low = F.lower(value)
        wanted = [v.strip().lower() for v in condition.values]
        test = low.isin(wanted) if condition.op == "equals_any" else reduce(or_, [low.contains(v) if condition.op == "contains_any" else low.endswith(v) for v in wanted])
        found.append(F.when((value != "") & test, F.struct(F.lit(c).alias("column"), value.alias("value"))))
    return F.coalesce(*found)


def rule_evidence(rule: Rule, meta, roles, statuses) -> Column | None:
    """The first condition's evidence where all conditions hold; None if a condition has no column."""
    parts = [(c, columns_of(c, meta, roles, statuses)) for c in rule.conditions]
    if not all(columns for _, columns in parts):
        return None
    every = [evidence(c, columns) for c, columns in parts]
    return F.when(reduce(and_, [e.isNotNull() for e in every]), every[0])


def load_rules(path: str | None = None) -> list[Rule]:
    """The enabled rules of a file; by default the built-in ones."""
    found = json.loads(Path(path or Path(__file__).parent.parent / "resources" / "ignore_rules.json").read_text())
    if found.get("schemaVersion") != 1:
        raise ValueError("unknown schema of ignore rules")
    return [Rule(r["id"], r["name"], tuple(condition(c) for c in r["conditions"])) for r in found["rules"] if r.get("enabled", True)]


def ignored_rows(df: DataFrame, rules: list[Rule], meta: list[ColumnMeta], roles: dict[str, Role]) -> DataFrame:
    """row_num, rule_id, rule_name, matched_column, matched_value of the rows that a rule suppresses.

    The first rule that holds wins; only confirmed roles count.
    """
    told = []
    for rule in rules:
        if (e := rule_evidence(rule, meta, roles, ("confirmed",))) is not None:
            told.append(F.when(e.isNotNull(), F.struct(F.lit(rule.id).alias("rule_id"), F.lit(rule.name).alias("rule_name"), e["column"].alias("matched_column"), clip(e["value"], 48).alias("matched_value"))))
    if not told:
        return df.select("row_num", *[F.lit(None).cast("string").alias(c) for c in ("rule_id", "rule_name", "matched_column", "matched_value")]).filter(F.lit(False))
    return df.select("row_num", F.coalesce(*told).alias("hit")).filter("hit is not null").select("row_num", "hit.*")


def suppress(df: DataFrame, ignored: DataFrame | None) -> DataFrame:
    return df if ignored is None else df.join(ignored.select("row_num"), "row_num", "left_anti")


def ignore_summary(ignored: DataFrame) -> DataFrame:
    """Suppressed rows by rule, most first."""
    return ignored.groupBy("rule_id", "rule_name").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "rule_id")
