"""Predicates over log rows, compiled to columns."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions.text import ascii_lower, leading_number, search_phrase, search_tokens
from logsift.spec import Alternative, And, Filter, MatchNone, Not, Or, QuerySpec, RowIds, Search, Selection, Sort, SpecError

#: Limits of a query.
MAX_DEPTH, MAX_NODES, MAX_VALUE_BYTES, MAX_IDS = 8, 128, 4096, 1000


def _fold(value: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in value)


def _number(value: str) -> float | None:
    try:
        return float(value)
    except ValueError:
        return None


def compare(f: Filter) -> Column:
    """One column filter. Order is numeric if the value is a number, else by text."""
    c = F.col(f"`{f.column}`").cast("string")
    v = F.lit(f.value)
    if len(f.value.encode()) > MAX_VALUE_BYTES:
        raise SpecError("a filter value is too long")
    if f.op in ("greaterThan", "lessThan"):
        n = _number(f.value)
        left, right = (c, v) if n is None else (F.when(c.isNotNull(), leading_number(c)), F.lit(n))
        return left > right if f.op == "greaterThan" else left < right
    folded, low = ascii_lower(c), F.lit(_fold(f.value))
    ops = {
        "equals": lambda: c == v,
        "notEquals": lambda: c != v,
        "contains": lambda: folded.contains(low),
        "notContains": lambda: ~folded.contains(low),
        "startsWith": lambda: folded.startswith(low),
        "endsWith": lambda: folded.endswith(low),
        "isEmpty": lambda: c.isNull() | (c == ""),
        "isNotEmpty": lambda: c.isNotNull() & (c != ""),
    }
    if f.op not in ops:
        raise SpecError(f"unknown operator {f.op}")
    return ops[f.op]()


def search(columns: list[str], value: str) -> Column:
    """Some column has the value's tokens one after the other."""
    if not value.strip():
        raise SpecError("a search value is empty")
    if len(value.encode()) > MAX_VALUE_BYTES:
        raise SpecError("a search value is too long")
    phrase = search_phrase(value)
    if not phrase:
        return F.lit(False)
    return reduce(or_, [F.coalesce(search_tokens(F.col(f"`{c}`").cast("string")).contains(phrase), F.lit(False)) for c in columns])


def _size(node, depth: int = 1) -> int:
    if depth > MAX_DEPTH:
        raise SpecError("the expression is too deep")
    if isinstance(node, (And, Or)):
        return 1 + sum(_size(x, depth + 1) for x in node.of)
    return 1 + (_size(node.of, depth + 1) if isinstance(node, Not) else 0)


def compile_node(node, columns: list[str]) -> Column:
    if isinstance(node, Filter):
        if node.column not in columns:
            raise SpecError(f"unknown column {node.column}")
        return compare(node)
    if isinstance(node, Search):
        return search([c for c in columns if c != "row_num"], node.value)
    if isinstance(node, (And, Or)):
        if not node.of:
            raise SpecError("an and/or without parts")
        return reduce(and_ if isinstance(node, And) else or_, [compile_node(x, columns) for x in node.of])
    if isinstance(node, Not):
        return ~F.coalesce(compile_node(node.of, columns), F.lit(False))
    if isinstance(node, RowIds):
        ids = sorted(set(node.ids))
        if not ids or ids[0] < 1 or len(ids) > MAX_IDS:
            raise SpecError(f"between 1 and {MAX_IDS} positive row ids are allowed")
        return F.col("row_num").isin(ids)
    if isinstance(node, MatchNone):
        return F.lit(False)
    if isinstance(node, Selection):
        return F.col(_flag(node)).isNotNull()
    raise SpecError(f"unknown node {type(node).__name__}")


def _flag(node: Selection) -> str:
    return f"_selected_{id(node)}"


def _selections(node) -> list[Selection]:
    if isinstance(node, Selection):
        return [node]
    if isinstance(node, (And, Or)):
        return [s for x in node.of for s in _selections(x)]
    return _selections(node.of) if isinstance(node, Not) else []


def predicate(df: DataFrame, spec: QuerySpec) -> Column:
    """search AND filters AND expression over the columns of ``df``; all rows if nothing is asked."""
    parts = [Search(spec.search)] if spec.search is not None else []
    parts += [*spec.filters, *([spec.expression] if spec.expression is not None else [])]
    if sum(_size(p) for p in parts) > MAX_NODES:
        raise SpecError("the expression is too large")
    return reduce(and_, [compile_node(p, df.columns) for p in parts], F.lit(True))


def where(df: DataFrame, spec: QuerySpec) -> DataFrame:
    """Rows that match. A vector selection joins in by row number; the rest is one filter."""
    columns = df.columns
    for node in _selections(spec.expression) if spec.expression is not None else []:
        rows = node.rows.select("row_num").distinct().withColumn(_flag(node), F.lit(True))
        df = df.join(rows, "row_num", "left")
    spec_columns = df.select(*columns)
    return df.filter(predicate(spec_columns, spec)).select(*columns)


def alternatives_to_spec(alternatives: list[Alternative], sort: Sort | None = None, row_ids: tuple[int, ...] = (), selection: Selection | None = None) -> QuerySpec:
    """Some alternative's terms and filters all hold, or the row is listed or selected; nothing asked, nothing found."""
    either = []
    for a in alternatives:
        parts = (*[Search(t) for t in a.terms], *a.filters)
        if parts:
            either.append(parts[0] if len(parts) == 1 else And(parts))
    either += [RowIds(row_ids)] if row_ids else []
    either += [selection] if selection is not None else []
    whole = MatchNone() if not either else either[0] if len(either) == 1 else Or(tuple(either))
    return QuerySpec(expression=whole, sort=sort or Sort())


def explain_matches(df: DataFrame, alternatives: list[Alternative], reasons: DataFrame | None = None) -> DataFrame:
    """Add why_matched: the reasons of every alternative that holds for the row, then those of ``reasons`` (row_num, reasons)."""
    columns = [c for c in df.columns if c != "why_matched"]
    told = []
    for a in alternatives:
        parts = (*[Search(t) for t in a.terms], *a.filters)
        if parts:
            words = [f"contains '{t}'" for t in a.terms] + [f"{f.column} {f.op} '{f.value}'" for f in a.filters]
            told.append(F.when(compile_node(And(parts), columns), F.lit((a.label + ": " if a.label else "") + ", ".join(words))))
    why = F.array_compact(F.array(*told)) if told else F.array().cast("array<string>")
    if reasons is None:
        return df.select(*columns, why.alias("why_matched"))
    joined = df.join(reasons.select("row_num", F.col("reasons").alias("_reasons")), "row_num", "left")
    return joined.select(*columns, F.concat(why, F.coalesce("_reasons", F.array().cast("array<string>"))).alias("why_matched"))
