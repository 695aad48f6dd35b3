"""Count, sort and keyset pages."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from logsift.operators.filters import where
from logsift.spec import Cursor, QuerySpec, SpecError


def count_rows(df: DataFrame, spec: QuerySpec) -> DataFrame:
    """One row, ``n``: how many rows match, whatever the sort and cursor."""
    return where(df, spec).agg(F.count(F.lit(1)).alias("n"))


def order(spec: QuerySpec) -> list[Column]:
    """By text, then row number, in one direction."""
    row = F.col("row_num")
    if not spec.sort.column:
        return [row.desc() if spec.sort.descending else row.asc()]
    c = F.col(f"`{spec.sort.column}`").cast("string")
    return [c.desc(), row.desc()] if spec.sort.descending else [c.asc(), row.asc()]


def sort(df: DataFrame, spec: QuerySpec) -> DataFrame:
    return where(df, spec).orderBy(*order(spec))


def after(spec: QuerySpec) -> Column:
    """Which rows come after the cursor in the view's order."""
    at, row = spec.cursor, F.col("row_num")
    beyond = row < at.row_num if spec.sort.descending else row > at.row_num
    if not spec.sort.column or at.value is None:
        return beyond
    c = F.col(f"`{spec.sort.column}`").cast("string")
    past = c < at.value if spec.sort.descending else c > at.value
    return past | ((c == at.value) & beyond)


def page_frame(df: DataFrame, spec: QuerySpec) -> DataFrame:
    """One page and one row more, in order."""
    if spec.sort.column and spec.sort.column not in df.columns:
        raise SpecError(f"unknown column {spec.sort.column}")
    found = where(df, spec)
    if spec.cursor:
        found = found.filter(after(spec))
    return found.orderBy(*order(spec)).limit(min(max(spec.limit, 1), 5000) + 1)


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    cursor: Cursor | None
    has_more: bool


def page(df: DataFrame, spec: QuerySpec) -> Page:
    """At most 5000 rows after the cursor, and the cursor of the next page."""
    limit = min(max(spec.limit, 1), 5000)
    rows = page_frame(df, spec).collect()
    more, rows = len(rows) > limit, rows[:limit]
    last = rows[-1] if more else None
    return Page(rows, Cursor(last["row_num"], last[spec.sort.column] if spec.sort.column else None) if more else None, more)


def time_order(descending: bool = False) -> list[Column]:
    """Rows without a time come last either way."""
    turn = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    return [F.col("epoch_ms").isNull().asc(), turn("epoch_ms"), turn("row_num")]


def after_time(spec: QuerySpec, descending: bool = False) -> Column:
    """Which rows come after the cursor in the order of ``time_order``."""
    row, epoch = F.col("row_num"), F.col("epoch_ms")
    beyond = row < spec.cursor.row_num if descending else row > spec.cursor.row_num
    if spec.cursor.value is None:
        return epoch.isNull() & beyond
    at = int(spec.cursor.value)
    past = epoch < at if descending else epoch > at
    return epoch.isNull() | past | ((epoch == at) & beyond)


def page_by_time(df: DataFrame, row_time: DataFrame, spec: QuerySpec, descending: bool = False) -> DataFrame:
    """A page (and one row more) by time. The cursor's value is an epoch in milliseconds; without one it pages the rows that have no time."""
    found = where(df, replace(spec, cursor=None)).join(row_time.select("row_num", "epoch_ms"), "row_num", "left")
    if spec.cursor:
        found = found.filter(after_time(spec, descending))
    return found.orderBy(*time_order(descending)).limit(min(max(spec.limit, 1), 5000) + 1)
