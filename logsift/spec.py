"""What a query asks for: filters, search, sort, cursor; and what a column is."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class ColumnMeta:
    name: str
    original: str
    hint: str = "text"


@dataclass(frozen=True)
class Filter:
    """``op``: equals, notEquals, contains, notContains, startsWith, endsWith, isEmpty, isNotEmpty, greaterThan, lessThan."""

    column: str
    op: str
    value: str = ""


@dataclass(frozen=True)
class Search:
    """A phrase whose tokens stand together in one column."""

    value: str


@dataclass(frozen=True)
class And:
    of: tuple


@dataclass(frozen=True)
class Or:
    of: tuple


@dataclass(frozen=True)
class Not:
    of: Any


@dataclass(frozen=True)
class RowIds:
    ids: tuple[int, ...]


@dataclass(frozen=True)
class Selection:
    """Rows of the documents that a stored vector selection retained."""

    rows: Any


@dataclass(frozen=True)
class MatchNone:
    pass


@dataclass(frozen=True)
class Sort:
    column: str | None = None
    descending: bool = False


@dataclass(frozen=True)
class Cursor:
    row_num: int
    value: str | None = None


@dataclass(frozen=True)
class QuerySpec:
    search: str | None = None
    filters: tuple[Filter, ...] = ()
    expression: Any = None
    sort: Sort = field(default_factory=Sort)
    cursor: Cursor | None = None
    limit: int = 200


@dataclass(frozen=True)
class Alternative:
    """One reading of a question: all of its terms and filters hold."""

    terms: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    label: str = ""


class SpecError(ValueError):
    """The query can't be run as asked."""
