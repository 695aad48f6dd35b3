"""Timestamp text as columns: what kind of value it is, and the instant it names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logsift.functions.text import trim

_CLOCK = r"\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d{1,9})?)?"
_SECONDS = r"\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d{1,9})?"
#: A dash between the parts of a date allows T or a space before the time, a slash only a space.
NAIVE = rf"^(?:\d{{4}}-\d{{1,2}}-\d{{1,2}}(?:[T ]{_CLOCK})?|\d{{4}}/\d{{1,2}}/\d{{1,2}}(?: {_CLOCK})?)$"
OFFSET = rf"^(?:\d{{4}}-\d{{1,2}}-\d{{1,2}}[T ]|\d{{4}}/\d{{1,2}}/\d{{1,2}} ){_SECONDS} ?[+-]\d{{2}}:?\d{{2}}$"
SLASH = rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}}(?: {_CLOCK})?$"
_REST = "[ H:m[:s[.SSSSSSSSS]]]"
_LOW, _HIGH, _YEAR = r"0*(?:[1-9]|1[0-2])", r"0*(?:1[3-9]|2\d|3[01])", r"[1-9]\d{3}(?:[\sT]|$)"


def _parse(c: Column, pattern: str, form: str) -> Column:
    """Null for what the pattern doesn't fit and for impossible dates and times."""
    return F.when(c.rlike(pattern), F.try_to_timestamp(c, F.lit(form)))


def epoch_millis(c: Column) -> Column:
    """Ten digits are seconds, thirteen are milliseconds."""
    return F.when(c.rlike(r"^[0-9]{10}$"), c.try_cast("long") * 1000).when(c.rlike(r"^[0-9]{13}$"), c.try_cast("long"))


def _dashed(c: Column) -> Column:
    return F.translate(c, "/T", "- ")


def explicit_instant(c: Column) -> Column:
    """Values with Z or a numeric offset, as an instant (session zone UTC)."""
    one = F.regexp_replace(_dashed(c), r" ?([+-]\d{2}):?(\d{2})$", "$1:$2")
    offset = F.when(c.rlike(OFFSET), F.try_to_timestamp(one, F.lit("yyyy-M-d H:m:s[.SSSSSSSSS]xxx")))
    return F.coalesce(offset, F.when(c.rlike(r"[Zz]$"), naive_local(F.regexp_replace(c, r"\s*[Zz]$", ""), None)))


def slash_evidence(c: Column, trimmed: bool = False) -> Column:
    """month_first, day_first or ambiguous for a date written with slashes, year last; null for anything else."""
    v = c if trimmed else trim(c)
    return F.when(v.rlike(f"^{_LOW}/{_LOW}/{_YEAR}"), "ambiguous").when(v.rlike(f"^{_LOW}/{_HIGH}/{_YEAR}"), "month_first").when(v.rlike(f"^{_HIGH}/{_LOW}/{_YEAR}"), "day_first")


def naive_local(c: Column, convention: str | None) -> Column:
    """Values without a zone, read as they stand; slash dates by ``convention``, or by what their own parts show."""
    plain = F.when(c.rlike(NAIVE), F.try_to_timestamp(_dashed(c), F.lit("yyyy-M-d" + _REST)))
    month_first, day_first = _parse(c, SLASH, "M/d/yyyy" + _REST), _parse(c, SLASH, "d/M/yyyy" + _REST)
    if convention:
        return F.coalesce(plain, month_first if convention == "month_first" else day_first)
    # a part over 12 is a day: only one reading of such a date is possible
    own = F.when(~c.rlike(f"^{_LOW}/{_LOW}/"), F.coalesce(month_first, day_first))
    return F.coalesce(plain, own)


def kind(v: Column, epoch: Column, instant: Column, evidence: Column, local: Column) -> Column:
    """blank, epoch, explicit_offset, naive or invalid of a trimmed value, from what it has been read as."""
    return (
        F.when(v == "", "blank").when(epoch.isNotNull(), "epoch").when(instant.isNotNull(), "explicit_offset")
        .when((evidence == "ambiguous") | local.isNotNull(), "naive").otherwise("invalid")
    )


def classify(c: Column) -> Column:
    """The kind of a value; a slash date that could be read both ways counts as naive."""
    v = trim(F.coalesce(c, F.lit("")))
    return kind(v, epoch_millis(v), explicit_instant(v), slash_evidence(v, True), naive_local(v, None))


def zone_seconds(zone: str) -> int | None:
    """Seconds east of UTC for a fixed offset like +02, +0200, +02:00, UTC+2:00; None for a named zone."""
    import re

    upper = zone.upper()
    if upper in ("UTC", "Z", "ETC/UTC", "GMT"):
        return 0
    m = re.fullmatch(r"(?:UTC|GMT)?([+-])(?:(\d{2})(\d{2})?|(\d+):(\d+))", upper)
    if not m:
        return None
    hours, minutes = int(m[2] or m[4]), int(m[3] or m[5] or 0)
    if hours > 23 or minutes > 59:
        return None
    return (-1 if m[1] == "-" else 1) * (hours * 3600 + minutes * 60)
