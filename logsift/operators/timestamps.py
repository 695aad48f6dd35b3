"""Timestamp analysis and normalisation to UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions import times
from logsift.functions.text import trim

KINDS = ("blank", "epoch", "explicit_offset", "naive", "invalid")


class TimeError(ValueError):
    """The column can't be normalised with the answers given."""


def _values(df: DataFrame, column: str) -> DataFrame:
    source = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))
    return df.select("row_num", source.alias("source_text"), trim(source).alias("v"))


def _kinds(df: DataFrame, column: str) -> DataFrame:
    """(row_num, source_text, v, kind, e, local): every value is read once, step by step."""
    v = F.col("v")
    read = _values(df, column).select("row_num", "source_text", "v", times.epoch_millis(v).alias("epoch"), times.explicit_instant(v).alias("instant"), times.slash_evidence(v, True).alias("e"), times.naive_local(v, None).alias("local"))
    return read.select("row_num", "source_text", "v", times.kind(v, F.col("epoch"), F.col("instant"), F.col("e"), F.col("local")).alias("kind"), "e", "local")


def samples(values: DataFrame, kind: str, n: int = 5) -> DataFrame:
    """(kind, samples): the first ``n`` values of each kind by row number; a top-n for each kind, not a sort of all rows."""
    rows = None
    for k in KINDS[1:]:
        top = values.filter(F.col(kind) == k).orderBy("row_num").limit(n).select(F.lit(k).alias("kind"), "row_num", "source_text")
        rows = top if rows is None else rows.union(top)
    return rows.groupBy("kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_num", "source_text"))), lambda x: x["source_text"]).alias("samples"))


def infer_date_convention(df: DataFrame, column: str) -> DataFrame:
    """One row: month_first and day_first evidence over all rows, the convention inferred, conflicting, ambiguous rows
    and the first five ambiguous values (by row number)."""
    seen = _values(df, column).select("row_num", "source_text", times.slash_evidence(F.col("v"), True).alias("e"))
    first = seen.filter("e = 'ambiguous'").orderBy("row_num", "source_text").limit(5)
    shown = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("row_num", "source_text"))), lambda x: x["source_text"]).alias("ambiguous_samples"))
    found = seen.agg(*[F.coalesce(F.bool_or(F.col("e") == k), F.lit(False)).alias(k) for k in ("month_first", "day_first")], F.count_if(F.col("e") == "ambiguous").alias("ambiguous_rows"))
    both = F.col("month_first") & F.col("day_first")
    return found.select("month_first", "day_first", F.when(~both & F.col("month_first"), "month_first").when(~both & F.col("day_first"), "day_first").alias("inferred"), both.alias("conflicting"), "ambiguous_rows").join(F.broadcast(shown))


def analyze_timestamps(df: DataFrame, column: str, with_samples: bool = False) -> DataFrame:
    """One row: how many values of each kind, and which questions have to be answered before normalising.

    ``with_samples`` adds a map of each kind's first five values, a further pass.
    """
    values = _kinds(df, column).select("kind", "e")
    counts = values.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("kind") == k).alias(f"{k}_rows") for k in KINDS],
        *[F.coalesce(F.bool_or(F.col("e") == k), F.lit(False)).alias(k) for k in ("month_first", "day_first", "ambiguous")],
    )
    if with_samples:
        shown = samples(_kinds(df, column), "kind")
        counts = counts.join(F.broadcast(shown.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "samples")))).alias("samples"))))
    return counts.withColumns({"needs_timezone": F.col("naive_rows") > 0, "needs_date_convention": F.col("ambiguous") & (F.col("month_first") == F.col("day_first")), "conflicting": F.col("month_first") & F.col("day_first")})


def zone_problems(df: DataFrame, column: str, zone: str, convention: str | None = None) -> DataFrame:
    """row_num, source_text, problem: naive times that a named zone skips or has twice."""
    v = F.col("v")
    zoned = times.epoch_millis(v).isNotNull() | times.explicit_instant(v).isNotNull()
    rows = _values(df, column).select("row_num", "source_text", F.when(~zoned, times.naive_local(v, convention)).alias("local"))
    return _zone_problems(rows, zone)


def _zone_problems(rows: DataFrame, zone: str) -> DataFrame:
    # an array's entry is a value: what is in the lambda doesn't read the time again
    local = F.get(F.transform(F.array("local"), lambda x: _problem(x, zone)), F.lit(0))
    return rows.select("row_num", "source_text", F.explode(F.array_compact(F.array(local))).alias("problem"))


def _problem(local: Column, zone: str) -> Column:
    utc = F.to_utc_timestamp(local, zone)
    shifted = lambda minutes: F.from_utc_timestamp(utc + F.expr(f"interval {minutes} minutes"), zone) == local
    gap = F.from_utc_timestamp(utc, zone) != local
    twice = shifted(60) | shifted(-60) | shifted(30) | shifted(-30)
    return F.when(local.isNotNull(), F.when(gap, "does not exist").when(twice, "is ambiguous"))


def normalize_timestamps(df: DataFrame, column: str, tz: str | None = None, convention: str | None = None) -> DataFrame:
    """row_time: row_num, event_time, epoch_ms, utc_text, source_text, parse_status, for the rows that parse.

    One aggregate first finds what isn't answerable: conflicting or contradicted slash dates, ambiguous ones
    without a convention, naive times without a zone, and naive times that a named zone skips or has twice.
    """
    found = analyze_timestamps(df, column).first()
    if found["conflicting"]:
        raise TimeError("the column mixes month-first and day-first dates")
    inferred = "month_first" if found["month_first"] else "day_first" if found["day_first"] else None
    if convention and inferred and convention != inferred:
        raise TimeError(f"the column's dates are {inferred}")
    if found["needs_date_convention"] and not convention:
        raise TimeError("the column's dates can be read both ways: a date convention is needed")
    if found["naive_rows"] and not tz:
        raise TimeError("the column has times without a zone: a timezone is needed")
    v = F.col("v")
    epoch = times.epoch_millis(v)
    instant = times.explicit_instant(v)
    rows = _values(df, column).select("row_num", "source_text", F.timestamp_millis(epoch).alias("epoch"), instant.alias("instant"), times.naive_local(v, convention or inferred).alias("local"))
    rows = rows.withColumn("local", F.when(F.col("epoch").isNull() & F.col("instant").isNull(), F.col("local")))
    local = F.col("local")
    offset = times.zone_seconds(tz.strip()) if tz else 0
    if offset is not None:
        utc, status = F.timestamp_micros(F.unix_micros(local) - offset * 1_000_000), "naive_confirmed_utc" if offset == 0 else "naive_with_fixed_offset"
    else:
        zone = tz.strip()
        utc, status = F.to_utc_timestamp(local, zone), "naive_with_iana_timezone"
        if bad := _zone_problems(rows, zone).orderBy("row_num").first():
            raise TimeError(f"row {bad['row_num']} timestamp '{bad['source_text']}' {bad['problem']} in {zone}")
    time = F.coalesce("epoch", "instant", utc)
    parsed = rows.select("row_num", time.alias("event_time"), "source_text", F.when(F.col("epoch").isNotNull(), "epoch").when(F.col("instant").isNotNull(), "explicit_offset").otherwise(status).alias("parse_status"))
    # a plain filter would be pushed below the parsing and repeat it: rows that don't parse leave as empty arrays
    told = F.struct("event_time", F.unix_millis("event_time").alias("epoch_ms"), F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("utc_text"), "source_text", "parse_status")
    return parsed.select("row_num", F.explode(F.array_compact(F.array(F.when(F.col("event_time").isNotNull(), told)))).alias("t")).select("row_num", "t.*")


#: Header words that name a time: strong and weak ones.
STRONG = ("timegenerated", "timestamp", "eventtime", "creationtime", "created", "datetime")
WEAK = ("date", "time", "utc")


def rank_timestamp_columns(df: DataFrame, meta: list, roles: dict[str, float] | None = None, confirmed: str | None = None) -> list[tuple[str, float]]:
    """(column, score) of the columns that look like times, best first, from their header, hint, role and values.

    420 for a strong and 170 for a weak word in the header, 230 for the hint, 450 or 250 times the confidence of a
    confirmed or suggested role, 450 times the share of filled cells that parse; 400 is the least that counts.
    One aggregate over all rows, a handful of numbers a column.
    """
    counts = df.agg(*[F.count_if(kind.isin("epoch", "explicit_offset", "naive")).alias(f"v{i}") for i, kind in enumerate(times.classify(F.col(f"`{m.name}`").cast("string")) for m in meta)], *[F.count_if(trim(F.coalesce(F.col(f"`{m.name}`").cast("string"), F.lit(""))) != "").alias(f"n{i}") for i, m in enumerate(meta)]).first()
    ranked = []
    for i, m in enumerate(meta):
        compact = "".join(c for c in m.original.lower() if c.isalnum())
        score = 420.0 if any(w in compact for w in STRONG) else 170.0 if any(w in compact for w in WEAK) else 0.0
        score += 230.0 * (m.hint == "timestamp")
        score += (450.0 if confirmed == m.name else 250.0) * (roles or {}).get(m.name, 0.0)
        score += 450.0 * counts[f"v{i}"] / counts[f"n{i}"] if counts[f"n{i}"] else 0.0
        if score >= 400:
            ranked.append((m.name, score))
    return sorted(ranked, key=lambda x: (-x[1], x[0]))
