"""The first rows of an order, chosen by counted ranges of the key instead of a sort that meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsift.storage import cut

#: A key's span is counted in so many ranges a pass; so many counts come to the driver.
RANGES = 4096
#: Bytes of a string that are compared at a time, as one number.
CHUNK = 7
_TOP = (1 << 8 * CHUNK) - 1


def _kth(rows: DataFrame, key: Column, k: int) -> tuple[int, int, int]:
    """(v, before, same): the ``k``-th smallest value of a long ``key``, the rows below it and those equal to it.

    Each pass counts the rows of every range and goes on in the range where the ``k``-th row falls: a partial
    aggregate a task and at most ``RANGES`` counts in all. A span that a long can't hold is narrowed by its upper half
    first.
    """
    rows = rows.select(key.cast("long").alias("k"))
    low, high, same = rows.agg(F.min("k"), F.max("k"), F.count(F.lit(1))).first()
    before = 0
    if high - low >= 1 << 62:
        top, before, same = _kth(rows, F.shiftright("k", 32), k)
        rows = rows.filter(F.shiftright("k", 32) == top)
        low, high = rows.agg(F.min("k"), F.max("k")).first()
    while low < high:
        width = -(-(high - low + 1) // RANGES)
        counts = rows.filter(F.col("k").between(low, high)).groupBy(F.expr(f"(k - {low}L) div {width}L").alias("r")).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("a"), F.max("k").alias("b"))
        for _, same, low, high in sorted(counts.collect()):
            if before + same >= k:
                break
            before += same
    return low, before, same


def median(rows: DataFrame, key: Column) -> float | None:
    """The middle value of a long ``key``, the mean of the two middle ones of an even number; nulls aside, None without any.

    By counted ranges (``_kth``), so no task has a table of all values; ``rows`` should be a written table.
    """
    rows = rows.select(key.cast("long").alias("k")).filter("k IS NOT NULL")
    n = rows.count()
    if not n:
        return None
    low, before, same = _kth(rows, F.col("k"), (n + 1) // 2)
    high = low if n % 2 or before + same > n // 2 else rows.filter(F.col("k") > low).agg(F.min("k")).first()[0]
    return (low + high) / 2


def _keys(df: DataFrame, name: str):
    """A column's order as a series of longs, most significant first.

    A null stands before all values. A string is read in chunks of ``CHUNK`` bytes (UTF-8 bytes are in the order of
    the characters), then by its length, which tells apart what differs in trailing zero bytes only.
    """
    down, name = name.startswith("-"), name.lstrip("-")
    c = F.col(f"`{name}`")
    kind = dict(df.dtypes)[name]
    turn = (lambda x, top: F.lit(top) - x) if down else (lambda x, top: x)
    text = kind == "string"
    nulls, longest = df.agg(F.count_if(c.isNull()), F.max(F.octet_length(c)) if text else F.lit(0)).first()
    if nulls:
        yield turn(c.isNotNull().cast("long"), 1)
    if text:
        longest = longest or 0
        for i in range(0, longest, CHUNK):
            digits = F.rpad(F.hex(F.substring(c.cast("binary"), i + 1, CHUNK)), 2 * CHUNK, "0")
            yield turn(F.coalesce(F.conv(digits, 16, 10).cast("long"), F.lit(0)), _TOP)
        yield turn(F.coalesce(F.octet_length(c), F.lit(0)).cast("long"), longest)
    elif kind in ("tinyint", "smallint", "int", "bigint", "boolean", "date"):
        number = F.unix_date(c) if kind == "date" else c
        number = F.coalesce(number.cast("long"), F.lit(0))
        yield (F.bitwise_not(number) if down else number)
    else:
        raise TypeError(f"{name}: rows can't be selected by {kind}")


def cutoff(rows: DataFrame, order: list[str], k: int) -> tuple[Column, Column, int]:
    """(below, level, need): which rows come before the ``k``-th of an order, which are equal to it, how many of these are in.

    ``rows`` is read once or twice for each column of ``order`` (and for each seven bytes of a string on which the
    rows at the cap agree), so it should be a written table; it has ``k`` rows at least, and ``k`` is 1 or more.
    ``order``: names of columns of whole numbers, strings, dates or booleans, with a ``-`` in front for descending.
    """
    below, level, need, tied = F.lit(False), F.lit(True), k, rows
    for name in order:
        for key in _keys(tied, name):
            v, before, same = _kth(tied, key, need)
            below, level, need = below | (level & (key < v)), level & (key == v), need - before
            tied = rows.filter(level)
            if same == need:
                return below, level, need
    return below, level, need


def first_rows(df: DataFrame, order: list[str], k: int | None) -> DataFrame:
    """The rows that ``df.orderBy(*order).limit(k)`` has, in no particular order; all of them without ``k``.

    The table is written once. Then the value at which the cap falls is found column by column (``cutoff``) and the rows
    up to it are filtered, so nothing is sorted and no task or driver has the rows. Among rows that are equal in all
    columns of ``order`` those of the least hash are taken, and of identical rows as many as there is room for.

    Defined cases: nulls come first (last in a descending column); ``k`` of 0 or less gives no row.
    """
    if k is None:
        return df
    if k <= 0:
        return df.limit(0)
    rows = cut(df)
    if rows.count() <= k:
        return rows
    below, level, need = cutoff(rows, order, k)
    tied = rows.filter(level)
    if tied.count() == need:
        return rows.filter(below | level)
    least = F.xxhash64(*[f"`{c}`" for c in rows.columns])
    v, before, same = _kth(tied, least, need)
    if before + same == need:
        return rows.filter(below | (level & (least <= v)))
    one = tied.filter(least == v).limit(1)
    copies = one.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(need - before)))).drop("_copy")
    return rows.filter(below | (level & (least < v))).unionByName(copies)


def fair_shares(demands: list[int], limit: int) -> list[int]:
    """What each of several demands gets of a limit: equal shares, and what one doesn't need goes to the others.

    What is left over of a division goes to some of equal demands that lie scattered among them.
    """
    out, left = [0] * len(demands), limit
    for i, k in enumerate(sorted(range(len(demands)), key=lambda k: (demands[k], k * 2654435761 % 2**32))):
        out[k] = min(demands[k], left // (len(demands) - i))
        left -= out[k]
    return out


def even_share(df: DataFrame, position: str, key: str, limit: int | None, span: tuple[int, int] | None = None, strata: int = 1024) -> DataFrame:
    """``limit`` rows that are spread evenly over ``position``, exactly as many if there are enough; all of them without.

    The span of positions (given, or that of the rows) is cut into ``strata`` of equal width. Each gets an equal share of
    the limit, unused shares go to those that have more (``fair_shares``). Within one the rows of the least ``key`` are
    taken: a column of hexadecimal digits of a hash, different for each row. Its first three digits are counted for each
    stratum; only rows with the digits where a share ends are put in order. What comes to the driver is a count
    a stratum.
    """
    if limit is None:
        return df
    rows = cut(df)
    if rows.count() <= limit:
        return rows
    low, high = span or rows.agg(F.min(position), F.max(position)).first()
    stratum = F.floor((F.col(position) - low) * strata / F.lit(high - low + 1)).cast("int").alias("_stratum")
    head = F.substring(key, 1, 3).alias("_head")
    counts = cut(rows.groupBy(stratum, head).agg(F.count(F.lit(1)).alias("n")))
    demand = dict(counts.groupBy("_stratum").agg(F.sum("n")).collect())
    names = sorted(demand)
    shares = df.sparkSession.createDataFrame(list(zip(names, fair_shares([demand[k] for k in names], limit))), "_stratum int, share long")
    before = F.sum("n").over(W.partitionBy("_stratum").orderBy("_head").rowsBetween(W.unboundedPreceding, -1))
    # of each stratum the digits where its share ends, and how many rows with them are in
    ends = counts.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(shares), "_stratum").filter((F.col("before") <= F.col("share")) & (F.col("share") < F.col("before") + F.col("n"))).select("_stratum", F.col("_head").alias("_end"), (F.col("share") - F.col("before")).alias("_room"))
    told = rows.withColumns({"_stratum": stratum, "_head": head}).join(F.broadcast(ends), "_stratum", "left")
    whole = told.filter(F.col("_end").isNull() | (F.col("_head") < F.col("_end")))
    last = told.filter(F.col("_head") == F.col("_end")).withColumn("_k", F.row_number().over(W.partitionBy("_stratum").orderBy(key))).filter(F.col("_k") <= F.col("_room"))
    return whole.select(*df.columns).unionByName(last.select(*df.columns))
