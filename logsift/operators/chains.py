"""Attack chains: several tactics on one host within a time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsift.functions.text import trim
from logsift.operators.selection import first_rows
from logsift.storage import cut

HOUR = 3_600_000


def _events(matches: DataFrame, df: DataFrame, host: str | None, cap: int | None) -> DataFrame:
    """The best score of each row, tactic and technique, with the row's trimmed host; no host is a host of its own."""
    found = matches.groupBy("row_num", "tactic_id", "tactic_name", "technique_id", "technique_name").agg(F.max("score").alias("score"))
    found = first_rows(found, ["row_num", "tactic_id", "technique_id"], cap)
    name = trim(F.col(f"`{host}`").cast("string")) if host else F.lit(None).cast("string")
    return found.join(df.select("row_num", name.alias("host")), "row_num")


def _records(events: DataFrame, names: int = 8, sample: int = 50) -> DataFrame:
    """One row a (host, start). Lists are made of one entry a tactic or technique, and of the first ``sample`` rows."""
    chain = ["host", "start"]
    kinds = events.groupBy(*chain, "tactic_id", "technique_name").agg(
        F.min(F.struct("epoch_ms", "row_num")).alias("at"), F.count(F.lit(1)).alias("n"), F.max("score").alias("top"), F.min("epoch_ms").alias("e0"), F.max("epoch_ms").alias("e1"), F.min("row_num").alias("r0"), F.max("row_num").alias("r1"),
    )
    # in order of first events: a kind's first entry is where it was first seen
    seen = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(c).alias("v")))), lambda x: x["v"]))
    totals = kinds.groupBy(*chain).agg(F.sum("n").alias("event_count"), F.max("top").alias("top"), F.min("e0").alias("first_epoch_ms"), F.max("e1").alias("last_epoch_ms"), F.min("r0").alias("first_row"), F.max("r1").alias("last_row"), seen("tactic_id").alias("tactics"), seen("technique_name").alias("all_techniques"))
    rows = events.groupBy(*chain, "row_num").agg(F.min("epoch_ms").alias("e"))
    counts = rows.groupBy(*chain).agg(F.count(F.lit(1)).alias("rows"))
    # a chain's first rows are among the first of each of its parts, so a chain of a whole host isn't sorted at once
    first = lambda *by: F.row_number().over(W.partitionBy(*chain, *by).orderBy("e", "row_num"))
    parts = rows.withColumn("part", F.pmod(F.xxhash64("row_num"), F.lit(64))).withColumn("k", first("part")).filter(F.col("k") <= sample)
    kept = parts.withColumn("k", first()).filter(F.col("k") <= sample)
    lists = kept.groupBy(F.col("host").alias("_lh"), F.col("start").alias("_ls")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "row_num"))), lambda x: x["row_num"]).alias("sample_rows"))
    samples = counts.join(lists, F.col("host").eqNullSafe(F.col("_lh")) & F.col("start").eqNullSafe(F.col("_ls"))).select(F.col("host").alias("_h"), F.col("start").alias("_s"), "rows", "sample_rows")
    out = totals.join(samples, F.col("host").eqNullSafe(F.col("_h")) & F.col("start").eqNullSafe(F.col("_s"))).withColumn("tactic_count", F.size("tactics"))
    score = F.least(F.lit(100), F.col("top") + 10 * (F.col("tactic_count") - 1)).alias("score")
    return out.select("host", score, "tactic_count", "tactics", F.slice("all_techniques", 1, names).alias("techniques"), "sample_rows", "event_count", "rows", "first_epoch_ms", "last_epoch_ms", "first_row", "last_row")


def _tactics_ahead(timed: DataFrame, window_ms: int, most: int = 64) -> DataFrame:
    """(host, epoch_ms, n): how many tactics have an event from each one up to ``window_ms`` later.

    A host is cut into slices of a window's length, and every event also goes to the slice before its own: all that
    can follow an event within a window is in its slice then, and no task has a whole host.

    Read backward in time, the last event seen of each tactic is its next one: a running minimum for each tactic (of
    which there are as many as the library has), whatever the number of events in a window.
    """
    kinds = sorted(r[0] for r in timed.select("tactic_id").distinct().limit(most + 1).collect())
    own = _sliced("epoch_ms", window_ms)
    sliced = timed.groupBy("host", "epoch_ms", "tactic_id").agg(F.first(F.lit(1)).alias("_"))
    sliced = sliced.withColumn("own", own).select("host", "epoch_ms", "tactic_id", "own", F.explode(F.array(F.col("own"), F.col("own") - 1)).alias("slice"))
    if len(kinds) > most:
        ahead = W.partitionBy("host", "slice").orderBy("epoch_ms").rangeBetween(0, window_ms)
        counted = sliced.withColumn("n", F.size(F.collect_set("tactic_id").over(ahead)))
    else:
        back = W.partitionBy("host", "slice").orderBy(F.desc("epoch_ms")).rangeBetween(W.unboundedPreceding, 0)
        coming = sliced.withColumns({f"_next{i}": F.min(F.when(F.col("tactic_id") == k, F.col("epoch_ms"))).over(back) for i, k in enumerate(kinds)})
        n = sum((F.coalesce((F.col(f"_next{i}") <= F.col("epoch_ms") + window_ms).cast("int"), F.lit(0)) for i in range(len(kinds))), F.lit(0))
        counted = coming.withColumn("n", n)
    return counted.filter("slice = own").select("host", "epoch_ms", "n")


def _sliced(at: str, window_ms: int):
    """The slice of a host, a window long, that a time is in."""
    return F.floor(F.col(at) / window_ms).cast("long")


def _heads(starts: DataFrame, window_ms: int) -> DataFrame:
    """(host, at) of starts with none in the window before: these don't depend on earlier ones.

    ``starts``: host, at, all different. A start also stands in the slice after its own, so the one before any start
    is in its own slice if it is within a window.
    """
    own = _sliced("at", window_ms)
    told = starts.withColumn("own", own).withColumn("slice", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    before = F.lag("at").over(W.partitionBy("host", "slice").orderBy("at"))
    return told.withColumn("before", before).filter("slice = own").filter(F.col("before").isNull() | (F.col("at") - F.col("before") > window_ms)).select("host", "at")


def _next_starts(starts: DataFrame, window_ms: int) -> DataFrame:
    """(host, at, to): the first start beyond the window of each one, where that isn't a head anyway.

    A next start that is no head follows another one by a window at most, so it is within two windows. Each start
    asks at the end of its window; starts answer in their own slice and the one before. Read backward in time, the last
    start seen is the next one, so a task keeps one value whatever is in a slice.
    """
    ask = starts.select("host", (F.col("at") + window_ms).alias("t"), F.lit(True).alias("asks"), "at").withColumn("slice", _sliced("t", window_ms))
    answer = starts.select("host", F.col("at").alias("t"), F.lit(False).alias("asks"), F.lit(None).cast("long").alias("at"))
    answer = answer.withColumn("slice", F.explode(F.array(_sliced("t", window_ms), _sliced("t", window_ms) - 1)))
    back = W.partitionBy("host", "slice").orderBy(F.desc("t"), F.desc("asks")).rowsBetween(W.unboundedPreceding, 0)
    seen = F.last(F.when(~F.col("asks"), F.col("t")), ignorenulls=True).over(back)
    return ask.unionByName(answer).withColumn("to", seen).filter("asks and to is not null").select("host", "at", "to")


def chosen_starts(starts: DataFrame, window_ms: int) -> DataFrame:
    """(host, at) of windows that don't overlap: from the first start of each host, always the first beyond the last window.

    ``starts``: host (not null), at, all different. Every start points to the next one after its window; what the
    pointers reach from the heads (``_heads``) is chosen. Pointers are doubled: after n rounds they lead over 2**n
    windows and the reached ones are all within as many of a head, so there are as many rounds as the logarithm of
    the longest series of windows without a break. Every step is a join on (host, time): no host and no stretch is held
    whole or put in order.
    """
    reached = cut(_heads(starts, window_ms))
    jump = cut(_next_starts(starts, window_ms))
    while True:
        more = reached.join(jump, ["host", "at"]).select("host", F.col("to").alias("at")).distinct()
        more = cut(more.join(reached, ["host", "at"], "left_anti"))
        if more.isEmpty():
            return reached
        reached = cut(reached.union(more))
        ahead = jump.select("host", F.col("at").alias("to"), F.col("to").alias("far"))
        jump = cut(jump.join(ahead, ["host", "to"]).select("host", "at", F.col("far").alias("to")))


def attack_chains(matches: DataFrame, df: DataFrame, row_time: DataFrame | None = None, host: str | None = None, window_ms: int = HOUR, least_tactics: int = 3, cap: int | None = 200_000, keep: int | None = 200) -> DataFrame:
    """Chains ranked from 1: tactics, score and events descending, then first row.

    Per host, from the earliest unused event all events up to ``window_ms`` later form a window; with
    ``least_tactics`` tactics it is a chain and the next starts after it, else one event is passed over. Rows
    without a time drop out. Without ``row_time`` a host's events are one window.

    The timed events are written once. Possible starts are found in slices of a host (``_tactics_ahead``), those that
    don't overlap by doubled pointers (``chosen_starts``), and events meet them by host and slice.
    """
    events = _events(matches, df, host, cap)
    if row_time is None:
        every = events.withColumns({"start": F.lit(None).cast("long"), "epoch_ms": F.lit(None).cast("long")})
        found = _records(every).filter(F.col("tactic_count") >= least_tactics)
    else:
        # a host's name gets a letter in front, so that no host has a name, too, that joins can meet
        named = F.coalesce(F.concat(F.lit("="), "host"), F.lit(""))
        timed = cut(events.join(row_time.select("row_num", "epoch_ms"), "row_num").withColumn("host", named))
        ahead = _tactics_ahead(timed, window_ms)
        starts = cut(ahead.filter(F.col("n") >= least_tactics).select("host", F.col("epoch_ms").alias("at")).distinct())
        first = chosen_starts(starts, window_ms)
        # a window reaches into the slice after that of its start
        reach = first.select("host", F.col("at").alias("start"), F.explode(F.array(_sliced("at", window_ms), _sliced("at", window_ms) + 1)).alias("slice"))
        events_ = timed.select("host", "epoch_ms", "row_num", "tactic_id", "technique_name", "score", _sliced("epoch_ms", window_ms).alias("slice"))
        inside = events_.join(reach, ["host", "slice"]).filter(F.col("epoch_ms").between(F.col("start"), F.col("start") + window_ms)).drop("slice")
        found = _records(inside).withColumn("host", F.when(F.col("host") != "", F.substring("host", 2, 1 << 30)))
    rank = [F.desc("tactic_count"), F.desc("score"), F.desc("event_count"), "first_row"]
    best = found.orderBy(*rank).limit(keep) if keep else found
    # at most ``keep`` rows are numbered
    return best.withColumn("chain_id", F.row_number().over(W.orderBy(*rank))) if keep else best


def timeline(df: DataFrame, matches: DataFrame, row_time: DataFrame | None = None, tactics: list[str] | None = None, techniques: list[str] | None = None, user: tuple[str, str] | None = None) -> DataFrame:
    """Rows with a match of the tactics or the techniques (all matches if neither is given), chronological.

    Without ``row_time`` the order is the rows'; with it, rows that have no time drop out. ``user``: column and value.
    """
    from logsift.functions.text import ascii_lower

    wanted = matches
    if tactics or techniques:
        wanted = matches.filter(F.col("tactic_id").isin(list(tactics or [])) | F.col("technique_id").isin(list(techniques or [])))
    found = df.join(wanted.select("row_num"), "row_num", "left_semi")
    if user:
        found = found.filter(ascii_lower(F.col(f"`{user[0]}`")) == ascii_lower(F.lit(user[1])))
    if row_time is None:
        return found.orderBy("row_num")
    return found.join(row_time.select("row_num", "epoch_ms", "utc_text"), "row_num").orderBy("epoch_ms", "row_num")


def resolve_identity(df: DataFrame, column: str, value: str, most: int = 16, keep: int = 3) -> DataFrame:
    """Spellings of a user: the value itself and, for a bare name, DOMAIN\\name and name@domain; overflow beyond ``most``.

    One spelling (the smallest) for each folded value; at most ``keep`` well-formed ones are returned.
    """
    from logsift.functions.text import ascii_lower
    from logsift.functions.values import is_user_value

    c = F.col(f"`{column}`").cast("string")
    low, name = ascii_lower(c), ascii_lower(F.lit(value))
    same = low == name
    if "\\" not in value and "@" not in value:
        same = same | low.endswith(F.concat(F.lit("\\"), name)) | low.startswith(F.concat(name, F.lit("@")))
    found = df.filter(same & (F.char_length(c) <= 256)).groupBy(low.alias("_low")).agg(F.min(c).alias("user")).orderBy("_low").limit(most + 1)
    told = found.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("_low", "user"))).alias("all"))
    users = F.slice(F.filter(F.transform("all", lambda x: x["user"]), lambda u: (u == trim(u)) & is_user_value(u)), 1, keep)
    return told.select((F.col("n") > most).alias("overflow"), F.explode_outer(users).alias("user"))
