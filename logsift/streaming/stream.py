"""Streaming forms: scans without state, new documents, chains by host."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logsift.operators import activity, matching
from logsift.operators.documents import Limits, document_key, row_documents
from logsift.spec import ColumnMeta


def labelled(stream: DataFrame, meta: list[ColumnMeta], roles: dict) -> DataFrame:
    """Activity labels of a stream: the batch operator, which keeps no state."""
    return activity.classify_activity(stream, meta, roles)


def matched(stream: DataFrame, library: matching.Library, meta: list[ColumnMeta], roles: dict) -> DataFrame:
    """Keyword and rule matches of a stream."""
    return matching.scan(stream, library, meta, roles)


def new_documents(stream: DataFrame, meta: list[ColumnMeta], modes: dict[str, str], event_time: str, delay: str = "1 hour", limits: Limits = Limits()) -> DataFrame:
    """Documents not seen within ``delay``: the state holds one key a document until the watermark passes it."""
    timed = stream.withWatermark(event_time, delay)
    rows = row_documents(timed, meta, modes, limits)
    joined = rows.select(document_key().alias("doc_key"), "row_num", "kind", "column_key", "text")
    return joined.dropDuplicates(["doc_key"])


def count_by_window(stream: DataFrame, event_time: str, by: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events of each kind by event-time window; late rows beyond the watermark drop out."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


_CHAIN = "host string, first_epoch_ms long, last_epoch_ms long, tactic_count int, event_count long"


def chains_by_host(stream: DataFrame, event_time: str, delay: str = "10 minutes", window_ms: int = 3_600_000, least_tactics: int = 3) -> DataFrame:
    """Chains of a stream of (host, tactic_id, ``event_time``): a host's events wait until the watermark has passed a window after the first.

    The state of a host is the events of its open window; what is decided leaves. Events later than the watermark
    are dropped, so the result can differ from the batch's for those.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        epochs, tactics = (list(x) for x in state.get) if state.exists else ([], [])
        for frame in frames:
            epochs += frame["epoch_ms"].astype("int64").tolist()
            tactics += frame["tactic_id"].astype(str).tolist()
        order = sorted(range(len(epochs)), key=lambda i: epochs[i])
        epochs, tactics = [epochs[i] for i in order], [tactics[i] for i in order]
        limit = state.getCurrentWatermarkMs()
        out = []
        while epochs and epochs[0] + window_ms < limit:
            n = sum(1 for e in epochs if e <= epochs[0] + window_ms)
            kinds = len(set(tactics[:n]))
            if kinds < least_tactics:
                n = 1
            else:
                out.append((key[0], epochs[0], epochs[n - 1], kinds, n))
            epochs, tactics = epochs[n:], tactics[n:]
        if epochs:
            state.update((epochs, tactics))
            state.setTimeoutTimestamp(max(epochs[0] + window_ms + 1, limit + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["host", "first_epoch_ms", "last_epoch_ms", "tactic_count", "event_count"])

    timed = stream.withWatermark(event_time, delay).select("host", "tactic_id", F.unix_millis(event_time).alias("epoch_ms"), event_time)
    return timed.groupBy("host").applyInPandasWithState(step, _CHAIN, "epochs array<long>, tactics array<string>", "append", GroupStateTimeout.EventTimeTimeout)
