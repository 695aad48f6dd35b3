"""CSV files with line breaks inside quotes, read by many tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COUNTS = "file string, start long, open0 boolean, open1 boolean, records0 long, records1 long"


def ends_open(line: str, inside: bool) -> bool:
    """Whether the line ends inside a quoted cell, if it begins inside one (or, else, with a record).

    A quote opens a cell only as its first character; doubled ones are text. What follows a closing quote belongs to the
    cell, up to the next comma.
    """
    at = 0
    while True:
        if not inside and line[at : at + 1] == '"':
            inside, at = True, at + 1
        if inside:
            at = line.find('"', at)
            while at >= 0 and line[at + 1 : at + 2] == '"':
                at = line.find('"', at + 2)
            if at < 0:
                return True
            inside, at = False, at + 1
        at = line.find(",", at) + 1
        if not at:
            return False


def _blocks(batches, handler):
    """Call ``handler(file, start)`` for each file block, then its ``lines(values)`` for each batch of its lines and ``end()``."""
    now, work = None, None
    for batch in batches:
        file, start = batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
        if not batch.num_rows:
            continue
        file = file.dictionary_encode()
        key = np.stack([file.indices.to_numpy(zero_copy_only=False).astype(np.int64), start])
        edge = np.append(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, batch.num_rows)
        low = 0
        for high in edge.tolist():
            this = (file[low].as_py(), int(start[low]))
            if this != now:
                if work is not None:
                    yield from work.end()
                now, work = this, handler(*this)
            yield from work.lines(batch.column(0).slice(low, high - low))
            low = high
    if work is not None:
        yield from work.end()


def _shape(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the lines with a quote, and which lines hold more than a carriage return."""
    quoted = np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False))
    return quoted, ~pc.is_in(values, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)


def _stretches(quoted: np.ndarray, n: int):
    """(low, high, line with a quote or None): runs of lines without a quote between single lines with one."""
    low = 0
    for q in quoted.tolist():
        if q > low:
            yield low, q, False
        yield q, q + 1, True
        low = q + 1
    if n > low:
        yield low, n, False


class _Count:
    """What a block does to the state: how it ends and how many records begin in it, for either state at its start."""

    def __init__(self, file: str, start: int):
        self.key, self.open, self.records = (file, start), [False, True], [0, 0]

    def lines(self, values):
        quoted, full = _shape(values)
        for low, high, has in _stretches(quoted, len(values)):
            count = int(full[low:high].sum())
            line = values[low].as_py() if has else None
            for s in (0, 1):
                if not self.open[s]:
                    self.records[s] += count
                if has:
                    self.open[s] = ends_open(line, self.open[s])
        yield from ()

    def end(self):
        yield pa.RecordBatch.from_pylist([dict(zip((c.split()[0] for c in _COUNTS.split(", ")), (*self.key, *self.open, *self.records)))], schema=pa.schema([("file", pa.string()), ("start", pa.int64()), ("open0", pa.bool_()), ("open1", pa.bool_()), ("records0", pa.int64()), ("records1", pa.int64())]))


def _records(inside: bool, number: int, order: int, fragments: bool):
    """Records of one block as (row, part, value): row counts a file's records from 0.

    Records that lie in the block whole are given out or, with ``fragments``, only the pieces of those that don't.
    """

    class Work:
        def __init__(self):
            self.open, self.row, self.held, self.began = inside, number - 1, [], not inside

        def _piece(self, whole):
            if self.held and whole != fragments:
                yield self.row, "\n".join(self.held)
            self.held = []

        def lines(self, values):
            out = []
            quoted, full = _shape(values)
            for low, high, has in _stretches(quoted, len(values)):
                if self.open:
                    self.held += values.slice(low, high - low).to_pylist()
                    if has:
                        self.open = ends_open(self.held[-1], True)
                        if not self.open:
                            out += self._piece(whole=self.began)
                            self.began = True
                elif has:
                    self.row += 1
                    self.held, line = [values[low].as_py()], values[low].as_py()
                    self.open = ends_open(line, False)
                    if not self.open:
                        out += self._piece(whole=True)
                else:
                    k = np.flatnonzero(full[low:high])
                    if not fragments:
                        out += zip(range(self.row + 1, self.row + 1 + len(k)), values.take(pa.array(k + low)).to_pylist())
                    self.row += len(k)
            yield from self._told(out)

        def _told(self, out):
            if out:
                row, value = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array([order] * len(row), pa.int64()), pa.array(value, pa.string())], names=["row", "part", "value"])

        def end(self):
            yield from self._told(list(self._piece(whole=False)))

    return Work()


def read_quoted(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """row_num and the columns of ``schema`` of CSV files whose quoted cells may hold line breaks; any file is split.

    Files are read as lines, which Spark splits. A first pass tells of each block, for both states in which it may begin
    (with a record or inside quotes), how it ends and how many records begin in it: one row a block comes to the
    driver, which follows the states through each file. In the second pass every block knows its state and the number of
    its first record. Only records that cross a block's end are put together by their number; whatever is read then is
    parsed record by record. Row numbers follow the paths of the files and the places in them.

    Defined cases: each file's first record is its header and left out; lines that are empty, outside quotes, are
    no records; lines end with ``\\n`` or ``\\r\\n``; a quote that is never closed reaches to the end of its file;
    quoted line
    breaks stay as they are; short rows are filled with null, extra cells dropped.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    blocks = sorted(lines.mapInArrow(lambda batches: _blocks(batches, _Count), _COUNTS).collect())
    told, crossing, base, file, inside, number = {}, [], 0, None, False, 0
    for order, b in enumerate(blocks):
        if b["file"] != file:
            base, file, inside, number = base + max(number - 1, 0), b["file"], False, 0
        after = b["open1"] if inside else b["open0"]
        told[b["file"], b["start"]] = (inside, number, order, base)
        if inside or after:
            crossing.append((b["file"], b["start"]))
        number += b["records1"] if inside else b["records0"]
        inside = after
    shared = spark.sparkContext.broadcast(told)

    def work(fragments):
        def scan(batches):
            base = 0

            def begin(file, start):
                nonlocal base
                inside, number, order, base = shared.value[file, start]
                return _records(inside, number, order, fragments)

            for out in _blocks(batches, begin):
                row = out.column(0)
                yield pa.RecordBatch.from_arrays([pc.add(row, base), out.column(1), out.column(2)], names=["row", "part", "value"]).filter(pc.greater(row, 0))

        return scan

    kind = "row long, part long, value string"
    whole = lines.mapInArrow(work(False), kind).select("row", "value")
    if crossing:
        cut_ = spark.createDataFrame(crossing, "file string, start long")
        pieces = lines.join(F.broadcast(cut_), ["file", "start"]).select("value", "file", "start").mapInArrow(work(True), kind)
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "value"))), lambda x: x["value"]), "\n")
        whole = whole.unionByName(pieces.groupBy("row").agg(joined.alias("value")))
    value = F.regexp_replace("value", "\r$", "")
    parsed = F.from_csv(value, ", ".join(f"`{f.name}` string" for f in schema), {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    return whole.select(F.col("row").alias("row_num"), parsed.alias("r")).select("row_num", "r.*")
