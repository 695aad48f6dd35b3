"""Chat formatting with a grammar round trip."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm.common import table

# The template: a turn is "### role: text</turn>\n". A backslash before a control string, or before another
# backslash, makes it ordinary text.
_TEXT = re.compile(r"\\(?:\\|###|</turn>)|###|</turn>")
_ROLE = re.compile(r"\\(?:\\|###|</turn>|:)|###|</turn>|: ")
_TEXT_ESCAPED = re.compile(r"\\(\\|###|</turn>)")
_ROLE_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
TURNS = "array<struct<role:string,text:string>>"


class NotInGrammar(ValueError):
    """The text isn't a sequence of turns."""


def escape(text: str, role: bool = False) -> str:
    out = text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")
    return out.replace(":", "\\:") if role else out


def _upto(pattern: re.Pattern, end: str, text: str, at: int) -> int:
    """Where the first unescaped ``end`` stands; another unescaped control string is an error."""
    for m in pattern.finditer(text, at):
        if m[0] == end:
            return m.start()
        if m[0][0] != "\\":
            break
    raise NotInGrammar(f"no {end!r} after {at}")


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn: one reading only, left to right; start and end bound the escaped text."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith("### ", at):
            raise NotInGrammar(f"no turn at {at}")
        colon = _upto(_ROLE, ": ", text, at + 4)
        end = _upto(_TEXT, "</turn>", text, colon + 2)
        if not text.startswith("\n", end + 7):
            raise NotInGrammar(f"no line end at {end + 7}")
        turns.append((_ROLE_ESCAPED.sub(r"\1", text[at + 4 : colon]), _TEXT_ESCAPED.sub(r"\1", text[colon + 2 : end]), colon + 2, end))
        at = end + 8
    return turns


def _reads(rendered: str, role: str, text: str) -> bool:
    try:
        return [x[:2] for x in parse(rendered)] == [(role, text)]
    except NotInGrammar:
        return False


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[str, str, int, int]], int]:
    """The formatted conversation, its turns as read back, and how many turns had to be escaped.

    A turn goes in as it is; if it isn't read back the same, its text is escaped, then its role too. The whole
    is parsed again and must give the source.
    """
    out, escaped = [], 0
    for role, text in turns:
        tries = ((role, text), (role, escape(text)), (escape(role, True), escape(text)))
        for k, (r, t) in enumerate(tries):
            if _reads(one := f"### {r}: {t}</turn>\n", role, text):
                break
        else:
            raise NotInGrammar("a turn can't be formatted")
        escaped += k > 0
        out.append(one)
    formatted = "".join(out)
    back = parse(formatted)
    if [x[:2] for x in back] != list(turns):
        raise NotInGrammar("the conversation isn't read back the same")
    return formatted, back, escaped


def format_chats(rows: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, formatted, loss (half-open code-point ranges), n_turns and n_escaped.

    Method: a conversation is rendered, reparsed by a deterministic parser and compared with its source; turns
    that aren't read back the same are escaped until they are. ``loss`` covers the escaped text of each turn of
    role ``learn`` and nothing of the template. Turns sort by turn, then role and text, where numbers tie.

    A conversation's text is one value, so its turns meet in one row; conversations are spread by their id.

    Defined cases: null text or role is empty; rows without conv_id are one conversation; repeated rows are
    repeated turns; an empty table gives an empty result; other columns are ignored.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), text("role"), text("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("n_turns", pa.int64()), ("n_escaped", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1)):
                formatted, back, escaped = render([(x["role"].as_py(), x["text"].as_py()) for x in turns.values])
                out.append((conv, formatted, [{"start": a, "end": b} for role, _, a, b in back if role == learn], len(back), escaped))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return whole.mapInArrow(scan, "conv_id long, formatted string, loss array<struct<start:long,end:long>>, n_turns long, n_escaped long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Add the turns of each formatted conversation and the unescaped text under its loss ranges."""
    schema = pa.schema([("conv_id", pa.int64()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("loss_text", pa.string()), ("formatted_chars", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for conv, text, loss in zip(*(batch.column(i).to_pylist() for i in range(3))):
                turns = [{"role": r, "text": t} for r, t, _, _ in parse(text)]
                learned = "".join(_TEXT_ESCAPED.sub(r"\1", text[x["start"] : x["end"]]) for x in loss)
                out.append((conv, turns, learned, len(text)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(scan, f"conv_id long, turns {TURNS}, loss_text string, formatted_chars long")


#: The conversation that the contract adds.
PROBE = r"\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: digests of all formatted conversations, read back from the formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    back = read_back(format_chats(rows.unionByName(probe)))
    line = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest(F.array_join(line, "")).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), digest(F.col("loss_text")).alias("loss_sha256"), "formatted_chars")


ORACLE_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, CASE WHEN regexp_matches(text, '###|</turn>|\\\\|\\$')
    THEN length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) ELSE length(text) END AS body
  FROM rows_)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + body + 8) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
