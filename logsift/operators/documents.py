"""Deduplicated text documents of log rows, and vector retrieval over them."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from logsift.functions.text import informative, normalize_tokens, text, trim, word_chunks
from logsift.functions.values import parse_ip
from logsift.operators.rules import suppress
from logsift.operators.selection import even_share
from logsift.spec import ColumnMeta
from logsift.storage import cut, spread

# Headers of columns that are only compared whole, and of columns that hold prose.
EXACT = ("timestamp", "time generated", "date", "source ip", "src ip", "destination ip", "dst ip", "address", "hash", "guid", "uuid", "sid", "account", "user name", "username", "computer", "device name", "host name", "hostname", "report id", "session id", "port", "id")
PROSE = ("message", "description", "command", "script", "process", "parent", "file name", "filename", "alert", "activity", "status", "severity", "rule", "threat", "action", "operation", "detail", "summary", "narrative", "evidence", "payload", "reason")


@dataclass(frozen=True)
class Limits:
    """Bounds of what one row and one build give; None takes a bound away."""

    sample_rows: int | None = 4096
    chunk_words: int = 72
    overlap_words: int = 12
    chunks_per_cell: int = 4
    document_chars: int = 2048
    cell_chars: int = 16_384
    primary_columns: int = 48
    extra_chunks: int = 15
    documents_per_row: int = 64
    documents: int | None = 100_000
    mappings: int | None = 6_000_000


def _words(name: str) -> str:
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    return f" {' '.join(re.findall('[a-z0-9]+', spaced.lower()))} "


def _header(meta: ColumnMeta, phrases: tuple[str, ...]) -> bool:
    keys = (_words(meta.original), _words(meta.name))
    return any(f" {p} " in key for p in phrases for key in keys)


def column_modes(df: DataFrame, meta: list[ColumnMeta], sample_rows: int | None = 4096) -> dict[str, str]:
    """text, exact_only or categorical for each column, from its header and a profile of its values.

    ``sample_rows``: rows numbered up to it, None for all. One grouped aggregate, six numbers a column.
    """
    rows = df.filter(F.col("row_num") <= sample_rows) if sample_rows else df
    cells = rows.select(F.explode(F.array(*[F.struct(F.lit(m.name).alias("column"), trim(text(f"`{m.name}`")).alias("v")) for m in meta])).alias("x")).select("x.*").filter("v <> ''")
    v = F.col("v")
    dynamic = v.try_cast("double").isNotNull() | parse_ip(v).isNotNull() | v.rlike(r"(?i)^s-1-[0-9s-]*$") | v.rlike("^[0-9a-fA-F]{16,}$") | v.rlike(r"^(?=.{36}$)(?:[0-9a-fA-F]*-){4}[0-9a-fA-F]*$")
    stats = cells.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.count_if(dynamic).alias("dynamic"), F.avg(F.char_length("v")).alias("chars"), F.avg(F.size(F.split("v", r"\s+"))).alias("words"), F.count_distinct(F.lower("v")).alias("distinct"))
    found = {r["column"]: r for r in stats.collect()}
    modes = {}
    for m in meta:
        s = found.get(m.name)
        n, ratio = (s["n"], s["distinct"] / s["n"]) if s else (0, 0.0)
        if _header(m, PROSE) and not _header(m, EXACT):
            modes[m.name] = "text"
        elif _header(m, EXACT) or m.hint in ("timestamp", "ip", "identifier", "number", "numeric"):
            modes[m.name] = "exact_only"
        elif n >= 16 and (s["dynamic"] / n >= 0.8 or (ratio >= 0.8 and s["chars"] <= 128 and s["words"] <= 3)):
            modes[m.name] = "exact_only"
        else:
            modes[m.name] = "categorical" if not s or s["distinct"] <= 128 or ratio <= 0.1 else "text"
    return modes


def _balanced(cells: Column, most: int) -> Column:
    """At most ``most`` entries, evenly picked, the last always among them."""
    n = F.size(cells)
    picked = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda s: F.get(cells, F.floor(s * (n - 1) / F.lit(max(most - 1, 1))).cast("int")))
    return F.when(n <= most, cells).otherwise(picked)


def row_documents(df: DataFrame, meta: list[ColumnMeta], modes: dict[str, str], limits: Limits = Limits()) -> DataFrame:
    """row_num, kind, column_key, text, ord: the documents of each row, within the row; no shuffle.

    Every eligible cell gives its first chunk before any gives a second; wide rows are picked from evenly; two or
    more categorical cells also give a row_context.
    """
    entries, values = [], {}
    for i, m in enumerate(meta):
        if modes[m.name] == "exact_only":
            continue
        label = m.original.strip().lower() or m.name.replace("_", " ")
        values[f"v{i}"] = normalize_tokens(F.substring(trim(text(f"`{m.name}`")), 1, limits.cell_chars))
        value = F.col(f"v{i}")  # a step of its own: it is used twice
        chunks = word_chunks(value, limits.chunk_words, limits.overlap_words, None, limits.document_chars, None)
        entries.append(F.when(informative(value), F.struct(F.lit(m.name).alias("column_key"), F.lit(label).alias("label"), F.lit(modes[m.name] == "categorical").alias("categorical"), chunks.alias("chunks"))))
    if not entries:
        return df.select("row_num").filter(F.lit(False)).selectExpr("row_num", "'' as kind", "'' as column_key", "'' as text", "0 as ord")
    one = lambda cell, chunk: F.substring(F.concat(cell["label"], F.lit(": "), chunk), 1, limits.document_chars)
    rows = df.select("row_num", *[v.alias(k) for k, v in values.items()])
    rows = rows.select("row_num", F.array_compact(F.array(*entries)).alias("cells")).select("row_num", _balanced(F.col("cells"), limits.primary_columns).alias("cells"))
    document = lambda kind, key, body: F.struct(F.lit(kind).alias("kind"), key.alias("column_key"), body.alias("text"))
    first = F.transform("cells", lambda c: document("cell", c["column_key"], one(c, F.get(c["chunks"], F.lit(0)))))
    more = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(limits.chunks_per_cell - 1)), lambda r: F.transform(F.filter("cells", lambda c: F.size(c["chunks"]) > r), lambda c: document("cell_chunk", c["column_key"], one(c, F.get(c["chunks"], r))))))
    parts = F.transform(F.filter("cells", lambda c: c["categorical"]), lambda c: one(c, F.get(c["chunks"], F.lit(0))))
    context = F.when(F.size(parts) >= 2, F.array(document("row_context", F.lit(""), F.substring(F.array_join(parts, " | "), 1, limits.document_chars)))).otherwise(F.array().cast("array<struct<kind:string,column_key:string,text:string>>"))
    room = F.greatest(F.lit(0), F.least(F.lit(limits.extra_chunks), limits.documents_per_row - F.size("cells")))
    every = F.slice(F.concat(first, F.slice(more, F.lit(1), room), context), 1, limits.documents_per_row)
    return rows.filter(F.size("cells") > 0).select("row_num", F.posexplode(every).alias("ord", "d")).select("row_num", "d.*", "ord")


def document_key() -> Column:
    """sha256 of kind, column and text, each with its length in front."""
    part = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), F.col(c))
    return F.sha2(F.concat(part("kind"), part("column_key"), part("text")).cast("binary"), 256)


def mapped_documents(rows: DataFrame, meta: list[ColumnMeta], modes: dict[str, str], limits: Limits = Limits()) -> DataFrame:
    """doc_key, row_num, kind, column_key, text of all documents of all rows."""
    every = row_documents(rows, meta, modes, limits)
    return every.select(document_key().alias("doc_key"), "row_num", "kind", "column_key", "text")


def build_documents(df: DataFrame, meta: list[ColumnMeta], ignored: DataFrame | None = None, modes: dict[str, str] | None = None, limits: Limits = Limits(), stored: DataFrame | None = None, mapped: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, doc_rows): each text once by its key, and the rows that have it.

    ``stored`` documents (doc_key) are left out of ``documents``, so that a later build embeds only what is new.
    The limits of a build always hold and are filled. They are spread evenly over the table (``even_share``):
    documents by the first row that has them, then their mappings by row. What is left out shows in ``coverage``.
    The documents of the rows are made and written once; ``mapped`` is a written table of ``mapped_documents`` to use.
    """
    rows = suppress(spread(df), ignored) if mapped is None else df
    if mapped is None:
        mapped = cut(mapped_documents(rows, meta, modes or column_modes(df, meta, limits.sample_rows), limits))
    first = [F.min("kind").alias("kind"), F.min("column_key").alias("column_key"), F.min("text").alias("text"), F.min("row_num").alias("_row")]
    documents = mapped.groupBy("doc_key").agg(*first)
    doc_rows = mapped.select("doc_key", "row_num").distinct()
    if limits.documents is not None or limits.mappings is not None:
        span = df.agg(F.min("row_num"), F.max("row_num")).first()
        documents = even_share(documents, "_row", "doc_key", limits.documents, span)
        if limits.documents is not None:
            doc_rows = doc_rows.join(documents.select("doc_key"), "doc_key", "left_semi")
        pair = F.sha2(F.concat_ws(":", "doc_key", "row_num").cast("binary"), 256)
        doc_rows = even_share(doc_rows.withColumn("_pair", pair), "row_num", "_pair", limits.mappings, span).drop("_pair")
    if stored is not None:
        documents = documents.join(stored.select("doc_key"), "doc_key", "left_anti")
    return documents.drop("_row"), doc_rows


def left_out(df: DataFrame, meta: list[ColumnMeta], modes: dict[str, str], limits: Limits = Limits()) -> DataFrame:
    """One row: cells cut at their length, columns and chunks that rows have beyond their limits."""
    cells = []
    for m in meta:
        if modes[m.name] != "exact_only":
            cell = trim(text(f"`{m.name}`"))
            value = normalize_tokens(F.substring(cell, 1, limits.cell_chars))
            words = F.size(F.filter(F.split(value, r"\s+"), lambda w: w != ""))
            chunks = F.greatest(F.lit(1), F.ceil((words - limits.overlap_words) / F.lit(limits.chunk_words - limits.overlap_words))).cast("int")
            cells.append(F.when(informative(value), F.struct((F.char_length(cell) > limits.cell_chars).alias("long"), chunks.alias("chunks"))))
    if not cells:
        return df.agg(*[F.lit(0).cast("long").alias(c) for c in ("cells_truncated", "columns_omitted", "chunks_omitted")])
    rows = df.select(F.array_compact(F.array(*cells)).alias("cells")).withColumn("taken", _balanced(F.col("cells"), limits.primary_columns))
    room = F.greatest(F.lit(0), F.least(F.lit(limits.extra_chunks), limits.documents_per_row - F.size("taken")))
    sums = lambda c, one: F.aggregate(c, F.lit(0), lambda a, x: a + one(x))
    more = sums("taken", lambda x: F.least(x["chunks"], F.lit(limits.chunks_per_cell)) - 1)
    all_more = sums("taken", lambda x: x["chunks"] - 1)
    per_row = rows.select(sums("taken", lambda x: x["long"].cast("int")).alias("t"), (F.size("cells") - F.size("taken")).alias("c"), (all_more - F.least(more, room)).alias("k"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per_row.agg(total("t").alias("cells_truncated"), total("c").alias("columns_omitted"), total("k").alias("chunks_omitted"))


def coverage(df: DataFrame, meta: list[ColumnMeta], doc_rows: DataFrame, modes: dict[str, str], limits: Limits = Limits(), ignored: DataFrame | None = None, mapped: DataFrame | None = None) -> DataFrame:
    """One row: documents and mappings seen, kept and left out; rows covered; what ``left_out`` counts.

    ``mapped``: as in ``build_documents``.
    """
    rows = suppress(spread(df), ignored)
    every = (mapped if mapped is not None else mapped_documents(rows, meta, modes, limits)).select("doc_key", "row_num").distinct()
    seen = every.agg(F.count_distinct("doc_key").alias("documents_seen"), F.count(F.lit(1)).alias("mappings_seen"))
    kept = doc_rows.agg(F.count_distinct("doc_key").alias("documents_mapped"), F.count(F.lit(1)).alias("mappings_written"), F.count_distinct("row_num").alias("rows_covered"))
    both = seen.join(F.broadcast(kept)).withColumns({"documents_skipped": F.col("documents_seen") - F.col("documents_mapped"), "mappings_skipped": F.col("mappings_seen") - F.col("mappings_written")})
    return both.join(F.broadcast(left_out(rows, meta, modes, limits)))


# --- vectors -------------------------------------------------------------------------------------------------


def unit(c: Column) -> Column:
    """A vector of length 1; null for a zero one."""
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(c, lambda x: x.cast("double") / norm))


def dot(c: Column, vector: list[float]) -> Column:
    constant = F.array(*[F.lit(float(x)) for x in vector])
    return F.aggregate(F.zip_with(c, constant, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def vector_scores(documents: DataFrame, vector: list[float], min_score: float = 0.38, key: str = "doc_key", column: str = "embedding") -> DataFrame:
    """key, score of the documents whose cosine to the query is ``min_score`` or more: exact, one scan."""
    scored = documents.select(key, F.round(dot(unit(F.col(column)), vector), 6).alias("score"))
    return scored.filter(F.col("score") >= min_score)


def vector_top_k(documents: DataFrame, vector: list[float], k: int = 256, min_score: float = 0.38, key: str = "doc_key", column: str = "embedding") -> DataFrame:
    """The ``k`` (1024 at most) best of ``vector_scores``, ties by key."""
    return vector_scores(documents, vector, min_score, key, column).orderBy(F.desc("score"), key).limit(min(max(k, 1), 1024))


#: So many questions are compared at a time, at most.
QUESTIONS = 1024


def vectors_top_k(documents: DataFrame, questions: DataFrame, k: int = 256, min_score: float = 0.38, key: str = "doc_key", column: str = "embedding") -> DataFrame:
    """question, key, score: for each of several questions what ``vector_top_k`` gives, in one scan.

    ``questions``: question and ``column``, up to ``QUESTIONS`` rows, which go to every task. Blocks of vectors are
    multiplied by all of them at a time; a task keeps the best ``k`` of each question, and those of all tasks are
    merged. Null and zero vectors, and those of another length, have no score.
    """
    k = min(max(k, 1), 1024)
    asked = questions.select("question", F.col(column).cast("array<double>").alias("v")).limit(QUESTIONS + 1).collect()
    if len(asked) > QUESTIONS:
        raise ValueError(f"more than {QUESTIONS} questions at once")
    kinds = dict(documents.dtypes)[key], dict(questions.dtypes)["question"]
    kind = to_arrow_type(questions.schema["question"].dataType)
    by_size: dict[int, tuple[list, list]] = {}
    for name, v in asked:
        v = np.asarray([np.nan if x is None else x for x in v or []], np.float64)
        if len(v) and np.isfinite(v).all() and v.any():
            names, vectors = by_size.setdefault(len(v), ([], []))
            names.append(name)
            vectors.append(v / np.linalg.norm(v))
    shared = documents.sparkSession.sparkContext.broadcast({n: (names, np.stack(vectors)) for n, (names, vectors) in by_size.items()})

    def best(table: pa.Table) -> pa.Table:
        """The first ``k`` rows of each question by score, then key."""
        table = table.sort_by([("at", "ascending"), ("score", "descending"), (key, "ascending")])
        at = table.column("at").to_numpy()
        head = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
        return table.filter(pa.array(np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at)))) < k))

    def scan(batches):
        held: dict[int, pa.Table] = {}
        for batch in batches:
            vectors = batch.column(1)
            n = np.diff(np.asarray(vectors.offsets))
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            start = np.concatenate([[0], np.cumsum(np.where(vectors.is_null().to_numpy(zero_copy_only=False), 0, n))[:-1]])
            for size, (_, asked_) in shared.value.items():
                rows = np.flatnonzero((n == size) & ~vectors.is_null().to_numpy(zero_copy_only=False))
                for low in range(0, len(rows), 4096):
                    own = rows[low : low + 4096]
                    x = flat[start[own][:, None] + np.arange(size)].astype(np.float64)
                    norm = np.linalg.norm(x, axis=1)
                    score = np.where(norm[:, None] > 0, x / np.where(norm > 0, norm, 1)[:, None], np.nan) @ asked_.T
                    score = np.sign(score) * np.floor(np.abs(score) * 1e6 + 0.5) / 1e6
                    i, q = np.nonzero(score >= min_score)
                    found = pa.table({"at": pa.array(q, pa.int64()), key: batch.column(0).take(pa.array(own[i])), "score": pa.array(score[i, q])})
                    held[size] = best(pa.concat_tables([held[size], found]) if size in held else found)
        for size, table in held.items():
            names = pa.array(shared.value[size][0], kind).take(table.column("at").combine_chunks())
            yield from pa.table({"question": names, key: table.column(key), "score": table.column("score")}).to_batches()

    found = documents.select(key, F.col(column).cast("array<double>").alias("v")).mapInArrow(scan, f"question {kinds[1]}, `{key}` {kinds[0]}, score double")
    rank = F.row_number().over(W.partitionBy("question").orderBy(F.desc("score"), key))
    return found.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def select_rows(top: DataFrame, doc_rows: DataFrame) -> DataFrame:
    """Distinct rows of the retained documents."""
    return doc_rows.join(F.broadcast(top.select("doc_key")), "doc_key", "left_semi").select("row_num").distinct()


def disclosure(selected: DataFrame, df: DataFrame, above: DataFrame, top: DataFrame, many: int = 10_000, share: float = 0.25, covered: DataFrame | None = None) -> DataFrame:
    """One row: rows selected, the table's, documents above the threshold and retained, and whether that is broad or cut off.

    ``warnings`` say so in words and, with ``covered`` (the row of ``coverage``), what the documents themselves leave out.
    """
    n = lambda d, name: F.broadcast(d.agg(F.count(F.lit(1)).alias(name)))
    out = selected.agg(F.count(F.lit(1)).alias("rows_selected")).join(n(df, "rows_total")).join(n(above, "documents_above")).join(n(top, "documents_retained"))
    broad = (F.col("rows_selected") > many) | (F.col("rows_selected") > share * F.col("rows_total"))
    cut_off = F.col("documents_above") > F.col("documents_retained")
    told = [F.when(broad, F.lit("the selection is broad")), F.when(cut_off, F.concat((F.col("documents_above") - F.col("documents_retained")).cast("string"), F.lit(" documents above the threshold are not retained")))]
    parts = {"cells_truncated": "long cells cut", "columns_omitted": "columns of wide rows left out", "chunks_omitted": "chunks left out", "documents_skipped": "documents skipped", "mappings_skipped": "mappings of documents to rows skipped"}
    columns = out.columns
    if covered is not None:
        out = out.join(F.broadcast(covered.select(*parts)))
        said = F.array_join(F.array_compact(F.array(*[F.when(F.col(k) > 0, F.concat(F.col(k).cast("string"), F.lit(f" {v}"))) for k, v in parts.items()])), ", ")
        told.append(F.when(said != "", F.concat(F.lit("the documents are bounded: "), said, F.lit("; filters and searches read every row"))))
    return out.select(*columns, broad.alias("broad"), cut_off.alias("truncated"), F.array_compact(F.array(*told)).alias("warnings"))


def row_reasons(top: DataFrame, doc_rows: DataFrame, documents: DataFrame, k: int = 3) -> DataFrame:
    """row_num, reasons: the ``k`` best documents of each row as `semantic 0.512: text`."""
    told = doc_rows.join(F.broadcast(top), "doc_key").join(documents.select("doc_key", "text"), "doc_key")
    best = told.withColumn("k", F.row_number().over(W.partitionBy("row_num").orderBy(F.desc("score"), "doc_key"))).filter(F.col("k") <= k)
    line = F.concat(F.lit("semantic "), F.format_string("%.3f", F.col("score")), F.lit(": "), F.col("text"))
    return best.groupBy("row_num").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))), lambda x: x["line"]).alias("reasons"))


def row_top_k(scores: DataFrame, doc_rows: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` rows of the best document score."""
    return doc_rows.join(scores, "doc_key").groupBy("row_num").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "row_num").limit(k)


def freeze(top: DataFrame, doc_rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_key, rank, score, rows, row_digest of a selection; written to ``path`` if given.

    A document's digest covers its rows in order; ``selection_digest`` covers the documents. Later change shows in them.
    """
    ranked = top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "doc_key")))  # at most 1024 rows
    # rows are digested in blocks of row numbers, then the blocks, so that a document of all rows is no single list
    block = F.floor(F.col("row_num") / 65_536)
    joined = doc_rows.join(F.broadcast(ranked.select("doc_key")), "doc_key", "left_semi").distinct().withColumn("block", block)
    blocks = joined.groupBy("doc_key", "block").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("row_num")).cast("array<string>"), ",").cast("binary"), 256).alias("digest"))
    whole = blocks.groupBy("doc_key").agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "digest"))), lambda x: x["digest"]), ",").cast("binary"), 256).alias("row_digest"))
    out = ranked.join(whole, "doc_key", "left").select("rank", "doc_key", "score", F.coalesce("rows", F.lit(0)).alias("rows"), "row_digest")
    if path:
        out.write.mode("errorifexists").parquet(path)
    return out


def selection_digest(frozen: DataFrame) -> DataFrame:
    """One digest over a frozen selection (1024 documents at most)."""
    line = F.concat_ws("|", F.lpad(F.col("rank").cast("string"), 6, "0"), "doc_key", F.format_string("%.6f", F.col("score")), F.coalesce("row_digest", F.lit("")))
    return frozen.agg(F.count(F.lit(1)).alias("documents"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary"), 256).alias("digest"))
