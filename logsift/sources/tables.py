"""Log tables in and out: header clean-up, CSV, typed cells as text, row numbers, fingerprints, exports."""

from __future__ import annotations

import csv
import io
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.operators.filters import where
from logsift.operators.paging import order, time_order
from logsift.sources.quoted_csv import read_quoted
from logsift.spec import ColumnMeta, QuerySpec
from logsift.storage import cut

#: What the words in a header say about its column, in the order in which they are tried.
HINTS = (("timestamp", ("time", "date", "generated", "createdat")), ("ip", ("ip", "address")), ("identifier", ("id", "guid")))


def clean_headers(headers: list[str]) -> list[ColumnMeta]:
    """Names of lower-case letters, digits and single underscores, all different, none of them row_num."""
    taken, out = {"row_num"}, []
    for i, header in enumerate(headers):
        name = re.sub(r"[^a-z0-9]+", "_", "".join(c.lower() if c.isascii() else " " for c in header)).strip("_") or f"column_{i}"
        name = f"c_{name}" if name[0].isdigit() else name
        k, base = 2, name
        while name in taken:
            name, k = f"{base}_{k}", k + 1
        taken.add(name)
        low = header.lower()
        hint = next((h for h, words in HINTS if any(w in low for w in words)), "text")
        out.append(ColumnMeta(name, header.strip() or f"Column {i + 1}", hint))
    return out


def _largest(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file at a path."""
    where_ = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where_.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where_)
    sizes = [x.getLen() for f in found or [] for x in f.getPath().getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(f.getPath())]
    return max(sizes, default=0)


def read_log_csv(spark: SparkSession, path: str, number: bool = True, line_breaks: bool = True, split: bool | None = None) -> tuple[DataFrame, list[ColumnMeta]]:
    """A CSV file with a header as text columns: short rows are filled with '', extra cells dropped.

    Only the header comes to the driver. Rows are numbered from 1 in file order. With ``line_breaks`` a quoted cell may
    hold some. Files of more than one split are then read by many tasks that first settle which line breaks are
    quoted (``quoted_csv``); smaller ones by one task each. ``split`` decides that instead of the size.
    """
    first = [r[0] for r in spark.read.option("lineSep", "\n").text(path).limit(64).collect()]
    if not first:
        raise ValueError(f"{path} has no header")
    meta = clean_headers(next(csv.reader(io.StringIO("\n".join(x.rstrip("\r") for x in first).lstrip("\ufeff"), newline=""))))
    schema = T.StructType([T.StructField(m.name, T.StringType(), True, {"original": m.original, "hint": m.hint}) for m in meta])
    if split is None:
        limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
        split = line_breaks and _largest(spark, path) > limit
    cells = [F.coalesce(m.name, F.lit("")).alias(m.name, metadata=schema[m.name].metadata) for m in meta]
    if split:
        rows = read_quoted(spark, path, schema)
        return rows.select(*(["row_num"] if number else []), *cells), meta
    rows = spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", quote='"', escape='"', multiLine=line_breaks, enforceSchema=True)
    rows = rows.select(*cells)
    return (with_row_num(rows, scan=True) if number else rows), meta


def read_log_tables(spark: SparkSession, directory: str) -> dict[str, tuple[DataFrame, list[ColumnMeta]]]:
    """Each CSV file of a folder as a table of its own, by file name."""
    jvm = spark._jvm.org.apache.hadoop.fs
    where_ = jvm.Path(directory)
    files = where_.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where_)
    paths = sorted(str(f.getPath()) for f in files if str(f.getPath()).lower().endswith(".csv"))
    return {p.rsplit("/", 1)[-1][:-4]: read_log_csv(spark, p) for p in paths}


def _one(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(whole, c.cast("decimal(20,0)").cast("string")).otherwise(c.cast("string"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.regexp_replace(F.date_format(c, ".SSSSSS"), "0+$", ""), r"^\.$", ""))
    if isinstance(kind, T.DateType):
        return F.concat(c.cast("string"), F.lit("T00:00:00"))
    return F.to_json(c) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")


def stringify(df: DataFrame, keep: tuple[str, ...] = ("row_num",)) -> DataFrame:
    """Typed cells as text, null as '': whole numbers without .0, times as ISO text, booleans true or false."""
    return df.select(*[F.col(f"`{f.name}`") if f.name in keep else F.coalesce(_one(F.col(f"`{f.name}`"), f.dataType), F.lit("")).alias(f.name) for f in df.schema])


def with_row_num(df: DataFrame, order_by: Column | str | None = None, scan: bool = False) -> DataFrame:
    """Number rows from 1 without a gap, in the given order or, without one, in the order in which they are read.

    Two passes over the same partitions: rows of each are counted, and each starts where those before it end. A sort
    or shuffle needn't deal its rows out alike when it runs again, so what is numbered is first written to the
    checkpoint folder; only a plain ``scan`` of files is read twice. No row meets another; one count a partition
    comes to the driver and goes back as a table of starts, 16 bytes each.
    """
    source = df if order_by is None else df.orderBy(order_by)
    source = source if scan and order_by is None else cut(source)
    names = [n for n in source.columns if n != "row_num"]
    part = F.spark_partition_id().cast("long")
    counts = sorted(source.select(part.alias("p")).groupBy("p").count().collect())
    start, starts = 0, []
    for p, n in counts:
        starts.append((p, start))
        start += n
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = source.select(part.alias("_part"), within.alias("_within"), F.struct(*[f"`{n}`" for n in names]).alias("_row"))
    told = source.sparkSession.createDataFrame(starts, "_part long, _start long")
    out = rows.join(F.broadcast(told), "_part")
    return out.select((F.col("_within") + F.col("_start") + 1).alias("row_num"), *[F.col("_row").getField(n).alias(n) for n in names])


def number_by(df: DataFrame, key: str) -> DataFrame:
    """Use a dense key from 0 that the table has as row numbers from 1."""
    return df.select((F.col(key) + 1).cast("long").alias("row_num"), *[f"`{c}`" for c in df.columns if c != "row_num"])


def fingerprint(df: DataFrame) -> DataFrame:
    """One row, (rows, digest): the same for the same rows in any order, one pass.

    A row's cells are joined as text, null as '', by a unit separator; the digest adds up the first 60 bits of their md5.
    """
    cells = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])
    number = F.conv(F.substring(F.md5(cells.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(number), F.lit(0)).cast("string").alias("digest"))


def export_frame(df: DataFrame, meta: list[ColumnMeta], spec: QuerySpec, row_time: DataFrame | None = None, order_by_time: str | None = None) -> DataFrame:
    """The rows of a view in its order, under the original headers, without row numbers."""
    found = where(df, spec)
    if order_by_time:
        found = found.join(row_time.select("row_num", "epoch_ms"), "row_num", "left").orderBy(*time_order(order_by_time == "desc"))
    else:
        found = found.orderBy(*order(spec))
    used, names = set(), []
    for m in meta:  # two columns may have had one header
        name, k = m.original, 2
        while name.lower() in used:
            name, k = f"{m.original} ({k})", k + 1
        used.add(name.lower())
        names.append(name)
    return found.select(*[F.col(f"`{m.name}`").alias(n) for m, n in zip(meta, names)])


def export_csv(df: DataFrame, meta: list[ColumnMeta], spec: QuerySpec, path: str, row_time: DataFrame | None = None, order_by_time: str | None = None) -> str:
    """Write a view into a new version folder under ``path`` and return it; earlier versions stay as they are."""
    version = f"{path}/version-{uuid.uuid4().hex}"
    export_frame(df, meta, spec, row_time, order_by_time).write.csv(version, header=True, escape='"')
    return version


def table_names(names: list[str]) -> list[str]:
    """At most 31 characters, no : \\ / ? * [ ], unique whatever the case."""
    used, out = set(), []
    for name in names:
        base = re.sub(r"[:\\/?*\[\]]", " ", name).strip()[:31] or "Table"
        unique, k = base, 2
        while unique.lower() in used:
            tail = f" ({k})"
            unique, k = base[: 31 - len(tail)] + tail, k + 1
        used.add(unique.lower())
        out.append(unique)
    return out


def write_report(tables: dict[str, DataFrame], directory: str, form: str = "parquet") -> dict[str, str]:
    """One folder a table under a new version of ``directory``; the order of the tables is in their names."""
    version = f"{directory}/version-{uuid.uuid4().hex}"
    paths = {}
    for i, (name, df) in enumerate(zip(table_names(list(tables)), tables.values())):
        path = f"{version}/{i:02d} {name}"
        (df.write.parquet(path) if form == "parquet" else stringify(df, ()).write.csv(path, header=True, escape='"'))
        paths[name] = path
    return paths
