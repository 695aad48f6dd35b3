"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), ``docs`` having the columns of
``documents``, and works on all its predecessor kept. All but the last return those columns again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm.common import checkpoint_folder, cut, few, table
from logsift.llm.decontaminate import decontaminate
from logsift.llm.language_id import identify
from logsift.llm.near_dupes import near_groups
from logsift.llm.packing import pack
from logsift.llm.substring_dedup import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REST = ("lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have letters and are near some language; a missing lang gets the predicted one."""
    found = identify(docs, carry=("text", *REST)).filter("not rejected")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group of five-word-shingle similarity 0.8 or more; rows without doc_id stay.

    Several texts of one doc_id are judged each; of rows that repeat a doc_id and its text one stays, the least.
    """
    key = ["doc_id", "text_hash"]
    told = near_groups(docs, least=0.8, shingle=5)
    told = cut(told.filter("not kept or copies > 1").select(*key, "kept"))
    again = cut(told.filter("kept").select(*key))
    rows = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    once = rows.join(few(told.select(*key)), key, "left_anti").select(*COLUMNS)
    more = rows.join(few(again), key, "left_semi").groupBy(*key).agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return once.union(more.select("row.*"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that a smaller doc_id also holds in a run of 13; what has no word left goes."""
    found = substring_dedup(docs, layout=True, carry=REST).filter("n_removed = 0 or n_removed < n_words")
    return found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("n_chars"))).withColumnRenamed("kept", "text").select(*COLUMNS)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the benchmark's windows; what has no word left goes."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=REST).filter("n_hit = 0 or n_hit < n_words")
    return found.withColumn("n_chars", F.when(F.col("n_hit") > 0, F.length("kept")).otherwise(F.col("n_chars"))).withColumnRenamed("kept", "text").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every kept document goes in sequences of 1024 tokens."""
    return pack(docs)


STAGES = [("language_id", language_id), ("simhash_near_dedup", near_dedup), ("substring_dedup", cut_repeats), ("benchmark_decontamination", cut_benchmark), ("best_fit_packing", packing)]

#: SQL can't express the stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Between two, the rows are written to the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
