"""Rows that every operator has to stand, and plain versions of what operators compute."""

import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"word{i}" for i in range(60))


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def words(text):
    return SPACED.findall(text or "")


EDGE = [
    (1, f"start one {PASSAGE} end one"), (2, None), (3, ""), (4, "   \n\t "), (5, "short"), (6, f"other {PASSAGE}\ntailé  x"), (7, PASSAGE), (7, PASSAGE),
    (8, "The The The " * 40), (9, "The The The " * 40), (10, "x" * 300_000), (11, "你好 " * 30), (12, "0123 456 ! ?"), (None, PASSAGE), (-3, f"{PASSAGE} minus"),
]
#: Column names that operators use themselves.
CLASH = ["marks", "kept", "spans", "bucket", "key", "n_words", "items", "stats", "deal", "fingerprint", "component_id", "length", "piece", "rank", "train", "score", "lettered"]


def edge(spark, rows=EDGE):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in CLASH}).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.lit(1).cast("long")})


def documents(spark, folder):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
