"""Generated logs for benchmarks and demonstrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.sources.tables import clean_headers
from logsift.spec import ColumnMeta

START = 1_767_571_200  # a Monday, 0 o'clock UTC
HEADERS = ["TimeGenerated", "Computer", "Account", "EventID", "Activity", "ProcessName", "CommandLine", "SourceIP", "FileName", "LogonType"]
_BAD = ["powershell -enc SQBFAFgA", "whoami /all", "mimikatz sekurlsa::logonpasswords", "vssadmin delete shadows", "psexec dc cmd", "rclone copy x"]


def security_log(spark: SparkSession, rows: int) -> tuple[DataFrame, list[ColumnMeta]]:
    """Working hours of five kinds of events by 40 users on 60 hosts, and twelve events of an intrusion by night."""
    i = F.col("id")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (i % len(v) + 1).cast("int"))
    night = (i % F.lit(max(rows // 12, 1)) == 0) & (i < 12 * max(rows // 12, 1))
    k = F.floor(i / max(rows // 12, 1))
    day = i % 22 + F.floor((i % 22) / 5) * 2
    at = F.when(night, START + 10 * 86_400 + 7260 + 200 * k).otherwise(START + day * 86_400 + 8 * 3600 + (i * 37) % 36_000)
    columns = [
        F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.when(night, "WS-SCALE-13").otherwise(F.concat(F.lit("WS-"), (i % 60).cast("string"))), F.concat(F.lit("user"), (i % 40).cast("string")),
        pick("4624", "4688", "5156", "4663", "4634"), pick("User logged in", "Process created", "Connection allowed", "File accessed", "User logged off"), F.when(night, "cmd.exe").otherwise(pick("winword.exe", "excel.exe", "chrome.exe", "teams.exe")),
        F.when(night, F.element_at(F.array(*[F.lit(x) for x in _BAD]), (k % len(_BAD) + 1).cast("int"))).otherwise(F.concat(F.lit("open document "), i.cast("string"), F.lit(".docx"))),
        F.concat(F.lit("10.1."), (i % 4).cast("string"), F.lit("."), (i % 250).cast("string")), F.concat(F.lit("report"), (i % 500).cast("string"), F.lit(".docx")), pick("2", "3", "10"),
    ]
    meta = clean_headers(HEADERS)
    return spark.range(rows).select((i + 1).alias("row_num"), *[c.alias(m.name) for c, m in zip(columns, meta)]), meta
