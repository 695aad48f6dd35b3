import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from logsift.llm import importance, oracles
from tests.llm.cases import EDGE, edge, lower

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, target, low=1, high=1, buckets=10_000, least=20, percent=10, seed=2024):
    """The draw by one dictionary of counts: doc_id, n_features, weight, score, rank."""

    def features(text):
        w = WORD.findall(lower(text))
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(low, high + 1) for i in range(len(w) - n + 1)], len(w)

    s, t = Counter(b for _, x in docs for b in features(x)[0]), Counter(b for x in target for b in features(x)[0])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    out = []
    for d, x in docs:
        f, n_words = features(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
        score = None if d is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(f), weight, score, None, n_words])
    can = sorted((r for r in out if r[5] >= least and r[3] is not None), key=lambda r: (-r[3], r[0], -r[2], -r[1]))
    for k, r in enumerate(can[: percent * len(can) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def rows(df):
    return sorted((tuple(r[:5]) for r in df.collect()), key=str)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200), st.integers(1, 3), st.integers(0, 3))
def test_crcs_of_runs_come_from_prefixes(text, low, more):
    w = text.translate(importance.NORMAL).split()
    expected = [zlib.crc32(b" ".join(w[i : i + n])) for n in range(low, low + more + 1) for i in range(len(w) - n + 1)]
    assert importance.gram_crcs(text, low, low + more).tolist() == expected


def test_shift_is_the_crc_of_zero_bytes():
    one = zlib.crc32(b"some text")
    for n in (0, 1, 7, 255, 70_001):
        # a CRC of A then B is that of A shifted by B's bytes, and that of B
        b = bytes(range(256)) * (n // 256) + bytes(range(n % 256))
        assert importance.shift(np.array([one], np.uint32), np.array([n]))[0] ^ zlib.crc32(b) == zlib.crc32(b"some text" + b)


def test_same_as_plain_and_sql(spark, small):
    got = rows(importance.query(spark, small))
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{small}/benchmark.parquet").select("text").collect()]
    assert got == plain(docs, target)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{small}/{name}.parquet')")
    assert got == sorted((tuple(r) for r in con.sql(oracles.IMPORTANCE).fetchall()), key=str)


def test_edges(spark):
    target = spark.createDataFrame([(None,), ("",), ("word1 word2 word3 ok",)], "text string")
    got = rows(importance.resample(edge(spark), target, percent=60))
    assert got == plain(EDGE, [None, "", "word1 word2 word3 ok"], percent=60)
    assert {(r[3], r[4]) for r in got if r[0] is None} == {(None, None)}
    assert sum(r[4] is not None for r in got) == 60 * 8 // 100
    assert importance.resample(edge(spark).limit(0), target).count() == 0
    assert {r[2] for r in rows(importance.resample(edge(spark, [(1, "a b"), (2, None)]), target.limit(0)))} <= {0, math.floor(1000 * math.log(10_002 / 20_000))}


def test_longer_runs_and_ties(spark):
    docs = [(k // 2, "one two three four five six " * 4) for k in range(40)]
    target = ["two three", "five six one"]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    told = spark.createDataFrame([(x,) for x in target], "text string")
    assert rows(importance.resample(frame, told, low=1, high=3, percent=30)) == plain(docs, target, 1, 3, percent=30)
    assert rows(importance.resample(frame, told, low=2, high=2, percent=100)) == plain(docs, target, 2, 2, percent=100)
