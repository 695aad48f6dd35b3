"""The automaton against plain searches, and libraries of any size."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logsift.functions import automaton
from logsift.functions.automaton import Automaton, spans
from logsift.operators import matching

LETTER = st.text("abAB é日0_", min_size=0, max_size=40)


def fold(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def plain(patterns, texts):
    return [(i, k, fold(t).encode().find(fold(p).encode())) for i, t in enumerate(texts) for k, p in enumerate(patterns) if fold(p) in fold(t)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abAB é日0_", min_size=1, max_size=6), min_size=1, max_size=12), st.lists(LETTER, max_size=8), st.integers(1, 9))
def test_first_places_of_all_patterns(patterns, texts, piece):
    automaton.PIECE, was = piece, automaton.PIECE
    try:
        a = Automaton(patterns)
        data, at = spans(pa.array(texts, pa.string()))
        found = a.scan(data, at)
        assert list(zip(*(x.tolist() for x in found))) == plain(patterns, texts)
        alone = a.alone(data, at, *found).tolist()
        for ok, i, k, p in zip(alone, *(x.tolist() for x in found)):
            text, size = fold(texts[i]).encode(), len(patterns[k].encode())
            around = text[:p].decode()[-1:] + text[p + size :].decode()[:1]
            assert ok == (not any(c.isalnum() for c in around))
    finally:
        automaton.PIECE = was


def test_long_texts_nulls_and_slices():
    a = Automaton(["needle", "needle in", "e", "aaa"])
    long = "x" * 100_000 + "needle in" + "a" * 50_000
    column = pa.array(["skipped", None, "", long, "NEEDLE"]).slice(1)
    data, at = spans(column)
    assert list(zip(*(x.tolist() for x in a.scan(data, at)))) == [(2, 0, 100_000), (2, 1, 100_000), (2, 2, 100_001), (2, 3, 100_009), (3, 0, 0), (3, 2, 1)]
    assert all(len(x) == 0 for x in a.scan(*spans(pa.array([], pa.string()))))
    with pytest.raises(ValueError):
        Automaton(["a", ""])


def test_ten_thousand_patterns(spark):
    technique = lambda i: {"techniqueId": f"T{i}", "name": f"name {i}", "tactics": [{"id": f"TA{i % 3}", "name": "t"}], "keywords": [{"id": f"k{i}-{j}", "pattern": f"tool{i}x{j}", "score": 5} for j in range(10)]}
    small = matching.Library((technique(7),), ())
    large = matching.Library(tuple(technique(i) for i in range(1000)), ())
    rng = np.random.default_rng(1)
    rows = [(int(k), f"run TOOL{rng.integers(0, 1200)}x{rng.integers(0, 12)} and tool7x3", None) for k in range(500)]
    df = spark.createDataFrame(rows, "row_num long, a string, b string")
    got = matching.match_keywords(df, large, ["a", "b"])
    own = sorted(map(tuple, got.filter("technique_id = 'T7'").collect()))
    assert own == sorted(map(tuple, matching.match_keywords(df, small, ["a", "b"]).collect())) and len(own) >= 500
    expected = [(k, f"T{i}", f"tool{i}x{j}") for k, a, _ in rows for i, j in re.findall(r"tool(\d+)x(\d)", a.lower()) if int(i) < 1000]
    # tool1x1 is also in tool1x11
    assert sorted({(r["row_num"], r["technique_id"], r["keyword"]) for r in got.collect()}) == sorted(set(expected))
    assert {r["column_name"] for r in got.select("column_name").distinct().collect()} == {"a"}
