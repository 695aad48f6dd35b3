import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from logsift.llm.decontaminate import decontaminate, query
from logsift.llm.fm_index import FMIndex
from tests.llm.cases import EDGE, PASSAGE, documents, edge, lower

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        for i in range(max(0, len(w) - size) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, found = [False] * len(w), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if x := windows.get(tuple(w[i : i + n])):
                    found |= x
                    hit[i : i + n] = [True] * n
        out.append((d, len(w), sum(hit), sorted(found)))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=30), min_size=1, max_size=6), st.lists(st.lists(st.integers(1, 5), min_size=1, max_size=6), min_size=1, max_size=8))
def test_index_finds_every_occurrence(stretches, patterns):
    shard = np.array([x for s in stretches for x in [*s, 0]], np.int64)
    index = FMIndex(shard, 5, sample=3)
    width = max(map(len, patterns))
    table = np.array([p + [0] * (width - len(p)) for p in patterns], np.int64)
    which, place = index.locate(*index.search(table, np.array([len(p) for p in patterns])))
    expected = [(k, i) for k, p in enumerate(patterns) for i in range(len(shard)) if shard[i : i + len(p)].tolist() == p]
    assert sorted(zip(which.tolist(), place.tolist())) == expected


def test_query_is_brute_force(spark, small):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    expected = {d: (n, h, len(x), hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest(), h > 0) for d, n, h, x in plain(documents(spark, small).items(), items)}
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in query(spark, small).collect()}
    assert got == expected
    assert any(v[4] for v in got.values())


def test_edges_in_one_block_and_in_many(spark):
    items = [(5, PASSAGE), (10, "short"), (7, PASSAGE), (7, "Tailé x"), (1, None), (2, ""), (None, "the the"), (3, "! ?"), (12, "456")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = plain(EDGE, [x for x in items if x[0] is not None])
    key = lambda x: tuple((v is None, v) for v in x[:3])
    for size in (4 << 20, 1):
        rows = decontaminate(edge(spark), bench, block_bytes=size, carry=("lang",)).collect()
        assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in rows], key=key) == sorted(expected, key=key)
        kept = {r["doc_id"]: r["kept"] for r in rows}
        assert kept[1] == "start one end one" and kept[5] == "" and kept[12] == "0123 " and kept[4] == "   \n\t "
    nothing = decontaminate(edge(spark), bench.limit(0)).collect()
    assert len(nothing) == len(EDGE) and all(r["n_hit"] == 0 and r["items"] == [] for r in nothing)
    assert decontaminate(edge(spark).limit(0), bench).count() == 0
