import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from logsift.llm import toxicity as tox
from tests.llm.cases import CLASH, EDGE, edge, lower
from tests.llm.test_importance import WORD


def plain(docs, labels, beyond):
    """Mean ratio of each text: both models by dictionaries of byte n-grams and the definition's recursion."""
    counts = [Counter(), Counter()]
    symbols = lambda text: [b"\x01" + w.encode() + b"\x02" for w in WORD.findall(lower(text))]
    for d, t in docs:
        if d in labels and zlib.crc32(str(d).encode()) % 5 > 1:
            for w in symbols(t):
                for i in range(1, len(w)):
                    for n in range(1, tox.ORDER + 1):
                        if i - n + 1 >= 0:
                            counts[labels[d]][w[i - n + 1 : i + 1]] += 1
    every = set(counts[0]) | set(counts[1])
    before = Counter(g[1:] for g in every if 1 < len(g) <= tox.LOW + 1)

    def discount(values):
        once, twice = sum(v == 1 for v in values), sum(v == 2 for v in values)
        return once / (once + 2 * twice) if once and twice else 0.75

    kept = [g for g in every if before[g]]
    ds = {n: discount([before[g] for g in kept if len(g) == n]) for n in range(1, tox.LOW + 1)}
    after = defaultdict(list)
    for g in kept:
        if len(g) <= tox.LOW:
            after[g[:-1]].append(before[g])

    def shared(g):
        if not g:
            return 1 / 256
        c = after.get(g[:-1])
        if not c:
            return shared(g[1:])
        return (max(before[g] - ds[len(g)], 0) + ds[len(g)] * len(c) * shared(g[1:])) / sum(c)

    top = [g for g in every if len(g) == tox.ORDER or g[0] == 1]
    pool, off = counts[0] + counts[1], discount([counts[0][g] + counts[1][g] for g in top])
    by = [defaultdict(list) for _ in range(3)]
    for g in top:
        for k, c in enumerate((*counts, pool)):
            if c[g]:
                by[k][g[:-1]].append(c[g])

    def both(g):
        own = by[2].get(g[:-1])
        low = shared(g[1:][-tox.LOW :])
        return low if not own else (max(pool[g] - off, 0) + off * len(own) * low) / sum(own)

    def p(g, k):
        own = by[k].get(g[:-1])
        return both(g) if not own else (max(counts[k][g] - tox.DISCOUNT, 0) + sum(min(x, tox.DISCOUNT) for x in own) * both(g)) / sum(own)

    out = {}
    for d, t in docs:
        total = sum(max(0, sum(math.log(p(g, 1) / p(g, 0)) for i in range(1, len(w)) for g in [w[max(0, i - tox.ORDER + 1) : i + 1]]) - beyond) for w in symbols(t))
        out[d] = total / max(len(symbols(t)), 1)
    return out


def test_ratios_are_those_of_two_kneser_ney_models(spark):
    rng = np.random.default_rng(2)
    kinds = [["the", "then", "a", "there", "over", "été"], ["thug", "the", "oaf", "oafish", "a"]]
    docs = [(k, " ".join(rng.choice(kinds[k % 2], 30))) for k in range(30)] + [(100, "thug unseen thing qqq"), (101, ""), (102, "oafs over")]
    labels = {k: k % 2 for k in range(30)}
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    told = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    for beyond in (-100.0, 0.5):
        got = {r["doc_id"]: r for r in tox.toxicity(frame, told, beyond=beyond).collect()}
        for d, expected in plain(docs, labels, beyond).items():
            assert got[d]["ratio"] == pytest.approx(expected, abs=1e-9)
    assert got[100]["score"] > got[101]["score"]


def test_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in tox.query(spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(0 <= s <= 1 and p == (s >= 0.5) for s, _, p in held)
    hit = sum(p and q for _, q, p in held)
    print("precision", hit / sum(p for *_, p in held), "recall", hit / sum(q for _, q, _ in held), len(held))
    assert np.mean([p == q for _, q, p in held]) >= 0.97
    assert hit >= 0.9 * sum(q for _, q, _ in held) and hit >= 0.9 * sum(p for *_, p in held)


def test_learns_from_no_held_out_label(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    one = {r["doc_id"]: r["score"] for r in tox.toxicity(docs, labels).collect()}
    changed = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    assert one == {r["doc_id"]: r["score"] for r in tox.toxicity(docs.drop("lang", "source"), changed).collect()}


def test_edges(spark):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    rows = tox.toxicity(edge(spark), none).collect()
    assert len(rows) == len(EDGE) and {(r["score"], r["predicted"]) for r in rows} == {(0.0, 0)}
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [True]
    some = spark.createDataFrame([(i, i % 2) for i in range(-3, 13)] + [(1, 0)], "doc_id long, toxic int")
    told = {r["doc_id"]: r for r in tox.toxicity(edge(spark), some).collect()}
    assert all(0 <= r["score"] <= 1 for r in told.values()) and {told[k]["ratio"] for k in (2, 3, 4)} == {0.0}
    assert tox.toxicity(edge(spark).limit(0), some).count() == 0
    assert "ratio" not in CLASH or told


def test_a_bounded_model_keeps_the_frequent_grams(spark):
    docs = spark.createDataFrame([(k, f"common words number{k}" + (" slur" if k % 2 else "")) for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    rows = tox.toxicity(docs, labels, grams=300, sample=50).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in rows)
