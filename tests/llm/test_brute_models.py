"""Quality and language ID against plain versions: one matrix, and cosines over all centroids."""

import math
import re
import zlib

import numpy as np
import pytest

from logsift.llm import language_id, quality
from logsift.llm.common import fold
from tests.llm.cases import documents


def plain_statistics(text):
    data = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", data) if w]
    n, share = len(words), lambda some, of: sum(some) / max(of, 1)
    upper = lambda b: 65 <= b <= 90
    letter = lambda b: upper(b) or 97 <= b <= 122 or b >= 128
    three = [tuple(words[i : i + 3]) for i in range(n - 2)]
    lines = data.count(b"\n") + (n > 0)
    return [
        math.log1p(n), math.log1p(len(data)), share((len(w) for w in words), n), share((upper(b) for b in data), sum(letter(b) for b in data)),
        share((b in b"*%&#$@^~<>{}[]\\_=+" for b in data), len(data)), share((b == 33 for b in data), len(data)), share((b == 124 for b in data), len(data)),
        share((b in b",." for b in data), len(data)), share((48 <= b <= 57 for b in data), len(data)), share((b >= 128 for b in data), len(data)),
        math.log1p(lines), math.log1p(n / max(lines, 1)), share((a == b for a, b in zip(words, words[1:])), n), math.log(max(len(set(words)), 1) / max(n, 1)),
        len(set(three)) / max(n - 2, 1), share((len(w) <= 2 for w in words), n), share((len(w) > 12 for w in words), n),
        share((not letter(w[-1]) and w[-1] not in b",." for w in words), n), share((len(w) > 1 and upper(w[0]) and upper(w[1]) for w in words), n),
    ]


def test_statistics_are_the_plain_ones(spark, small):
    docs = documents(spark, small)
    got = {r["doc_id"]: r["stats"] for r in quality.statistics(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    assert set(got) == set(docs)
    for d, text in docs.items():
        assert got[d] == pytest.approx(plain_statistics(text), rel=1e-9, abs=1e-12), d
    odd = [(1, ""), (2, "A! B| b b\nCD 12,"), (3, "é É ÀB a.\t\n\nwordslongerthantwelve"), (4, "x x x x")]
    for r in quality.statistics(spark.createDataFrame(odd, "doc_id long, text string")).collect():
        assert r["stats"] == pytest.approx(plain_statistics(dict(odd)[r["doc_id"]]), rel=1e-9, abs=1e-12), r["doc_id"]


def test_quality_is_the_fit_of_one_matrix(spark, small):
    docs = documents(spark, small)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect() if r["quality"] is not None}
    remainder = {d: zlib.crc32(str(d).encode()) % 5 for d in docs}
    stats = {d: plain_statistics(t) for d, t in docs.items()}
    learned = [d for d in docs if d in labels and remainder[d] != 0]
    x, y = np.array([stats[d] for d in learned]), np.array([labels[d] for d in learned], float)
    fitting = np.array([remainder[d] != 1 for d in learned])
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    model = quality.Model(x.mean(axis=0), scale, 384, 0.03, 7)
    z, n = model.features(x[fitting]), int(fitting.sum())
    penalty = np.full(z.shape[1], 1e-3 * n)
    penalty[-1] = 0
    model.weights = np.linalg.solve(z.T @ z + np.diag(penalty) + 1e-9 * np.eye(z.shape[1]), z.T @ y[fitting])
    step = np.round(np.clip(model.raw(x[~fitting]), -2, 3) / quality.STEP)
    at = np.unique(step)
    model.knots = at * quality.STEP
    model.values = quality.isotonic(np.array([(step == s).sum() for s in at], float), np.array([y[~fitting][step == s].mean() for s in at]))
    expected = dict(zip(docs, model.score(np.array([stats[d] for d in docs]))))
    got = {r["doc_id"]: r for r in quality.query(spark, small).collect()}
    assert set(got) == set(docs)
    # a raw score on the edge of a step may fall on either side of it
    apart = [d for d in docs if abs(got[d]["score"] - expected[d]) > 1e-4]
    assert len(apart) <= 0.02 * len(docs), [(d, got[d]["score"], expected[d]) for d in apart[:5]]
    for d, r in got.items():
        assert (r["held_out"], r["predicted"]) == (remainder[d] == 0, int(r["score"] >= 0.3))


def plain_vector(text, idf, sizes=(1, 2, 3), dims=4096):
    letters = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode()]
    counts = np.zeros(dims)
    for n in sizes:
        for i in range(len(letters) - n + 1):
            h = n
            for b in letters[i : i + n]:
                h = (h * 0x01000193 + b) % 2**32
            counts[(h * 0x9E3779B1 % 2**32) >> (32 - 12)] += 1
    weighed = np.log1p(counts) * idf
    return counts, weighed / max(np.linalg.norm(weighed), 1e-12)


def test_language_is_that_of_the_nearest_of_all_centroids(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    docs, langs = documents(spark, small), {r["doc_id"]: r["lang"] for r in df.select("doc_id", "lang").collect()}
    rows = df.filter(fold("doc_id", 4) != 2).filter("lang is not null and doc_id is not null and text is not null").select("doc_id", "lang", "text")
    model = language_id.fit(rows, 2000, 4, (1, 2, 3), 4096)
    learned = [d for d in docs if langs[d] is not None and docs[d] is not None and zlib.crc32(str(d).encode()) % 4 != 2]
    counts = {d: plain_vector(docs[d], np.ones(4096))[0] for d in docs}
    seen = sum((counts[d] > 0).astype(float) for d in learned)
    assert model.idf == pytest.approx(np.log((1 + len(learned)) / (1 + seen)) + 1, rel=1e-5)
    for r in language_id.query(spark, small).collect():
        text = docs[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        weighed = np.log1p(counts[r["doc_id"]]) * model.idf
        cosine = model.centroids @ (weighed / np.linalg.norm(weighed))
        assert r["score"] == pytest.approx(cosine.max(), abs=1e-4)
        near = {lang for lang, c in zip(model.langs, cosine) if c >= cosine.max() - 1e-5}
        assert r["lang_pred"] in near
