import collections
import math
import zlib

import numpy as np
import pytest

from logsift.llm import language_id, lm_score, quality
from logsift.llm.lm_score import Lattice, model_path, vocabulary
from tests.llm.cases import EDGE, documents, edge, lower, words


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in quality.query(spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(0 <= s <= 1 for s, _, _ in held)
    assert np.mean([p == q for _, q, p in held]) >= 0.95
    good, bad = [s for s, q, _ in held if q == 1], [s for s, q, _ in held if q == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) >= 0.95


def test_quality_learns_from_no_held_out_label(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    one = {r["doc_id"]: r["score"] for r in quality.quality(docs, labels).collect()}
    changed = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    assert one == {r["doc_id"]: r["score"] for r in quality.quality(docs.drop("lang", "source"), changed).collect()}


def test_quality_edges(spark):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    rows = quality.quality(edge(spark), none).collect()
    assert len(rows) == len(EDGE) and {r["score"] for r in rows} == {0.5} and {r["predicted"] for r in rows} == {1}
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [True]
    some = spark.createDataFrame([(i, i % 2) for i in range(-3, 13)] + [(1, 0)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in quality.quality(edge(spark), some).collect())
    assert quality.quality(edge(spark).limit(0), some).count() == 0


def test_isotonic_is_least_squares():
    assert quality.isotonic(np.array([1.0, 1, 1, 1]), np.array([0.0, 1, 0, 1])).tolist() == [0, 0.5, 0.5, 1]
    assert quality.isotonic(np.array([3.0, 1]), np.array([1.0, 0])).tolist() == [0.75, 0.75]


def test_language_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    held = [(r["lang_pred"], truth[r["doc_id"]]) for r in language_id.query(spark, folder).collect() if r["held_out"]]
    assert np.mean([a == b for a, b in held]) >= 0.98


def test_language_far_from_every_centroid_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, "qxz " * 200, None), (-2, "zzzz" * 300, None), (-3, "Ω≈ç√ " * 90, None)], docs.schema)
    got = {r["doc_id"]: r["rejected"] for r in language_id.identify(docs.union(odd), learn="doc_id >= 0").collect()}
    assert all(got[i] for i in (-1, -2, -3))
    assert sum(v for d, v in got.items() if d >= 0) <= 0.002 * len(got)


def test_language_edges(spark):
    from pyspark.sql import functions as F

    learned = edge(spark).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "aa").otherwise("bb"))
    rows = {r["doc_id"]: r for r in language_id.identify(learned, carry=("text", "source")).collect()}
    assert len(rows) == len({d for d, _ in EDGE})
    for d in (2, 3, 4, 12):
        assert (rows[d]["lang_pred"], rows[d]["score"], rows[d]["rejected"]) == ("und", 0.0, True)
    assert rows[11]["lang_pred"] in ("aa", "bb") and rows[1]["text"].startswith("start one")
    assert {r["lang_pred"] for r in language_id.identify(edge(spark)).collect()} == {"und"}
    assert language_id.identify(learned.limit(0)).count() == 0


def test_lm_counts_are_exact(spark, small):
    docs = documents(spark, small)
    tokens = {d: [*words(lower(t)), None] for d, t in docs.items()}
    seen = collections.Counter(w for d in docs if zlib.crc32(str(d).encode()) % 10 for w in tokens[d])
    n, v = sum(seen.values()), len(seen)
    for r in lm_score.query(spark, small).collect():
        own = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(seen[w] > 0 for w in own), n)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        assert r["base_score"] == pytest.approx(sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel=1e-9)
        assert -60 * len(own) < r["score"] < 0


def test_lm_edges(spark):
    rows = {r["doc_id"]: r for r in lm_score.score(edge(spark)).collect()}
    assert rows[2]["n_tokens"] == 1 and rows[2]["score"] == rows[3]["score"] == rows[4]["score"]
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows.values())
    assert rows[None]["held_out"] is True
    nothing = lm_score.score(edge(spark, [(None, "a b")])).collect()
    assert (nothing[0]["n_known"], nothing[0]["train_tokens"]) == (0, 0) and math.isfinite(nothing[0]["score"])
    assert lm_score.score(edge(spark).limit(0)).count() == 0


def _all_ways(word, pieces):
    if not word:
        return 1.0
    return sum(p * _all_ways(word[len(k) :], pieces) for k, p in pieces.items() if word.startswith(k))


def test_lattice_sums_all_segmentations():
    pieces = {b" ": 0.1, b" a": 0.2, b"a": 0.15, b"b": 0.15, b"ab": 0.1, b"ba": 0.1, b" ab": 0.1, b"aba": 0.1}
    lattice = Lattice(list(pieces), np.log(list(pieces.values())))
    texts = [b"a", b"ab", b"abab", b"bbb", b"abaaba", b"ab"]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = lattice.words(np.frombuffer(b"".join(texts), np.uint8), at)
    assert got == pytest.approx([math.log(_all_ways(b" " + t, pieces)) for t in texts])
    assert [lattice._one(b" " + t) for t in texts] == pytest.approx(got.tolist())


def test_lm_score_is_the_sum_over_all_segmentations(spark):
    rows = [(1, "The theory of it"), (2, "a b"), (3, None), (10, "unseen Wörter here"), (22, "of of of")]
    pieces, logp = vocabulary(model_path())
    weight = dict(zip(pieces, np.exp(logp)))
    seen = collections.Counter(w for d, t in rows if zlib.crc32(str(d).encode()) % 10 for w in [*words(lower(t)), None])
    end = (seen[None] + 0.1) / (sum(seen.values()) + 0.1 * (len(seen) + 1))
    near = lambda text: {k: p for k, p in weight.items() if k in text}
    for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        texts = [b" " + w.encode() for w in words(lower(dict(rows)[r["doc_id"]]))]
        expected = math.log10(end) + sum(math.log10((1 - end) * _all_ways(t, near(t))) for t in texts)
        assert r["score"] == pytest.approx(expected, rel=1e-9)


def test_the_vocabularys_scores_beat_even_ones_on_english(spark):
    # common words of a language that the vocabulary was made for
    pieces, logp = vocabulary(model_path())
    own = [w.encode() for w in "the people who live in this house were not at home when we came to see them after the meeting".split()]
    data, at = np.frombuffer(b"".join(own), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in own])])
    assert Lattice(pieces, logp).words(data, at).sum() > Lattice(pieces, np.full(len(pieces), -math.log(len(pieces)))).words(data, at).sum()


def test_vocabulary_covers_every_byte():
    pieces, logp = vocabulary(model_path())
    assert np.exp(logp).sum() == pytest.approx(1)
    assert {bytes([b]) for b in range(256)} <= set(pieces)
    lattice = Lattice(pieces, logp)
    assert np.isfinite(lattice.words(np.frombuffer("你é~\x00".encode(), np.uint8), np.array([0, 3, 7]))).all()


def test_lm_score_is_not_far_below_the_base_on_held_out_rows(spark):
    held = [r for r in lm_score.query(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert all(math.isfinite(r["score"]) for r in held)
    assert sum(r["score"] for r in held) >= 1.1 * sum(r["base_score"] for r in held)


def test_a_fitted_models_chances_add_up_to_one(spark):
    model = lm_score.Model(12, 4, 2, 1, 1, fitted=True)
    counts, unseen = np.array([1, 2, 7, 0]), 0.25  # three seen words and all others, whose pieces' sums are these
    lattice = np.log([0.25, 0.25, 0.25, unseen])
    word = model.word(counts, lattice)
    assert np.exp(word).sum() == pytest.approx(1)
    # a text's last word, given the words before it
    for before in ([], [0], [2, 2, 1], [3, 3]):
        ways = [model.texts(word[[*before, w]], np.array([*before, w]), np.array([0, len(before) + 1]))[-1] - model.on() for w in range(4)]
        assert sum(10**x for x in ways) == pytest.approx(1)


def test_expected_uses_of_pieces():
    pieces = {b" ": 0.1, b" a": 0.2, b"a": 0.3, b"b": 0.4}
    lattice = Lattice(list(pieces), np.log(list(pieces.values())))
    # " ab" is " "+"a"+"b" (0.012) or " a"+"b" (0.08)
    got = lattice.uses(np.frombuffer(b"abb", np.uint8), np.array([0, 2, 3]), np.array([True, False]))
    assert got == pytest.approx([0.012 / 0.092, 0.08 / 0.092, 0.012 / 0.092, 1])


def test_pieces_are_fitted_to_very_long_words_too(spark):
    # one over LONG by far, one at it and one a byte over it; the last is of a row that isn't trained on
    texts = [("ab" * 400, 1), ("abcaab" * 50, 1), ("b" * Lattice.LONG, 1), ("b" * (Lattice.LONG + 1), 1), ("c" * 700, 0)]
    pieces = {b" ": 0.1, b" a": 0.2, b"a": 0.15, b"b": 0.15, b"ab": 0.1, b"ba": 0.1, b"aba": 0.1, b"c": 0.1}
    logp = np.log(list(pieces.values()))
    types = lm_score.word_types(spark.createDataFrame(texts, "text string, train int"), 3).cache()
    expected = logp
    for _ in range(lm_score.ROUNDS):
        lattice, weight = Lattice(list(pieces), expected), lm_score.PRIOR * np.exp(logp)
        for text, train in texts:
            if train:
                weight += lattice.expected(np.frombuffer(b" " + text.encode(), np.uint8).reshape(1, -1))
        expected = np.log(weight / weight.sum())
    assert lm_score.fit(types, list(pieces), logp) == pytest.approx(expected)


def test_uses_of_a_very_long_word_are_those_of_all_its_segmentations():
    pieces, logp = vocabulary(model_path())
    lattice = Lattice(pieces, logp)
    word = ("underwriting" * 40 + "çé漢" * 30 + "=" * 60).encode()
    data, at = np.frombuffer(word, np.uint8), np.array([0, len(word)])
    got = lattice.uses(data, at, np.array([True]))
    assert got == pytest.approx(lattice.expected(np.frombuffer(b" " + word, np.uint8).reshape(1, -1)))
    # the pieces of any segmentation make up the word
    assert got @ np.array([len(p) for p in pieces]) == pytest.approx(len(word) + 1)
    assert not lattice.uses(data, at, np.array([False])).any()
