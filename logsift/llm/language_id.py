"""Language ID by nearest centroids of TF-IDF n-gram vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm.common import LOWER, cut, dealt, flushes, fold, summed, table, texts

#: What is no letter is a space to the n-grams.
_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)
_FOLD = _LETTERS[LOWER]


def _counts(flush, sizes: tuple[int, ...], dims: int):
    """For each row the counts of its hashed byte n-grams; runs of spaces are left as they are."""
    shift = np.uint32(32 - dims.bit_length() + 1)
    b = _FOLD[flush.bytes].astype(np.uint32)
    hashed = []
    for n in sizes:
        h = np.full(max(0, len(b) - n + 1), n, np.uint32)
        for j in range(n):
            h = h * np.uint32(0x01000193) + b[j : len(b) - n + 1 + j] if len(h) else h
        hashed.append((h * np.uint32(0x9E3779B1)) >> shift)
    for low, high in zip(flush.at[:-1].tolist(), flush.at[1:].tolist()):
        total = np.zeros(dims, np.int64)
        for n, h in zip(sizes, hashed):
            if high - low >= n:
                total += np.bincount(h[low : high - n + 1], minlength=dims)
        yield total


def _weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most ``k`` unit centroids of unit vectors: spherical k-means from a farthest-first start."""
    mean = x.mean(axis=0)
    chosen = [int((x @ mean).argmax())]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        i = int(near.argmin())
        if near[i] > 0.999:
            break
        chosen.append(i)
        near = np.maximum(near, x @ x[i])
    c = x[chosen]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


class Model:
    """``floors``: the cosine that all but one in a hundred of a centroid's own training rows have to it."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, langs: list[str], floors: np.ndarray):
        self.idf, self.centroids, self.langs, self.floors = idf.astype(np.float32), centroids.astype(np.float32), langs, floors


def fit(labelled: DataFrame, per_model: int, k: int, sizes: tuple[int, ...], dims: int) -> Model | None:
    """``labelled``: doc_id, text, lang. Document frequencies cover all rows; centroids a hash sample of about ``per_model`` rows in all."""
    by_lang = labelled.groupBy("lang").count().orderBy("lang").collect()
    if not by_lang:
        return None
    each = max(20, per_model // len(by_lang))
    most = 1 << 20
    share = F.create_map(*[x for lang, n in by_lang for x in (F.lit(lang), F.lit(min(most, -(-most * each // n))))])
    source = labelled.select(F.when(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(most)) < share[F.col("lang")], F.col("lang")).alias("lang"), "text")

    def scan(batches):
        seen = np.zeros(dims + 1)
        for flush in flushes(batches, most=1 << 20):
            langs = flush.rows.column(0).to_pylist()
            rows = []
            for lang, counts in zip(langs, _counts(flush, sizes, dims)):
                seen[:-1] += counts > 0
                seen[-1] += 1
                if lang is not None:
                    place = np.flatnonzero(counts)
                    rows.append((None, np.concatenate([place, counts[place]]).astype(np.int32).tobytes(), lang))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.string()))], names=["deal", "sums", "lang"])
        part = dealt(seen)
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array([None], pa.string())], names=["deal", "sums", "lang"])

    found = cut(source.mapInArrow(scan, "deal int, sums binary, lang string"))
    seen = summed(found.filter("deal is not null").select("deal", "sums"), dims + 1)
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1
    sample: dict[str, list[np.ndarray]] = {}
    for sums, lang in found.filter("deal is null").select("sums", "lang").toLocalIterator():
        place, seen_there = np.frombuffer(sums, np.int32).reshape(2, -1)
        counts = np.zeros(dims, np.float32)
        counts[place] = seen_there
        sample.setdefault(lang, []).append(_weights(counts, idf).astype(np.float32))
    centroids, langs, floors = [], [], []
    for lang in sorted(sample):
        x = np.stack(sample[lang])
        c = cluster(x, k)
        cosine = x @ c.T
        near = cosine.argmax(axis=1)
        floors += [float(np.quantile(cosine[near == j, j], 0.01)) if (near == j).any() else 0.0 for j in range(len(c))]
        centroids.append(c)
        langs += [lang] * len(c)
    return Model(idf, np.concatenate(centroids), langs, np.array(floors)) if langs else None


def identify(docs: DataFrame, learn=None, per_model: int = 2000, k: int = 4, sizes: tuple[int, ...] = (1, 2, 3), dims: int = 4096, reject_below: float = 0.3, carry: tuple[str, ...] = ()) -> DataFrame:
    """The language of every whole text.

    Method: hashed byte n-grams (``sizes``, ``dims``) weighted by TF-IDF and normalised are compared by cosine with
    up to ``k`` clustered centroids a language. Rows for which the condition ``learn`` holds and lang isn't null
    are learned from: all of them for the document frequencies, a hash sample of about ``per_model`` rows
    (shared evenly by the languages, at least 20 each) for the centroids.

    Returns doc_id, the columns of ``carry`` (which may name the text), lang_pred, score (the best cosine, 0 to 1) and rejected: no letter, or
    too far from its nearest centroid: the score is under ``reject_below`` times the cosine that all but one in a hundred
    of that centroid's own training rows have.

    Defined cases: a text that is null or has no letter is `und` with score 0; all texts are where nothing can be
    learned; ties go to the language that sorts first; rows without doc_id aren't learned from; repeated rows count
    as rows; an empty table gives an empty result; other columns are ignored.
    """
    learned = docs if learn is None else docs.filter(learn)
    rows = learned.filter("lang is not null and doc_id is not null and text is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    model = fit(rows, per_model, k, sizes, dims)
    told = docs.sparkSession.sparkContext.broadcast(model)
    source = texts(docs, *(c for c in carry if c != "text")).withColumn("lettered", F.col("text").rlike(r"\p{L}"))
    names = ["doc_id", *carry]

    def scan(batches):
        model = told.value
        for flush in flushes(batches, most=1 << 20):
            lettered = flush.rows.column(flush.rows.schema.get_field_index("lettered")).to_pylist()
            langs, scores, far, block, at = ["und"] * flush.n, np.zeros(flush.n), np.ones(flush.n, bool), [], []

            def judge():
                if block:
                    cosine = np.stack(block) @ model.centroids.T
                    for i, best, c in zip(at, cosine.argmax(axis=1).tolist(), cosine.max(axis=1).tolist()):
                        langs[i], scores[i], far[i] = model.langs[best], min(1.0, max(0.0, c)), c < reject_below * model.floors[best]
                    block.clear(), at.clear()

            if model is not None:
                for i, counts in enumerate(_counts(flush, sizes, dims)):
                    if lettered[i]:
                        block.append(_weights(counts.astype(np.float32), model.idf))
                        at.append(i)
                    if len(block) == 256:
                        judge()
                judge()
            columns = [flush.rows.column(flush.rows.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs), pa.array(scores), pa.array(far)], names=[*names, "lang_pred", "score", "rejected"])

    kinds = dict(source.dtypes)
    return source.mapInArrow(scan, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", lang_pred string, score double, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the predicted language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, learn=fold("doc_id", 4) != 2)
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(True)).alias("held_out"), "lang_pred", "score", "rejected")
