"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm.common import byte_table, cut, dealt, flushes, fold, grams, ranges, summed, table, texts, word_spans

#: What a document is judged by: sizes, shares of kinds of bytes and words, repetition.
STATISTICS = ["words", "bytes", "word_bytes", "upper", "symbols", "exclamations", "bars", "stops", "digits", "wide", "lines", "line_words", "again", "distinct", "distinct3", "short", "long", "odd_end", "upper_words"]
_SYMBOLS = byte_table(b"*%&#$@^~<>{}[]\\_=+")


def statistics(docs: DataFrame, *carry: str) -> DataFrame:
    """(doc_id, carry..., stats array<double>) of whole texts; an empty text has zeros."""
    source = texts(docs, *carry)
    names = ["doc_id", *carry]
    size = len(STATISTICS)

    def share(hit: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(hit)])
        return (total[at[1:]] - total[at[:-1]]) / np.maximum(of, 1)

    def scan(batches):
        for flush in flushes(batches, most=2 << 20):
            b, at = flush.bytes, flush.at
            n_bytes = np.diff(at)
            starts, ends, first = word_spans(flush)
            n_words = np.diff(first)
            h = ranges(b, starts, ends)
            row = np.repeat(np.arange(flush.n), n_words)
            upper = (b >= 65) & (b <= 90)
            letters = upper | ((b >= 97) & (b <= 122)) | (b >= 128)
            n_letters = share(letters, at, np.ones(flush.n))
            lines = share(b == 10, at, np.ones(flush.n)) + (n_words > 0)
            last = b[ends - 1] if len(ends) else np.zeros(0, np.uint8)
            odd = ~(letters[ends - 1] | np.isin(last, [44, 46])) if len(ends) else np.zeros(0, bool)
            again = np.append(False, (h[1:] == h[:-1]) & (row[1:] == row[:-1])) if len(h) else np.zeros(0, bool)
            three, ok = grams(h, 3, first)

            def distinct(x: np.ndarray, of: np.ndarray) -> np.ndarray:
                order = np.lexsort((x, of))
                new = np.append(True, (x[order][1:] != x[order][:-1]) | (of[order][1:] != of[order][:-1])) if len(x) else np.zeros(0, bool)
                return np.bincount(of[order][new], minlength=flush.n)

            wide = ends - starts
            f = np.zeros((flush.n, size))
            f[:, 0], f[:, 1] = np.log1p(n_words), np.log1p(n_bytes)
            f[:, 2] = share(wide, first, n_words)
            f[:, 3] = share(upper, at, n_letters)
            for i, hit in enumerate((_SYMBOLS[b], b == 33, b == 124, (b == 44) | (b == 46), (b >= 48) & (b <= 57), b >= 128)):
                f[:, 4 + i] = share(hit, at, n_bytes)
            f[:, 10], f[:, 11] = np.log1p(lines), np.log1p(n_words / np.maximum(lines, 1))
            f[:, 12] = share(again, first, n_words)
            f[:, 13] = np.log(np.maximum(distinct(h, row), 1) / np.maximum(n_words, 1))
            f[:, 14] = distinct(three[ok], row[ok]) / np.maximum(n_words - 2, 1)
            f[:, 15], f[:, 16] = share(wide <= 2, first, n_words), share(wide > 12, first, n_words)
            f[:, 17] = share(odd, first, n_words)
            f[:, 18] = share(upper[starts] & (wide > 1) & upper[np.minimum(starts + 1, max(len(b) - 1, 0))], first, n_words) if len(starts) else 0
            columns = [flush.rows.column(flush.rows.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.FixedSizeListArray.from_arrays(pa.array(f.reshape(-1)), size).cast(pa.list_(pa.float64()))], names=[*names, "stats"])

    kinds = dict(source.dtypes)
    return source.mapInArrow(scan, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


class Model:
    """Standardised statistics through cosines of random projections to a linear score, then to a probability."""

    def __init__(self, mean, scale, features: int, gamma: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.asarray(mean), np.asarray(scale)
        self.project = rng.normal(0, np.sqrt(2 * gamma), (len(self.mean), features))
        self.phase = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.knots, self.values = np.array([0.0]), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.project + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0, 1)


def isotonic(weight: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``value``: pool adjacent violators."""
    pools: list[list[float]] = []
    for w, v in zip(weight.tolist(), value.tolist()):
        pools.append([w, v, 1])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            w2, v2, n2 = pools.pop()
            w1, v1, n1 = pools.pop()
            pools.append([w1 + w2, (w1 * v1 + w2 * v2) / (w1 + w2), n1 + n2])
    return np.repeat([p[1] for p in pools], [p[2] for p in pools])


#: Raw scores are counted in steps of this size for the calibration.
STEP = 1 / 512


def fit(labelled: DataFrame, features: int = 384, gamma: float = 0.03, ridge: float = 1e-3, seed: int = 7) -> Model:
    """``labelled``: stats, label (0 to 1), calibrate (boolean). Three passes; only sums and counts leave the tasks."""
    size = len(STATISTICS)
    moments = labelled.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("rate"), *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(size)], *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(size)]).first()
    model = Model([moments[f"m{i}"] or 0.0 for i in range(size)], [moments[f"s{i}"] or 1.0 for i in range(size)], features, gamma, seed)
    if not moments["n"]:
        return model
    model.values = np.array([float(moments["rate"])])
    d = features + 1
    told = labelled.sparkSession.sparkContext.broadcast(model)

    def normal(batches):
        a, b, n = np.zeros((d, d)), np.zeros(d), 0
        for batch in batches:
            if batch.num_rows:
                z, y = told.value.features(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False)
                a += z.T @ z
                b += z.T @ y
                n += len(y)
        yield dealt(np.concatenate([a.reshape(-1), b, [n]]))

    total = summed(labelled.filter("not calibrate").select("stats", "label").mapInArrow(normal, "deal int, sums binary"), d * d + d + 1)
    a, b, n = total[: d * d].reshape(d, d), total[d * d : -1], total[-1]
    if not n:
        return model
    penalty = np.full(d, ridge * n)
    penalty[-1] = 0
    model.weights = np.linalg.solve(a + np.diag(penalty) + 1e-9 * np.eye(d), b)
    told = labelled.sparkSession.sparkContext.broadcast(model)

    def raw(batches):
        for batch in batches:
            if batch.num_rows:
                at = np.round(np.clip(told.value.raw(_matrix(batch.column(0))), -2, 3) / STEP).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], names=["step", "label"])

    steps = labelled.filter("calibrate").select("stats", "label").mapInArrow(raw, "step int, label double").groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("y"))
    counts = sorted(steps.collect())  # at most 5 / STEP rows
    if counts:
        model.knots = np.array([r[0] for r in counts]) * STEP
        model.values = isotonic(np.array([float(r[1]) for r in counts]), np.array([r[2] for r in counts]))
    return model


def quality(docs: DataFrame, labels: DataFrame, held_out: int = 5, threshold: float = 0.3, **fitting) -> DataFrame:
    """Score every whole text by how likely its label is 1.

    Method: statistics of the text pass through random Fourier features of a Gaussian kernel; ridge scores come
    from normal equations that are summed partition by partition, and isotonic calibration on rows that the ridge
    hasn't seen turns them into probabilities. All labelled rows are learned from but those whose crc32(doc_id)
    mod ``held_out`` is 0; those with remainder 1 calibrate.

    Returns doc_id, held_out, score (0 to 1) and predicted (1 if score >= ``threshold``).

    Defined cases: a null or empty text has zero statistics and is scored; null labels are ignored, several of one
    doc_id are averaged; without labels every score is 0.5; rows without doc_id are held out; repeated rows are
    scored each; an empty table gives an empty result; other columns are ignored.
    """
    stats = cut(statistics(docs))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label")).filter("doc_id is not null and label is not null")
    known = known.withColumn("fold", fold("doc_id", held_out)).filter("fold <> 0").groupBy("doc_id", "fold").agg(F.avg("label").alias("label"))
    model = fit(stats.join(known, "doc_id").select("stats", "label", (F.col("fold") == 1).alias("calibrate")), **fitting)
    told = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told.value.score(_matrix(batch.column(1))))], names=["doc_id", "score"])

    scored = stats.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id", held_out) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the quality of every document."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
