"""Hard negatives by exact search over length buckets with sorted coordinate lists."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsift.llm.common import cut, table

#: Vectors and anchors that meet in one task, at most about. A copy of a vector meets this many anchors, so moving it
#: weighs little beside comparing it.
PROBES, ANCHORS = 32_768, 8_192
#: Vectors of one length bucket, and anchors that are compared with it at a time.
BUCKET, BATCH = 1024, 256
#: Focus coordinates of an anchor, those of the largest share of its length.
FOCUS = 3
#: Candidates are verified one by one where no more than this share of a bucket is left, as a block beyond.
FEW = 0.1
#: Components of the whole-number vectors are held to this.
MOST = 1 << 20


class Bucket:
    """Vectors of about one length, with a sorted list of values for each coordinate."""

    def __init__(self, vectors: np.ndarray, norms: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        self.vectors, self.ids, self.labels = vectors, ids, labels
        self.longest = float(norms.max())
        self.unit = vectors / np.maximum(norms, 1e-300)[:, None]
        self.order = np.argsort(self.unit, axis=0, kind="stable")
        self.values = np.take_along_axis(self.unit, self.order, axis=0)


def bucketed(vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> list[Bucket]:
    """Buckets of ``BUCKET`` vectors in order of descending length."""
    norms = np.linalg.norm(vectors, axis=1)
    by = np.argsort(-norms, kind="stable")
    return [Bucket(vectors[k], norms[k], ids[k], labels[k]) for k in (by[i : i + BUCKET] for i in range(0, len(by), BUCKET))]


def feasible(q: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Between which values a unit vector's coordinate lies if its cosine to a query is ``cosine`` or more.

    ``q``: the query's own value there. The rest of both vectors adds sqrt(1 - q²) sqrt(1 - p²) at most; solved for p.
    """
    wide = np.sqrt(np.maximum(1 - cosine**2, 0) * np.maximum(1 - q**2, 0))
    low = np.where(q < -cosine, -1.0, q * cosine - wide)
    high = np.where(q > cosine, 1.0, q * cosine + wide)
    return low - 1e-9, high + 1e-9


def candidates(bucket: Bucket, unit: np.ndarray, focus: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(anchor, vector) numbers that may have the cosine that each anchor asks for; None if these are most pairs.

    The range of the focus coordinate with the shortest stretch of its sorted list gives an anchor's candidates;
    those of the other focus coordinates are intersected with it.
    """
    q = np.take_along_axis(unit, focus, axis=1)
    low, high = feasible(q, cosine[:, None])
    n = len(bucket.vectors)
    first, last = np.zeros(focus.shape, np.int64), np.full(focus.shape, n)
    for c in np.unique(focus):
        r, f = np.nonzero(focus == c)
        first[r, f] = np.searchsorted(bucket.values[:, c], low[r, f], "left")
        last[r, f] = np.searchsorted(bucket.values[:, c], high[r, f], "right")
    size = np.maximum(last - first, 0)
    best = size.argmin(axis=1)
    row = np.arange(len(unit))
    count = size[row, best]
    if count.sum() > FEW * n * len(unit):
        return None
    a = np.repeat(row, count)
    place = np.repeat(first[row, best] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    p = bucket.order[place, focus[row, best][a]]
    for f in range(focus.shape[1]):
        value = bucket.unit[p, focus[a, f]]
        k = (low[a, f] <= value) & (value <= high[a, f])
        a, p = a[k], p[k]
    return a, p


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of whole-number vectors, exact: in doubles where these hold every sum, in 64-bit integers beyond."""
    most = (np.abs(x).max(initial=0)) * (np.abs(y).max(initial=0)) * x.shape[-1]
    if most >= 1 << 53:
        x, y = x.astype(np.int64), y.astype(np.int64)
    return x @ y.T


def _pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    most = (np.abs(x).max(initial=0)) * (np.abs(y).max(initial=0)) * x.shape[-1]
    if most >= 1 << 53:
        x, y = x.astype(np.int64), y.astype(np.int64)
    return np.einsum("ij,ij->i", x, y)


class Best:
    """The first ``k`` (score, id) of each of ``n`` queries, higher scores and then smaller ids first."""

    def __init__(self, n: int, k: int):
        self.k, self.query, self.id, self.score = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(n, -np.inf)

    def add(self, query: np.ndarray, id_: np.ndarray, score: np.ndarray) -> None:
        if not len(query):
            return
        query, id_, score = (np.concatenate(x) for x in ((self.query, query), (self.id, id_), (self.score, score.astype(np.int64))))
        by = np.lexsort((id_, -score, query))
        query, id_, score = query[by], id_[by], score[by]
        head = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        place = np.arange(len(query)) - np.repeat(head, np.diff(np.append(head, len(query))))
        k = place < self.k
        self.query, self.id, self.score = query[k], id_[k], score[k]
        full = place == self.k - 1
        self.least[query[full]] = score[full]


def search(buckets: list[Bucket], anchors: np.ndarray, ids: np.ndarray, labels: np.ndarray, want: int, low: np.ndarray | None = None, high: np.ndarray | None = None) -> Best:
    """Exact top rows of each query among the buckets' vectors.

    Without bounds a query is an anchor, and rows of its label but with another id count. With them an anchor has a
    row of queries, bounds (``low`` over ``high``: no query), and rows of other labels whose score is within count. A
    bucket is passed over once its longest vector can't reach what an anchor still needs; else that need, over both
    lengths, is the cosine from which the feasible ranges follow.
    """
    slots = 1 if low is None else low.shape[1]
    norms = np.linalg.norm(anchors, axis=1)
    unit = anchors / np.maximum(norms, 1e-300)[:, None]
    focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
    found = Best(len(anchors) * slots, want)
    told = []
    for i in range(0, len(anchors), BATCH):
        batch = slice(i, i + BATCH)
        bounds = (None, None) if low is None else (low[batch], high[batch])
        best = _batch(buckets, anchors[batch], unit[batch], norms[batch], focus[batch], ids[batch], labels[batch], slots, want, *bounds)
        told.append((best.query + i * slots, best.id, best.score))
    if told:
        found.query, found.id, found.score = (np.concatenate(x) for x in zip(*told))
    return found


def _batch(buckets, anchors, unit, norms, focus, ids, labels, slots, want, low, high) -> Best:
    best = Best(len(anchors) * slots, want)
    for bucket in buckets:
        need = best.least if low is None else np.where(low <= high, np.maximum(low, best.least.reshape(-1, slots)), np.inf).min(axis=1)
        reach = norms * bucket.longest
        rows = np.flatnonzero(need <= reach * (1 + 1e-12))
        if not len(rows):
            continue
        need, reach = need[rows], reach[rows]
        cosine = need / np.maximum(reach, 1e-300)
        pairs = candidates(bucket, unit[rows], focus[rows], cosine) if (cosine > 0).all() else None
        if pairs is None:
            score = products(anchors[rows], bucket.vectors)
            a, p = np.nonzero(score >= need[:, None])
            score = score[a, p]
        else:
            a, p = pairs
            score = _pairs(anchors[rows[a]], bucket.vectors[p])
        a = rows[a]
        if low is None:
            k = (labels[a] == bucket.labels[p]) & (ids[a] != bucket.ids[p]) & (score >= best.least[a])
            best.add(a[k], bucket.ids[p[k]], score[k])
            continue
        k = labels[a] != bucket.labels[p]
        a, p, score = a[k], p[k], score[k]
        query = [a * slots + s for s in range(slots)]
        k = [(low[a, s] <= score) & (score <= high[a, s]) & (score >= best.least[q]) for s, q in enumerate(query)]
        best.add(np.concatenate([q[x] for q, x in zip(query, k)]), np.concatenate([bucket.ids[p[x]] for x in k]), np.concatenate([score[x] for x in k]))
    return best


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of one length as whole numbers in doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return np.clip(np.floor(flat * 256), -MOST, MOST).reshape(len(column), -1)


def _longs(rows: pa.Table, *columns: str) -> list[np.ndarray]:
    return [rows.column(c).to_numpy().astype(np.int64) for c in columns]


def _named(anchors: pa.Table, at: np.ndarray) -> dict:
    """An anchor's id and its row's hash, which tells apart rows of one id."""
    return {"anchor_id": anchors.column("vec_id").take(pa.array(at)), "anchor": anchors.column("row").take(pa.array(at))}


def _positives(want: int):
    def meet(anchors: pa.Table, probes: pa.Table) -> pa.Table:
        ids, labels = _longs(anchors, "vec_id", "label")
        best = Best(len(ids), want)
        if len(ids) and probes.num_rows:
            best = search(bucketed(_vectors(probes.column("vector")), *_longs(probes, "vec_id", "label")), _vectors(anchors.column("vector")), ids, labels, want)
        return pa.table({**_named(anchors, best.query), "positive_id": pa.array(best.id), "positive_score": pa.array(best.score)})

    return meet


def _bounds(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest negative score that the two shares of a positive's allow."""
    return -((-low * score) // 100), (high * score) // 100


def _negatives(want: int, low: int, high: int):
    def meet(anchors: pa.Table, probes: pa.Table) -> pa.Table:
        ids, labels = _longs(anchors, "vec_id", "label")
        scores = anchors.column("scores").combine_chunks()
        held = np.diff(np.asarray(scores.offsets))
        slots = int(held.max(initial=1)) or 1
        best = Best(len(ids) * slots, want)
        if len(ids) and probes.num_rows:
            every = np.arange(slots) < held[:, None]
            own = np.zeros((len(ids), slots), np.int64)
            own[every] = scores.flatten().to_numpy(zero_copy_only=False)
            least, most = (x.astype(np.float64) for x in _bounds(own, low, high))
            least[~every], most[~every] = 1, 0
            best = search(bucketed(_vectors(probes.column("vector")), *_longs(probes, "vec_id", "label")), _vectors(anchors.column("vector")), ids, labels, want, least, most)
        return pa.table({**_named(anchors, best.query // slots), "slot": pa.array((best.query % slots).astype(np.int32)), "negative_id": pa.array(best.id), "negative_score": pa.array(best.score)})

    return meet


def hard_negatives(rows: DataFrame, anchors: str = "vec_id % 50 = 0", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, probes: int = PROBES, per_task: int = ANCHORS) -> DataFrame:
    """For each anchor and each of its first positives, the first rows of other labels between two shares of its score.

    Method: vectors are put in buckets of about one length with a sorted list for each coordinate. What an anchor
    still needs (its worst kept score, or the lower bound) over its own and the bucket's greatest length is a cosine;
    for the anchor's focus coordinates it leaves ranges of feasible values, whose stretches of the sorted lists are
    intersected, and what remains is verified exactly in whole numbers. Buckets too short to reach the need are
    passed over; where the ranges leave over a tenth of a bucket, the bucket is verified as a block. Vectors are dealt
    out by hash in parts of about ``probes``, anchors (``anchors``: a condition) in parts of about ``per_task``; each
    pair of parts is one task, once for the positives and once for the negatives, which need the positives' scores.
    The first rows of each part are merged, so no result depends on how rows are dealt out.

    Scores are inner products of components floor(256 x). ``low`` and ``high``: hundredths of the positive's score.
    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Defined cases: rows with a null id, label or vector or with a null or non-finite component take no part; rows that
    repeat id, label and vector count once, and other rows of the anchor's id aren't its positives; ties go to
    the smaller id; vectors of different length don't meet; zero vectors score 0; whole-number components are
    held to 2**20 either way; an empty table gives an empty result; other columns are ignored.
    """
    spark = rows.sparkSession
    kind = "array<float>" if dict(rows.dtypes)["embedding"] == "array<float>" else "array<double>"
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(kind).alias("vector"))
    own = own.filter(F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False)))
    own = own.withColumn("size", F.size("vector")).withColumn("row", F.xxhash64("vec_id", "label", F.to_json("vector"))).dropDuplicates(["vec_id", "label", "row"])
    own = cut(own)
    n, n_anchors = own.agg(F.count(F.lit(1)), F.count_if(F.expr(anchors))).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(math.ceil(n / probes), min(least, math.ceil(n / BUCKET)), 1)
    groups = max(math.ceil(n_anchors / per_task), 1)
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    pairing = ["size", "part", "group"]
    told = own.withColumn("part", F.pmod(F.hash("row"), F.lit(parts))).withColumn("group", each(groups))
    asked = own.filter(anchors).withColumn("group", F.pmod(F.hash("row", F.lit(1)), F.lit(groups)))
    meet = lambda frame, work, schema: frame.withColumn("part", each(parts)).groupBy(*pairing).cogroup(told.groupBy(*pairing)).applyInArrow(work, schema)

    anchor = ["anchor_id", "anchor"]
    first = W.partitionBy(*anchor).orderBy(F.desc("positive_score"), "positive_id")
    found = meet(asked, _positives(positives), "anchor_id long, anchor long, positive_id long, positive_score long")
    found = cut(found.withColumn("slot", (F.row_number().over(first) - 1).cast("int")).filter(F.col("slot") < positives))
    scores = found.groupBy(*anchor).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    known = cut(asked.join(scores, (asked["vec_id"] == scores["anchor_id"]) & (asked["row"] == scores["anchor"])).drop(*anchor))

    best = W.partitionBy(*anchor, "slot").orderBy(F.desc("negative_score"), "negative_id")
    out = meet(known, _negatives(negatives, low, high), "anchor_id long, anchor long, slot int, negative_id long, negative_score long")
    out = out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    return out.join(found, [*anchor, "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: hard negatives of every fiftieth embedding; every seventh has the next label."""
    rows = table(spark, sf_dir, "embeddings")
    return hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))
