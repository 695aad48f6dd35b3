"""Toxicity by two class-conditional Kneser-Ney models over the characters of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm.common import LOWER, byte_table, cut, few, flushes, fold, ranges, table, texts, word_spans
from logsift.llm.quality import isotonic

#: Symbols of an n-gram: up to eight before the one that is told, a word's start among them.
ORDER = 9
#: Shared continuation counts are of so many symbols at most: below the long n-grams, all there is to tell is spelling.
LOW = 3
#: What is taken off a class's counts: what a class has so few times is told by the shared counts.
DISCOUNT = 2.0
#: A word counts by how much its log-likelihood ratio is over this. Words below are no evidence of their own: they tell a
#: text's language or subject, which may be unevenly spread over the classes, in every word of it.
BEYOND = 2.0
#: About so many labelled rows of each class are learned from, chosen by a hash of their id.
SAMPLE = 10_000
#: Up to so many different n-grams are kept; beyond, the rarest go and leave their mass to the shared counts.
GRAMS = 2_000_000
_MEMBER = byte_table(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
_START, _END = 1, 2
#: Scores before calibration are counted in steps of this size, up to so many either way.
STEP, SPAN = 1 / 256, 8.0


def _words(flush):
    """(symbols, starts, ends) of a flush's different folded words, start and end marks included; number of each word; rows' first words."""
    flush.bytes = LOWER[flush.bytes]
    starts, ends, first = word_spans(flush, _MEMBER)
    h = ranges(flush.bytes, starts, ends)
    _, at, number = np.unique(h, return_index=True, return_inverse=True)
    starts, size = starts[at], (ends - starts)[at]
    to = np.cumsum(size + 2)
    begin = to - (size + 2)
    data = np.full(int(to[-1]) if len(to) else 0, _START, np.uint8)
    if len(to):
        place = np.repeat(begin + 1 - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        data[place] = flush.bytes[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        data[to - 1] = _END
    return data, begin, to, number, first


def _places(begin: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each symbol that is told (all but start marks): its place, its word's first place and its word."""
    size = to - begin - 1
    word = np.repeat(np.arange(len(begin)), size)
    place = np.repeat(begin + 1 - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return place, begin[word], word


def _hashed(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hashes of ranges that rise in both ends; an empty one has hash 0."""
    out = np.zeros(len(low), np.uint64)
    k = np.flatnonzero(high > low)
    out[k] = ranges(data, low[k], high[k])
    return out


_GRAM = "gram long, shorter long, context long, size int, start boolean, ordinary long, toxic long"


def gram_counts(rows: DataFrame) -> DataFrame:
    """N-grams of the training words, how often each class has them, what they end in and what comes before their last symbol.

    Kept are those of ``ORDER`` symbols or from a word's start, and all of up to ``LOW`` + 1 for the shared counts.
    ``rows``: text, label (1 toxic, 0 ordinary). A flush's words are counted before its n-grams are.
    """

    def count(batches):
        for flush in flushes(batches):
            toxic = flush.longs("label")
            data, begin, to, number, first = _words(flush)
            if not len(begin):
                continue
            of = np.repeat(toxic, np.diff(first))
            counts = np.stack([np.bincount(number[of == c], minlength=len(begin)) for c in (0, 1)])
            place, head, word = _places(begin, to)
            for size in range(1, ORDER + 1):
                # a shorter n-gram that reaches its word's start is the same as the one before
                k = np.flatnonzero(place - size + 1 >= head if size <= LOW + 1 or size == ORDER else place - size + 1 == head)
                low, high = place[k] - size + 1, place[k] + 1
                h = _hashed(data, low, high)
                unique, at, which = np.unique(h, return_index=True, return_inverse=True)
                both = [np.bincount(which, counts[c][word[k]], minlength=len(unique)).astype(np.int64) for c in (0, 1)]
                columns = [unique, _hashed(data, np.maximum(low + 1, high - LOW), high)[at], _hashed(data, low, high - 1)[at]]
                yield pa.RecordBatch.from_arrays([*[pa.array(x.view(np.int64)) for x in columns], pa.array(np.full(len(unique), size, np.int32)), pa.array((low == head[k])[at]), *map(pa.array, both)], names=["gram", "shorter", "context", "size", "start", "ordinary", "toxic"])

    found = rows.select("text", F.col("label").cast("long").alias("label")).mapInArrow(count, _GRAM)
    first = lambda c: F.first(c).alias(c)
    return found.groupBy("gram").agg(first("shorter"), first("context"), first("size"), first("start"), F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted keys among sorted ones, and which are there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def _discount(counts: np.ndarray) -> float:
    """The absolute discount of Ney, Essen and Kneser, from how many n-grams are seen once and twice."""
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once and twice else 0.75


class Model:
    """What one class's log-likelihood of a symbol is over the other's, by n-gram or, where it is unseen, by context.

    Both models are interpolated Kneser-Ney. The longest n-gram before a symbol, cut at the word's start, has counts
    of its class; what is discounted goes to the counts of both classes together, and from these to continuation counts
    of its last ``LOW`` symbols and ever fewer (by how many different symbols they are preceded). All that is backed off to is shared. So
    a symbol that neither class has seen after its context differs by the back-off weights alone, and one after an
    unseen context not at all.
    """

    def __init__(self, g: dict[str, np.ndarray]):
        by = np.argsort(g["gram"])
        g = {k: v[by] for k, v in g.items()}
        self.gram, n = g["gram"], len(g["gram"])
        # how many different n-grams of one more symbol end in each one
        ends, n_before = np.unique(g["shorter"][(g["size"] > 1) & (g["size"] <= LOW + 1)], return_counts=True)
        at, there = _at(ends, self.gram)
        before = np.where(there, n_before[at], 0) if len(ends) else np.zeros(n, np.int64)
        shared = np.zeros(n)
        for size in range(1, LOW + 1):
            k = np.flatnonzero((g["size"] == size) & (before > 0))
            if not len(k):
                continue
            _, which = np.unique(g["context"][k], return_inverse=True)
            total, kinds = np.bincount(which, before[k])[which], np.bincount(which)[which]
            d = _discount(before[k])
            if size > 1:
                up, _ = _at(self.gram, g["shorter"][k])
                back = shared[up]
            else:
                back = np.full(len(k), 1 / 256)
            shared[k] = (before[k] - d + d * kinds * back) / total
        top = np.flatnonzero((g["size"] == ORDER) | g["start"])
        contexts, which = np.unique(g["context"][top], return_inverse=True)
        per = lambda x: np.bincount(which, x, minlength=len(contexts))
        up, there = _at(self.gram, g["shorter"][top])
        back = np.where(there, shared[up], 0.0) if n else np.zeros(0)
        pooled = g["ordinary"][top] + g["toxic"][top]
        d = _discount(pooled)
        back = (pooled - d + d * per(np.ones(len(top)))[which] * np.maximum(back, 1e-12)) / per(pooled)[which]
        log_p, weight = [], []
        for name in ("ordinary", "toxic"):
            c = g[name][top]
            total = np.maximum(per(c), 1e-300)
            free = np.where(per(c) > 0, per(np.minimum(c, DISCOUNT)) / total, 1.0)
            log_p.append(np.log(np.maximum(c - DISCOUNT, 0) / total[which] + free[which] * back))
            weight.append(np.log(free))
        self.seen, self.ratio = self.gram[top], log_p[1] - log_p[0]
        self.context, self.free = contexts, weight[1] - weight[0]
        del self.gram

    def words(self, data: np.ndarray, begin: np.ndarray, to: np.ndarray) -> np.ndarray:
        """The log-likelihood of each word as a toxic text's over that as an ordinary one's."""
        place, head, word = _places(begin, to)
        low = np.maximum(place - ORDER + 1, head)
        at, hit = _at(self.seen, _hashed(data, low, place + 1))
        told = np.zeros(len(place))
        told[hit] = self.ratio[at[hit]]
        miss = np.flatnonzero(~hit)
        at, hit = _at(self.context, _hashed(data, low[miss], place[miss]))
        told[miss[hit]] = self.free[at[hit]]
        return np.bincount(word, told, minlength=len(begin))


def _collected(grams: DataFrame, most: int) -> dict[str, np.ndarray]:
    """The model's counts; if there are more than ``most`` n-grams, the least count that leaves few enough is asked for.

    What a kept one ends in is at least as frequent, so it is kept too.
    """
    count = F.col("ordinary") + F.col("toxic")
    by_count = sorted(grams.groupBy(F.least(count, F.lit(1000)).alias("c")).count().collect(), reverse=True)
    total, least = 0, 1
    for c, n in by_count:
        if total + n > most:
            least = c + 1
            break
        total += n
    rows = grams.filter(count >= least).toArrow()
    one = lambda c: rows.column(c).combine_chunks().to_numpy(zero_copy_only=False)
    return {c: one(c).view(np.uint64) if c in ("gram", "shorter", "context") else one(c) for c in rows.column_names}


def toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 5, threshold: float = 0.5, sample: int = SAMPLE, grams: int = GRAMS, beyond: float = BEYOND) -> DataFrame:
    """Score every whole text by how likely it is that it is toxic.

    Method: an ordinary and a toxic Kneser-Ney model of words as series of characters, learned from up to about
    ``sample`` labelled rows of each class (whole texts, chosen by hash), with shared counts to back off to (``Model``). A
    word's log-likelihood under the toxic model over that under the ordinary one counts as far as it is over
    ``beyond``; the sum by the number of words is calibrated by isotonic regression. Rows whose crc32(doc_id) mod ``held_out`` is 0 aren't learned
    from; those with remainder 1 calibrate.

    Returns doc_id, held_out, score (0 to 1), predicted (1 if score >= ``threshold``) and ratio, that mean over words.

    Defined cases: null, empty and wordless texts have a ratio of 0 and are scored by it; null labels are ignored,
    of several of one doc_id the greatest counts; without labels of both classes every score is the share of toxic
    ones (0 without any); rows without doc_id are held out; repeated rows are scored each; an empty table gives an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    source = texts(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).filter("doc_id is not null and label is not null")
    known = cut(known.withColumn("fold", fold("doc_id", held_out)).filter("fold <> 0").groupBy("doc_id", "fold").agg(F.max("label").alias("label")))
    # a fold learns, another calibrates; with two folds one does both
    learn = F.col("fold") != 1 if held_out > 2 else F.lit(True)
    sizes = {r["label"]: r["count"] for r in known.filter(learn).groupBy("label").count().collect()}
    share = sum((F.when(F.col("label") == k, int((1 << 30) * min(1.0, sample / n))).otherwise(0) for k, n in sizes.items()), F.lit(0))
    chosen = known.filter(learn).filter(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 30)) < share)
    both = sizes.get(0) and sizes.get(1)
    rate = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    empty = {"gram": np.uint64, "shorter": np.uint64, "context": np.uint64, "size": np.int32, "start": bool, "ordinary": np.int64, "toxic": np.int64}
    counts = _collected(cut(gram_counts(source.join(few(chosen.select("doc_id", "label")), "doc_id"))), grams) if both else {c: np.zeros(0, t) for c, t in empty.items()}
    told = spark.sparkContext.broadcast(Model(counts))

    def compare(batches):
        for flush in flushes(batches):
            data, begin, to, number, first = _words(flush)
            value = np.maximum(told.value.words(data, begin, to) - beyond, 0)[number] if len(begin) else np.zeros(0)
            total = np.concatenate([[0], np.cumsum(value)])
            yield pa.RecordBatch.from_arrays([flush.rows.column(flush.rows.schema.get_field_index("doc_id")), pa.array((total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(first), 1))], names=["doc_id", "ratio"])

    compared = source.mapInArrow(compare, "doc_id long, ratio double")
    out = [F.coalesce(fold("doc_id", held_out) == 0, F.lit(True)).alias("held_out")]
    if not both:
        return compared.select("doc_id", *out, F.lit(float(rate)).alias("score"), F.lit(int(rate >= threshold)).alias("predicted"), "ratio")
    compared = cut(compared)
    tests = known.filter("fold = 1") if held_out > 2 else known
    step = F.round(F.least(F.greatest(F.col("ratio"), F.lit(-SPAN)), F.lit(SPAN)) / STEP).cast("int")
    steps = compared.join(few(tests.select("doc_id", "label")), "doc_id").groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("y"))
    counted = sorted(steps.collect())  # at most 2 * SPAN / STEP rows
    knots, values = np.array([r[0] for r in counted]) * STEP, isotonic(np.array([float(r[1]) for r in counted]), np.array([r[2] for r in counted]))
    if not len(knots):
        knots, values = np.array([-1.0, 1.0]), np.array([0.0, 1.0])

    def score(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.interp(batch.column(1).to_numpy(), knots, values)), batch.column(1)], names=["doc_id", "score", "ratio"])

    scored = compared.mapInArrow(score, "doc_id long, score double, ratio double")
    return scored.select("doc_id", *out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "ratio")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the toxicity of every document."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
