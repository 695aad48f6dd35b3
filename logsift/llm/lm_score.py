"""Language-model scoring by subword lattice likelihood."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm.common import LOWER, Flush, buckets, cut, dealt, flushes, fold, ranges, summed, table, texts, word_spans


def model_path() -> str:
    """A public subword vocabulary with scores."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, a word's start as a space, and their log probabilities.

    The weights are the file's own scores. These fall by one from piece to piece, in the order in which the pieces
    were merged, so they are read as ranks: a piece of score -r weighs 1 / (r + 2.7), as in a Zipf law. Single bytes
    have the least weight and cover every text. Pieces with a space inside, or with a capital, can't occur.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[bytes, float] = {bytes([b]): 0.0 for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_unknown(i) or model.is_control(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if piece and b" " not in piece[1:] and not any(65 <= b <= 90 for b in piece):
            pieces[piece] = max(pieces.get(piece, 0.0), 1 / (2.7 - model.get_score(i)))
    least = min(x for x in pieces.values() if x)
    weight = np.array([x or least for x in pieces.values()])
    return list(pieces), np.log(weight / weight.sum())


class Lattice:
    """All segmentations of words into pieces, many words of one length at a time."""

    LONG = 256

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.logp, self.longest = logp, max(map(len, pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        h = ranges(data, np.concatenate([[0], ends[:-1]]), ends)
        self.order = np.argsort(h)
        self.hash = h[self.order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[h & np.uint64((1 << 20) - 1)] = True
        self.by_text = {p: i for i, p in enumerate(pieces)}

    def _edges(self, words: np.ndarray):
        """(start, end, words that have a piece there, the pieces), by end and then start; ``words`` has a row a word."""
        n, size = words.shape
        flat = np.ascontiguousarray(words).reshape(-1)
        base = np.arange(n) * size
        for end in range(1, size + 1):
            for start in range(max(0, end - self.longest), end):
                h = ranges(flat, base + start, base + end)
                k = np.flatnonzero(self.maybe[h & np.uint64((1 << 20) - 1)])
                if len(k):
                    at = np.minimum(np.searchsorted(self.hash, h[k]), len(self.hash) - 1)
                    hit = self.hash[at] == h[k]
                    if hit.any():
                        yield start, end, k[hit], self.order[at[hit]]

    def forward(self, words: np.ndarray) -> np.ndarray:
        """Log of each word's probability over all segmentations."""
        n, size = words.shape
        alpha = np.full((size + 1, n), -np.inf)
        alpha[0] = 0
        for start, end, k, piece in self._edges(words):
            alpha[end, k] = np.logaddexp(alpha[end, k], alpha[start, k] + self.logp[piece])
        return alpha[size]

    def expected(self, words: np.ndarray) -> np.ndarray:
        """How often each piece is used in these words, over all segmentations by their share of the word's probability."""
        n, size = words.shape
        edges = list(self._edges(words))
        alpha, beta = np.full((size + 1, n), -np.inf), np.full((size + 1, n), -np.inf)
        alpha[0] = beta[size] = 0
        for start, end, k, piece in edges:
            alpha[end, k] = np.logaddexp(alpha[end, k], alpha[start, k] + self.logp[piece])
        used = np.zeros(len(self.logp))
        for start, end, k, piece in reversed(edges):
            after = self.logp[piece] + beta[end, k]
            beta[start, k] = np.logaddexp(beta[start, k], after)
            used += np.bincount(piece, np.exp(alpha[start, k] + after - alpha[size, k]), minlength=len(used))
        return used

    def _forward(self, word: bytes) -> list[float]:
        """``forward`` of one long word's beginnings, from none of it to all."""
        alpha = [0.0]
        for end in range(1, len(word) + 1):
            terms = [alpha[i] + self.logp[p] for i in range(max(0, end - self.longest), end) if (p := self.by_text.get(word[i:end])) is not None]
            most = max(terms)
            alpha.append(most + math.log(sum(math.exp(x - most) for x in terms)))
        return alpha

    def _one(self, word: bytes) -> float:
        """``forward`` of one long word."""
        return float(self._forward(word)[-1])

    def _use(self, word: bytes, used: np.ndarray) -> None:
        """Add ``expected`` of one long word to ``used``; pieces are looked up again on the way back, so memory is two numbers a byte."""
        alpha, size = self._forward(word), len(word)
        beta = [0.0] * (size + 1)
        for start in range(size - 1, -1, -1):
            after = [(p, self.logp[p] + beta[end]) for end in range(start + 1, min(start + self.longest, size) + 1) if (p := self.by_text.get(word[start:end])) is not None]
            most = max(x for _, x in after)
            beta[start] = most + math.log(sum(math.exp(x - most) for _, x in after))
            for p, x in after:
                used[p] += math.exp(alpha[start] + x - alpha[size])

    def _alike(self, data: np.ndarray, at: np.ndarray):
        """(numbers, words) of up to ``LONG`` bytes, some of one length at a time."""
        size = np.diff(at)
        for s in np.unique(size[size <= self.LONG]).tolist():
            own = np.flatnonzero(size == s)
            for i in range(0, len(own), max(1, (1 << 18) // (s + 1))):
                k = own[i : i + max(1, (1 << 18) // (s + 1))]
                words = np.full((len(k), s + 1), 0x20, np.uint8)
                words[:, 1:] = data[at[k][:, None] + np.arange(s)]
                yield k, words

    def words(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log probabilities of words that lie one after the other in ``data``, ends at ``at[1:]``."""
        out = np.empty(len(at) - 1)
        for i in np.flatnonzero(np.diff(at) > self.LONG).tolist():
            out[i] = self._one(b" " + data[at[i] : at[i + 1]].tobytes())
        for k, words in self._alike(data, at):
            out[k] = self.forward(words)
        return out

    def uses(self, data: np.ndarray, at: np.ndarray, among: np.ndarray) -> np.ndarray:
        """``expected`` of the words that ``among`` marks."""
        used = np.zeros(len(self.logp))
        for i in np.flatnonzero(among & (np.diff(at) > self.LONG)).tolist():
            self._use(b" " + data[at[i] : at[i + 1]].tobytes(), used)
        for k, words in self._alike(data, at):
            if among[k].any():
                used += self.expected(words[among[k]])
        return used


def _distinct(flush: Flush):
    """(hashes ascending, byte starts, byte ends, number of each word's hash) of a flush's folded words."""
    flush.bytes = LOWER[flush.bytes]
    starts, ends, first = word_spans(flush)
    h = ranges(flush.bytes, starts, ends)
    unique, at, number = np.unique(h, return_index=True, return_inverse=True)
    return unique, starts[at], ends[at], number, first


def _take(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of some ranges one after the other."""
    size = ends - starts
    return data[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def _slices(h: np.ndarray, n: int):
    """(bucket, first, last) of ascending hashes."""
    to = ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    edge = np.flatnonzero(np.diff(to, prepend=-1)) if len(to) else np.zeros(0, np.int64)
    return [(int(to[i]), int(i), int(j)) for i, j in zip(edge, np.append(edge[1:], len(to)))]


_BLOBS = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("hash", "n", "size", "data")]])
_TYPES = "bucket int, hash binary, n binary, size binary, data binary"


def word_types(docs: DataFrame, n: int) -> DataFrame:
    """All different words with their counts in the rows that ``train`` marks, in blobs of up to 2**16 words by hash range."""

    def count(batches):
        for flush in flushes(batches):
            unique, starts, ends, number, first = _distinct(flush)
            train = np.asarray(flush.rows.column(flush.rows.schema.get_field_index("train")).to_numpy(zero_copy_only=False), np.float64)
            counts = np.bincount(number, np.repeat(train, np.diff(first)), minlength=len(unique)).astype(np.int64)
            rows = [(b, unique[i:j].tobytes(), counts[i:j].tobytes(), (ends - starts)[i:j].astype(np.int32).tobytes(), _take(flush.bytes, starts[i:j], ends[i:j]).tobytes()) for b, i, j in _slices(unique, n)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _BLOBS)], schema=_BLOBS)

    def merge(rows: pa.Table) -> pa.Table:
        get = lambda c, t: np.frombuffer(b"".join(rows.column(c).to_pylist()), t)
        h, counts, size, data = get("hash", np.uint64), get("n", np.int64), get("size", np.int32).astype(np.int64), get("data", np.uint8)
        unique, at, number = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(number, counts, minlength=len(unique)).astype(np.int64)
        ends = np.cumsum(size)
        starts = ends - size
        out = []
        for i in range(0, len(unique), 1 << 16):
            k = at[i : i + (1 << 16)]
            out.append((unique[i : i + (1 << 16)].tobytes(), total[i : i + (1 << 16)].tobytes(), size[k].astype(np.int32).tobytes(), _take(data, starts[k], ends[k]).tobytes()))
        bucket = rows.column("bucket")[0].as_py()
        return pa.Table.from_arrays([pa.array([bucket] * len(out), pa.int32()), *[pa.array(c, pa.binary()) for c in zip(*out)]], schema=_BLOBS)

    return docs.select("text", "train").mapInArrow(count, _TYPES).groupBy("bucket").applyInArrow(merge, _TYPES)


def _unblob(batch, row: int):
    get = lambda c, t: np.frombuffer(batch.column(batch.schema.get_field_index(c))[row].as_buffer(), t)
    size = get("size", np.int32).astype(np.int64)
    return get("hash", np.uint64), get("n", np.int64), np.concatenate([[0], np.cumsum(size)]), get("data", np.uint8)


#: Rounds in which the pieces' weights are fitted, and how many uses the file's own weights count for in each.
ROUNDS, PRIOR = 2, 1000.0
#: So many words of the training rows' distribution are put before a text's own.
OWN = 2000.0


class Model:
    """What training tells: N tokens, V different ones, how many of them are ends, and words seen once and twice."""

    def __init__(self, n: int, v: int, ends: int, once: int = 0, twice: int = 0, fitted: bool = False):
        self.n, self.v, self.ends, self.fitted = n, v, ends, fitted
        self.discount = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)

    def base(self, c):
        return np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))

    def end(self) -> float:
        """log10 of the chance that a text ends here: the ends' share of the training tokens, one half without any."""
        return float(self.base(self.ends)) if self.n else math.log10(0.5)

    def on(self) -> float:
        """log10 of the chance that a text goes on."""
        return math.log10(1 - min(10 ** self.end(), 0.5))

    def word(self, c: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """Natural log of words' chances, given their counts and the pieces' sums.

        In a fitted model a word of the training rows is a piece of its own. It weighs its count less a discount (from
        the words seen once and twice); what the discounts leave is the share of the segmentations into pieces.
        """
        words = self.n - self.ends
        if not self.fitted or not words:
            return lattice
        with np.errstate(divide="ignore"):
            whole = np.log(np.maximum(c - self.discount, 0) / words)
        return np.logaddexp(whole, lattice + math.log(self.discount * (self.v - 1) / words))

    def texts(self, word: np.ndarray, number: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 of each word's chance where it stands; ``number`` tells words apart, ``first`` where texts begin.

        In a fitted model the text's earlier words count along: with k of i earlier words the same, a word of chance p
        has (k + OWN p) / (i + OWN).
        """
        if self.fitted and len(number):
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            order = np.lexsort((number, row))
            new = np.append(True, (np.diff(number[order]) != 0) | (np.diff(row[order]) != 0))
            k = np.empty(len(order))
            k[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            with np.errstate(divide="ignore"):
                word = np.logaddexp(np.log(k), word + math.log(OWN)) - np.log(np.arange(len(order)) - first[row] + OWN)
        return word / math.log(10) + self.on()


def fit(types: DataFrame, pieces: list[bytes], logp: np.ndarray) -> np.ndarray:
    """Log probabilities of the pieces that fit the words of the training rows, each word once.

    One array a task is added up in levels (``summed``); the driver has a number a piece.
    """
    own = PRIOR * np.exp(logp)
    for _ in range(ROUNDS):
        told = types.sparkSession.sparkContext.broadcast((pieces, logp))

        def use(batches):
            lattice = Lattice(*told.value)  # noqa: B023  each round's job ends within it
            used = np.zeros(len(lattice.logp))
            for batch in batches:
                for row in range(batch.num_rows):
                    _, c, at, data = _unblob(batch, row)
                    used += lattice.uses(data, at, c > 0)
            yield dealt(used)

        weight = own + summed(types.mapInArrow(use, "deal int, sums binary"), len(own))
        logp = np.log(weight / weight.sum())
    return logp


def score(docs: DataFrame, held_out: int = 10, path: str | None = None, fitted: bool = False) -> DataFrame:
    """The log10 probability of every whole text, summed over all its segmentations into subwords.

    Method: a public vocabulary's own scores weight its pieces. A forward recursion in log space sums over all
    segmentations of the text; no piece spans two words, so the sum is the product of the words' sums, and a word that
    occurs often is worked out once. After each word the text ends with the ends' share of the training tokens. The
    words' sums are a proper distribution over words, so the scores are log probabilities. The corpus' words are
    counted over all training rows for the base score; counts and sums meet their documents in groups, so no table of
    words is on one machine.

    ``fitted``: the weights are fitted to the training rows' different words (``ROUNDS`` of expectation maximisation; each
    word counts once, since the pieces are there for words that weren't seen), those words become pieces of their own
    (``Model.word``), and a text's words make their repetition in it likelier (``Model.texts``). The scores stay log
    probabilities.

    Learned from: rows whose crc32(doc_id) mod ``held_out`` isn't 0. Returns doc_id, held_out, n_tokens (words and
    one end), n_known (tokens seen in training), train_tokens, base_score (add-0.1 unigrams) and score.

    Defined cases: a null or empty text is its end alone; rows without doc_id are held out; repeated rows are
    counted and scored each; with nothing to learn from, counts are 0 and a text ends with a chance of one half; very
    long words are fitted and scored whole; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    n = buckets(docs)
    source = texts(docs)
    out = F.coalesce(fold("doc_id", held_out) == 0, F.lit(True))
    marked = source.withColumn("train", ~out)
    types = cut(word_types(marked, n))
    pieces, logp = vocabulary(path or model_path())

    def totals(batches):
        total = np.zeros(4)
        for batch in batches:
            for row in range(batch.num_rows):
                c = _unblob(batch, row)[1]
                total += [c.sum(), (c > 0).sum(), (c == 1).sum(), (c == 2).sum()]
        yield dealt(total)

    words, different, once, twice = summed(types.mapInArrow(totals, "deal int, sums binary"), 4)
    ends = marked.filter("train").count()
    model = Model(int(words) + ends, int(different) + (ends > 0), ends, int(once), int(twice), fitted)
    if fitted and different:
        logp = fit(types, pieces, logp)
    told = spark.sparkContext.broadcast((pieces, logp))

    def price(batches):
        lattice = Lattice(*told.value)
        for batch in batches:
            for row in range(batch.num_rows):
                h, c, at, data = _unblob(batch, row)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([h.tobytes()]), pa.array([c.tobytes()]), pa.array([lattice.words(data, at).tobytes()])], names=["bucket", "hash", "n", "lattice"])

    priced = types.mapInArrow(price, "bucket int, hash binary, n binary, lattice binary")
    # by id and text: rows without an id, or of one id, don't meet unless they are copies
    dealt_docs = source.withColumn("deal", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))

    def ask(rows: pa.Table) -> pa.Table:
        found = [x[0] for x in map(_distinct, flushes(rows.to_batches()))]
        unique = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        deal = rows.column("deal")[0].as_py()
        out = [(b, deal, unique[i:j].tobytes()) for b, i, j in _slices(unique, n)]
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "deal": pa.array([x[1] for x in out], pa.int32()), "hash": pa.array([x[2] for x in out], pa.binary())})

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        get = lambda c, t: np.frombuffer(b"".join(known.column(c).to_pylist()), t)
        h, c, lattice = get("hash", np.uint64), get("n", np.int64), get("lattice", np.float64)
        order = np.argsort(h)
        h, c, lattice = h[order], c[order], lattice[order]
        counts, prices = [], []
        for x in asked.column("hash").to_pylist():
            at = np.searchsorted(h, np.frombuffer(x, np.uint64))
            counts.append(c[at].tobytes())
            prices.append(lattice[at].tobytes())
        return pa.table({"deal": asked.column("deal"), "bucket": asked.column("bucket"), "n": pa.array(counts, pa.binary()), "lattice": pa.array(prices, pa.binary())})

    def finish(rows: pa.Table, told_: pa.Table) -> pa.Table:
        told_ = told_.sort_by("bucket")
        c = np.frombuffer(b"".join(told_.column("n").to_pylist()), np.int64)
        lattice = np.frombuffer(b"".join(told_.column("lattice").to_pylist()), np.float64)
        base, own, known = model.base(c), model.word(c, lattice), c > 0
        result = []
        whole: list[Flush] = list(flushes(rows.to_batches()))
        parts = [_distinct(x) for x in whole]
        unique = np.unique(np.concatenate([p[0] for p in parts])) if parts else np.zeros(0, np.uint64)
        for flush, (hashes, _, _, number, first) in zip(whole, parts):
            at = np.searchsorted(unique, hashes)[number] if len(hashes) else number

            def by_row(x: np.ndarray) -> np.ndarray:
                total = np.concatenate([[0], np.cumsum(x, dtype=np.float64)])
                return total[first[1:]] - total[first[:-1]]

            n_words = np.diff(first)
            result.append(pa.table({
                "doc_id": flush.rows.column(flush.rows.schema.get_field_index("doc_id")), "n_tokens": pa.array(n_words + 1, pa.int64()), "n_known": pa.array(np.round(by_row(known[at])).astype(np.int64) + (model.ends > 0)),
                "base_score": pa.array(by_row(base[at]) + model.base(model.ends)), "score": pa.array(by_row(model.texts(own[at], at, first)) + model.end()),
            }))
        return pa.concat_tables(result)

    asked = dealt_docs.groupBy("deal").applyInArrow(ask, "bucket int, deal int, hash binary")
    answers = asked.groupBy("bucket").cogroup(priced.groupBy("bucket")).applyInArrow(answer, "deal int, bucket int, n binary, lattice binary")
    scored = dealt_docs.groupBy("deal").cogroup(answers.groupBy("deal")).applyInArrow(finish, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: how likely every document is."""
    return score(table(spark, sf_dir, "documents"), fitted=True)
