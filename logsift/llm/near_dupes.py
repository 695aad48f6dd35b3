"""Groups of near copies: SimHash covering tables and MinHash bands bring documents together, exact sets link them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import LOWER, MULT, buckets, cut, few, flushes, give_back, grams, mix, ranges, texts, word_spans
from logsift.llm.components import components
from logsift.llm.simhash import covering_masks

#: A pair of similarity s agrees in some band with a chance of 1 - (1 - s**ROWS)**BANDS: 0.986 at 0.8, 0.998 at 0.85.
BANDS, ROWS = 14, 6
#: Fingerprints of the shingle sets that differ in this many bits or fewer meet in a covering table.
RADIUS = 2
#: Up to so many sets, of so many bytes together, are compared with one another in one place.
MOST, MOST_BYTES = 2048, 8 << 20
#: Common elements are told by so many sets, and so many of them are known to the tasks; both only decide how fast it goes.
SAMPLE, HOT = 4096, 1 << 17
_CHUNK = 4096


def sets(flush, word: np.ndarray, first: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingle hashes of all rows, sorted within each row, and each row's first (and one past).

    A row of fewer words than ``shingle`` has one shingle of all its words.
    """
    h, ok = grams(word, shingle, first)
    count = np.diff(first)
    for r in np.flatnonzero((count > 0) & (count < shingle)):
        a, b = first[r], first[r + 1]
        acc = np.array([b - a], np.uint64)
        for x in word[a:b]:
            acc = mix(acc * MULT + x)
        h[a], ok[a] = acc[0], True
    h, row = h[ok], np.repeat(np.arange(flush.n), count)[ok]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[fresh], np.searchsorted(row[fresh], np.arange(flush.n + 1))


def _names(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's set; that of the empty set is 0."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ MULT), dtype=np.uint64)])
    n = np.diff(first).astype(np.uint64)
    return np.where(n > 0, mix(sums[first[1:]] - sums[first[:-1]] + n * MULT), np.uint64(0))


def _simhash(h: np.ndarray) -> np.uint64:
    """Bits that over half of the hashes have."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 255):  # bytes of a word count up to 255 without a carry
        bits = np.unpackbits(h[i : i + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
        total += bits.sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(total * 2 > len(h), bitorder="little").view(np.uint64)[0]


def _keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of keys for each row's set: ``BANDS`` of ``ROWS`` least hashes each, and those of the covering tables."""
    masks = np.array(covering_masks(RADIUS), np.uint64)
    out = np.zeros((len(at) - 1, BANDS + len(masks)), np.uint64)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    head = at[:-1][full]
    for band in range(BANDS):
        acc = np.full(len(full), band + 1, np.uint64)
        for row in range(ROWS):
            a, b = mix(np.array([band * ROWS + row + 1, 1000 + band * ROWS + row], np.uint64) * MULT)
            acc = mix(acc * MULT + np.minimum.reduceat((h ^ a) * (b | np.uint64(1)), head))
        out[full, band] = acc
    prints = np.array([_simhash(h[at[r] : at[r + 1]]) for r in full], np.uint64)
    for i, mask in enumerate(masks):
        out[full, BANDS + i] = mix((prints & mask) ^ mix(np.array([BANDS + i + 1], np.uint64)))
    return out


def _signed(shingle: int):
    """Of each row the name of its set, the set's bytes when it is sent, and its keys; an empty set has none."""

    def scan(batches):
        for flush in flushes(batches, most=2 << 20):
            starts, ends, first = word_spans(flush)
            h, at = sets(flush, ranges(LOWER[flush.bytes], starts, ends), first, shingle)
            keys = _keys(h, at)
            sizes = np.where(np.diff(at) > 0, keys.shape[1], 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(keys[sizes > 0].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([flush.rows.column(0), flush.rows.column(2), pa.array(_names(h, at).view(np.int64)), pa.array(4 * np.diff(at)), lists], names=["doc_id", "text_hash", "sig", "size", "keys"])

    return scan


def _sent(shingle: int):
    """Each wanted set as sorted 32-bit hashes, once for every place where it is compared."""

    def scan(batches):
        for flush in flushes(batches, most=1 << 20):
            starts, ends, first = word_spans(flush)
            h, at = sets(flush, ranges(LOWER[flush.bytes], starts, ends), first, shingle)
            held = pa.array([np.unique((h[a:b] >> np.uint64(32)).astype(np.uint32)).tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
            places = flush.rows.column(flush.rows.schema.get_field_index("places"))
            row = np.repeat(np.arange(flush.n), np.diff(np.asarray(places.offsets)))
            place = places.flatten()
            for i in range(0, len(row), 4096):
                k = pa.array(row[i : i + 4096])
                here = place.slice(i, 4096)
                yield pa.RecordBatch.from_arrays([here.field("bucket"), here.field("place"), flush.rows.column(flush.rows.schema.get_field_index("sig")).take(k), held.take(k)], names=["bucket", "place", "sig", "held"])
        give_back()

    return scan


def _elements(shingle: int):
    """The 32-bit hashes of all rows' sets, as they are compared."""

    def scan(batches):
        for flush in flushes(batches, most=1 << 20):
            starts, ends, first = word_spans(flush)
            h, at = sets(flush, ranges(LOWER[flush.bytes], starts, ends), first, shingle)
            for a, b in zip(at[:-1], at[1:]):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique((h[a:b] >> np.uint64(32)).astype(np.int64)))], names=["element"])

    return scan


def _prefixes(shingle: int, least: float, hot: np.ndarray, often: np.ndarray):
    """Each set's rarest elements, so many that two sets of similarity ``least`` share one of them: an entry each.

    Of n elements they are all but those that the similarity asks for, and one more. Any order of the elements will
    do, if it is the same for all sets; with the rare ones first, few sets meet.
    """

    def scan(batches):
        for flush in flushes(batches, most=1 << 20):
            starts, ends, first = word_spans(flush)
            h, at = sets(flush, ranges(LOWER[flush.bytes], starts, ends), first, shingle)
            chosen = []
            for a, b in zip(at[:-1], at[1:]):
                x = np.unique((h[a:b] >> np.uint64(32)).astype(np.int64))
                k = np.minimum(np.searchsorted(hot, x), len(hot) - 1)
                weight = np.where(hot[k] == x, often[k], 0) if len(hot) else np.zeros(len(x), np.int64)
                chosen.append(x[np.lexsort((x, weight))[: len(x) - int(np.ceil(least * len(x) - 0.01)) + 1]])
            row = np.repeat(np.arange(flush.n), [len(x) for x in chosen])
            element = np.concatenate(chosen).astype(np.uint64)
            key = mix(flush.longs("cluster").view(np.uint64)[row] ^ mix(element + MULT))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(flush.longs("sig")[row]), pa.array(flush.longs("part_of")[row])], names=["key", "sig", "part_of"])
        give_back()

    return scan


def linked(held: list[np.ndarray], least: float) -> np.ndarray:
    """Number of the first set that each one reaches by links of Jaccard similarity ``least`` or more.

    Common elements are counted by products of 0/1 matrices over the elements that several sets have.
    """
    m = len(held)
    size = np.array([len(x) for x in held])
    row = np.repeat(np.arange(m), size)
    _, which, count = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
    several = count[which] > 1
    number = np.cumsum(count > 1) - 1
    row, column = row[several], number[which[several]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((m, m), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, _CHUNK):
        a, b = np.searchsorted(column, [low, low + _CHUNK])
        part = np.zeros((m, _CHUNK if m > 8 else min(_CHUNK, int(column[b - 1]) - low + 1)), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        common += part @ part.T
    near = common >= least * (size[:, None] + size[None] - common) - 1e-3
    root = np.arange(m)
    while True:
        now = np.where(near, root[None], m).min(axis=1)
        now = np.minimum(now, root)
        now = now[now]
        if (now == root).all():
            return root
        root = now


def _compare(least: float):
    """Links (a, b) of each place's sets to the first one that they reach."""

    def reduce(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("place", "ascending"), ("sig", "ascending")]).combine_chunks()
        place, sig = (rows.column(c).to_numpy() for c in ("place", "sig"))
        once = np.append(True, (place[1:] != place[:-1]) | (sig[1:] != sig[:-1])) if len(place) else np.zeros(0, bool)
        rows = rows.filter(pa.array(once))  # a repeated row sends its set again
        place, sig, held = place[once], sig[once], rows.column("held").combine_chunks()
        edge = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
        a, b = [], []
        for low, high in zip(edge.tolist(), np.append(edge[1:], len(place)).tolist()):
            if high - low > 1:
                root = linked([np.frombuffer(x.as_buffer(), np.uint32) for x in held.slice(low, high - low)], least)
                k = np.flatnonzero(root != np.arange(high - low))
                a.append(sig[low + k])
                b.append(sig[low + root[k]])
        give_back()
        join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
        return pa.table({"a": join(a), "b": join(b)})

    return reduce


def _freed(df: DataFrame) -> DataFrame:
    """``df``, after Spark was let know what is no longer referenced, so that it removes the files of earlier exchanges."""
    df.sparkSession._jvm.System.gc()
    return df


def _links(source: DataFrame, places: DataFrame, shingle: int, least: float) -> DataFrame:
    """Links (a, b) between the sets that share a place. ``places``: doc_id, text_hash, sig and the set's places."""
    found = source.join(few(places), ["doc_id", "text_hash"]).select("text", "sig", "places")
    sent = _freed(found).mapInArrow(_sent(shingle), "bucket int, place long, sig long, held binary")
    return cut(sent.groupBy("bucket").applyInArrow(_compare(least), "a long, b long"))


def _remaining(source: DataFrame, large: DataFrame, groups: DataFrame, n: int, shingle: int, least: float, most: int, most_bytes: int) -> DataFrame | None:
    """Places where the sets of a large cluster meet that its keys left in different groups, or None if there are none.

    No pair that can be a link is left out: sets of similarity ``least`` share one of their rarest elements (``_prefixes``).
    What shares one, in different groups, is joined to smaller clusters. Where such a one is still over the bounds, it is
    dealt out in parts, and so is what isn't of its largest group; each of these meets each of those in a place of its own.
    """
    rest = large.join(groups, F.col("sig") == F.col("node"), "left").select("first.doc_id", "first.text_hash", "sig", "size", "cluster", F.coalesce("component", "sig").alias("part_of"))
    several = rest.groupBy("cluster").agg(F.min("part_of").alias("low"), F.max("part_of").alias("high")).filter("low <> high").select("cluster")
    rest = cut(rest.join(several, "cluster"))
    total = rest.count()
    if not total:
        return None
    id_ = ["doc_id", "text_hash"]
    sample = rest.filter(F.pmod(F.xxhash64("sig"), F.lit(max(1, total // SAMPLE))) == 0).select(*id_)
    counts = source.join(few(cut(sample)), id_).select("text").mapInArrow(_elements(shingle), "element long").groupBy("element").count()
    hot = counts.filter("count > 2").orderBy(F.desc("count"), "element").limit(HOT).toArrow().sort_by("element")
    scan = _prefixes(shingle, least, hot["element"].to_numpy(), hot["count"].to_numpy())
    entries = cut(source.join(few(rest), id_).select("text", "sig", "cluster", "part_of").mapInArrow(scan, "key long, sig long, part_of long"))
    keys = entries.groupBy("key").agg(F.min("sig").alias("leader"), F.min("part_of").alias("low"), F.max("part_of").alias("high")).filter("low <> high")
    nearer = components(entries.select("key", "sig").join(keys.select("key", "leader"), "key").select("sig", "leader"), "sig", "leader")
    inside = cut(rest.join(nearer, F.col("sig") == F.col("node")).select(*id_, "sig", "size", "part_of", F.col("component").alias("nearer")))
    shares = inside.groupBy("nearer", "part_of").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    shares = shares.groupBy("nearer").agg(F.max(F.struct("n", "bytes", "part_of")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    once = (F.col("n") <= most) & (F.col("bytes") <= most_bytes)
    parts = lambda count, size: F.when(once, 1).otherwise(F.greatest(F.ceil(2 * count / most), F.ceil(2 * size / most_bytes))).cast("int")
    shares = shares.select("nearer", once.alias("once"), F.col("main.part_of").alias("main"), parts(F.col("n"), F.col("bytes")).alias("all"), parts(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")).alias("others"))
    inside = inside.join(shares, "nearer")
    mine = lambda of: F.pmod(F.xxhash64("sig"), F.col(of)).cast("int")
    row = F.transform(F.sequence(F.lit(0), F.col("all") - 1), lambda j: F.xxhash64("nearer", mine("others"), j))
    column = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda i: F.xxhash64("nearer", i, mine("all")))
    met = F.array_distinct(F.when(F.col("part_of") == F.col("main"), column).otherwise(F.concat(row, column)))
    # places of parts are groups of their own, so that no task holds several
    bucket = lambda x: F.when(F.col("once"), F.pmod(F.xxhash64(x), F.lit(n))).otherwise(n + F.pmod(F.xxhash64(x), F.lit(1 << 30))).cast("int")
    return cut(inside.select(*id_, "sig", F.transform(met, lambda x: F.struct(bucket(x).alias("bucket"), x.alias("place"))).alias("places")))


def near_groups(docs: DataFrame, least: float = 0.8, shingle: int = 5, most: int = MOST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, text_hash, copies, component_id, kept): groups of documents by links of similarity ``least`` or more.

    Method: documents with one set of ``shingle``-word shingles are one node. A node has a SimHash fingerprint, whose
    covering tables bring all within ``RADIUS`` bits together, and MinHash bands, which follow the Jaccard
    similarity, so that an edit in one stretch costs no more than scattered ones. Whatever shares a key is joined to
    clusters of candidates by the least node of each key: an entry a key and no pairs. Then every candidate's set is sent
    once to its cluster's task, where all are compared exactly. In clusters over ``most`` sets or ``most_bytes`` it is
    sent once for each of its keys instead, and sets that share a key are compared, keys of more than ``most`` sets or their
    bytes in parts that each have the key's least node; then those of their sets that are in different groups are compared
    as far as they can be alike (``_remaining``). So all pairs of a cluster are settled, whatever its size: the bounds
    decide where sets are compared, not which. A pair is a link only if its sets have a Jaccard similarity of ``least`` or
    more; components of the links are the groups.

    Sets are sent as 32-bit hashes: of n shingles one is taken for another with a chance of about n²/2³³ a pair, which
    moves the similarity by 1/n.

    ``text_hash`` tells apart different texts of one doc_id; ``kept`` marks the least (doc_id, text_hash) of its group.

    Defined cases: white space splits words, A-Z are folded; a text of fewer words than ``shingle`` is one shingle;
    null and empty texts are one group; rows without doc_id are left out; rows that repeat a doc_id and its text
    give one row that counts its copies; an empty table gives an empty result; other columns are ignored.
    """
    n = buckets(docs)
    source = texts(docs).filter("doc_id is not null").withColumn("text_hash", F.xxhash64("text"))
    marked = source.mapInArrow(_signed(shingle), "doc_id long, text_hash long, sig long, size long, keys array<long>")
    marked = cut(marked.groupBy("doc_id", "text_hash").agg(F.min("sig").alias("sig"), F.min("size").alias("size"), F.min("keys").alias("keys"), F.count(F.lit(1)).alias("copies")))
    nodes = cut(marked.groupBy("sig").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.min("size").alias("size"), F.min("keys").alias("keys")))
    # what shares a key: the least node of each key, and how many there are
    entries = nodes.select("sig", "size", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.min("sig").alias("leader"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).filter("n > 1")
    shared = cut(entries.drop("size").join(shared, "key"))
    clusters = components(shared.filter("sig <> leader").select("sig", "leader").distinct(), "sig", "leader")
    members = nodes.join(clusters, F.col("sig") == F.col("node")).select("sig", "first", "size", F.col("component").alias("cluster"))
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    members = cut(members.join(sizes.select("cluster", ((F.col("n") > most) | (F.col("bytes") > most_bytes)).alias("large")), "cluster"))
    bucket = lambda *of: F.pmod(F.xxhash64(*of), F.lit(n)).cast("int").alias("bucket")
    own = members.filter("not large").select("sig", F.array(F.struct(bucket("cluster"), F.col("cluster").alias("place"))).alias("places"))
    parts = F.greatest(F.ceil(F.col("n") / most), F.ceil(F.col("bytes") / most_bytes)).cast("int")
    part = F.when(F.col("sig") == F.col("leader"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("sig"), parts).cast("int")))
    spread = shared.join(members.filter("large").select("sig"), "sig").withColumn("part", F.explode(part)).withColumn("place", F.xxhash64("key", "part"))
    spread = spread.select("sig", F.struct(bucket("place"), "place").alias("at")).groupBy("sig").agg(F.collect_list("at").alias("places"))
    places = cut(members.join(own.unionByName(spread), "sig").select(F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), "sig", "places"))
    links = _links(source, places, shingle, least)
    groups = components(_freed(links), "a", "b")
    large = members.filter("large")
    more = None if large.isEmpty() else _remaining(source, large, groups, n, shingle, least, most, most_bytes)
    if more is not None:
        groups = components(links.union(_links(source, more, shingle, least)), "a", "b")
    named = nodes.select("sig", "first").join(groups, F.col("sig") == F.col("node"), "left").select("sig", F.coalesce("component", "sig").alias("component"), "first")
    winner = named.groupBy("component").agg(F.min("first").alias("least"))
    told = named.join(winner, "component").select("sig", "least")
    kept = (F.col("doc_id") == F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    return marked.select("doc_id", "text_hash", "sig", "copies").join(told, "sig").select("doc_id", "text_hash", "copies", F.col("least.doc_id").alias("component_id"), kept.alias("kept"))
