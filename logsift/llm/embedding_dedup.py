"""Embedding near-dedup with a pivot-permutation index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm.common import buckets, cut, few, mix, table
from logsift.llm.components import components


def choose_pivots(reps: DataFrame, n: int, candidates: int, apart: float) -> dict[int, np.ndarray]:
    """At most ``n`` reference vectors a dimension from a hash sample of ``candidates`` vectors, no two of them alike.

    Leader selection: a candidate is taken unless its cosine to a pivot is over ``apart``, so a large group of
    near copies gives one pivot.
    """
    rows = reps.orderBy(F.xxhash64("rep", F.lit(9)), "rep").select("vector").limit(candidates).collect()
    by_size: dict[int, list[np.ndarray]] = {}
    for (v,) in rows:
        v = unit(np.asarray([v], np.float64))[0]
        own = by_size.setdefault(len(v), [])
        if len(own) < n and (not own or float((np.stack(own) @ v).max()) <= apart):
            own.append(v)
    return {k: np.stack(v) for k, v in by_size.items()}


def _keys(order: np.ndarray, label: np.ndarray, size: int) -> np.ndarray:
    """A key for each pair of a vector's nearest pivots, with its label and length: two vectors have a key in common if they share two pivots."""
    near = np.sort(order, axis=1).astype(np.uint64)
    i, j = np.triu_indices(near.shape[1], 1)
    pair = near[:, i] << np.uint64(32) | near[:, j]
    return mix(pair ^ mix(mix(label.astype(np.int64).view(np.uint64)) + np.uint64(size))[:, None])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; the largest component is brought to 1 first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _index(told, near: int, n: int):
    """Post every vector under its keys; blobs of about one group for each bucket."""

    def scan(batches):
        pivots = told.value
        for batch in batches:
            rep, label, copies = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 3))
            vectors = batch.column(2)
            flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)
            sizes = np.diff(np.asarray(vectors.offsets))
            ends = np.cumsum(sizes)
            for size in np.unique(sizes).tolist():
                k = np.flatnonzero(sizes == size)
                x = flat[(ends[k] - size)[:, None] + np.arange(size)]
                x = unit(x)
                far = pivots.get(size)
                if far is None:  # no candidate had this many components: one list for all of them
                    key = np.broadcast_to(mix(label[k].view(np.uint64) + np.uint64(size)), (1, len(k))).T
                else:
                    m = min(near, len(far))
                    order = np.argpartition(-(x @ far.T), m - 1, axis=1)[:, :m] if m < len(far) else np.tile(np.arange(m), (len(k), 1))
                    key = _keys(order, label[k], size) if m > 1 else mix(label[k].view(np.uint64) + np.uint64(size))[:, None]
                width = key.shape[1]
                flat_key = key.reshape(-1)
                to = ((flat_key >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)
                row = np.repeat(np.arange(len(k)), width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to), pa.array(flat_key.view(np.int64)), pa.array(rep[k][row]), pa.array(copies[k][row]), vectors.take(pa.array(k[row])), pa.FixedSizeListArray.from_arrays(pa.array(key[row].reshape(-1).view(np.int64)), width).cast(pa.list_(pa.int64()))],
                    names=["bucket", "key", "rep", "copies", "vector", "keys"],
                )

    return scan


_BLOCK = 1024


#: Lists of more vectors than this are cut into parts of about as many, and each pair of parts goes to a task of its own.
LIST = 4096


def _split(index: DataFrame, n: int, most: int) -> DataFrame:
    """Add pair and part: which two parts of a long list a row meets in (0 in short lists), and its own part."""
    long = cut(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("key", F.ceil(F.col("n") / most).cast("int").alias("parts")))
    told = index.join(few(long), "key", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"), F.lit(0)))
    with_ = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    pair = F.transform(with_, lambda x: F.shiftleft(F.least(x, F.col("part")).cast("long"), 32) + F.greatest(x, F.col("part")))
    rows = told.withColumn("pair", F.explode(pair))
    return rows.withColumn("bucket", F.when(F.col("parts").isNull(), F.col("bucket")).otherwise(F.pmod(F.xxhash64("key", "pair"), F.lit(n)).cast("int"))).drop("parts")


def _compare(threshold: float):
    """Verify all pairs of a list that have it as their least shared key, in blocks; count links and join classes.

    A pair is counted in one list only, and in one pair of a long list's parts. Lists are compared block by block and only a forest of their links is
    given out, so what leaves grows with the list, not with its pairs.
    """

    def reduce(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by([("key", "ascending"), ("pair", "ascending"), ("rep", "ascending")])
        key, rep, copies, pair, part = (rows.column(c).to_numpy() for c in ("key", "rep", "copies", "pair", "part"))
        vectors, keys = (rows.column(c).combine_chunks() for c in ("vector", "keys"))
        vectors, keys = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (vectors, keys))
        flat, at = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64), np.asarray(vectors.offsets) - vectors.offsets[0].as_py()
        kflat, kat = keys.flatten().to_numpy(zero_copy_only=False), np.asarray(keys.offsets) - keys.offsets[0].as_py()
        degree = np.zeros(len(key), np.int64)
        root = np.arange(len(key))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1]))) if len(key) else np.zeros(0, np.int64)
        for a, b in zip(head, np.append(head[1:], len(key))):
            if b - a < 2:
                continue
            x = unit(flat[at[a] : at[b]].reshape(b - a, -1))
            own = kflat[kat[a] : kat[b]].reshape(b - a, -1)
            smaller = np.where(own < key[a], own, np.iinfo(np.int64).max)
            for i in range(0, b - a, _BLOCK):
                for j in range(i, b - a, _BLOCK):
                    p, q = np.nonzero(x[i : i + _BLOCK] @ x[j : j + _BLOCK].T >= threshold)
                    p, q = p + i, q + j
                    # within one part in its own task only
                    k = (p < q) & ((part[a + p] != part[a + q]) | (pair[a] >> 32 == pair[a] & 0xFFFFFFFF))
                    p, q = p[k], q[k]
                    for c in range(0, len(p), 1 << 16):
                        s, t = p[c : c + (1 << 16)], q[c : c + (1 << 16)]
                        # a smaller shared key would have counted the pair already
                        fresh = ~((smaller[s][:, :, None] == smaller[t][:, None, :]) & (smaller[s] < np.iinfo(np.int64).max)[:, :, None]).any((1, 2))
                        s, t = s[fresh] + a, t[fresh] + a
                        np.add.at(degree, s, copies[t])
                        np.add.at(degree, t, copies[s])
                        while len(s) and ((r := root[root[a:b]]) != root[a:b]).any():
                            root[a:b] = r
                        apart = root[s] != root[t]  # the rest is joined already
                        for u, v in zip(s[apart].tolist(), t[apart].tolist()):
                            u, v = find(u), find(v)
                            if u != v:
                                root[max(u, v)] = min(u, v)
        linked = np.flatnonzero(degree)
        least = np.array([find(x) for x in linked.tolist()], np.int64)
        return pa.Table.from_arrays([pa.array(rep[linked]), pa.array(degree[linked]), pa.array(rep[least] if len(least) else np.zeros(0, np.int64))], names=["rep", "links", "other"])

    return reduce


def embedding_dedup(rows: DataFrame, threshold: float = 0.93, near: int | None = None, pivots: int | None = None, candidates: int = 4096, apart: float = 0.8, most: int = LIST) -> DataFrame:
    """Link vectors of one label whose cosine is ``threshold`` or more; their number of links and components.

    Method: equal vectors of a label are one class. A bounded hash sample of ``candidates`` classes gives the
    pivots (about the square root of the number of classes, 64 to 2048). Each class is described by its ``near``
    nearest pivots (by default 5 of 64, 6 of 256, 7 of 1024 and 8 of 2048, as more pivots lie between two near
    vectors) and posted in the inverted list of every pair of them; classes that share two pivots or more meet in a
    list and their cosine is verified in double precision. Every vector is indexed. Lists of more than ``most`` are
    cut into parts, and the pairs of parts are compared in tasks of their own. The lists are approximate in what they
    bring together, never in what they link: recall is measured in the tests.

    Returns vec_id, n_links (other vectors linked directly, copies included), component_id (the smallest vec_id
    reachable by links, itself included) and kept (it is that one).

    Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those without
    label or vec_id, link with nothing; vectors of different length aren't compared; repeated rows count as
    vectors; an empty table gives an empty result; other columns are ignored.
    """
    spark = rows.sparkSession
    kind = "array<float>" if dict(rows.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(kind).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    marked = rows.withColumn("class", F.when(usable, F.sha2(F.to_json(F.struct("label", "vector")).cast("binary"), 256)))
    classes = cut(marked.filter("class is not null").groupBy("class").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector")).select("class", "rep", "label", "vector", "copies"))
    count = classes.count()
    n = pivots or int(min(2048, max(64, 2 ** round(np.log2(max(count, 1)) / 2))))
    told = spark.sparkContext.broadcast(choose_pivots(classes, n, candidates, apart))
    near = near or max(5, round(np.log2(n) / 2) + 2)
    deal = buckets(rows)
    posted = classes.drop("class")
    index = posted.mapInArrow(_index(told, near, deal), f"bucket int, key long, rep long, copies long, vector {kind}, keys array<long>")
    found = cut(_split(index, deal, most).groupBy("bucket").applyInArrow(_compare(threshold), "rep long, links long, other long"))
    groups = components(found, "rep", "other")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.select("class", "rep", "copies").join(links, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left").select("class", "rep", "copies", "links", "component")
    out = marked.select("vec_id", "class").join(known, "class", "left")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: links and components of all embeddings."""
    return embedding_dedup(table(spark, sf_dir, "embeddings"))
