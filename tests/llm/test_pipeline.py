import collections

import corpus_pipeline as pipeline
from logsift.llm.packing import encoder, ranks_path
from tests.llm.cases import EDGE, edge, words
from tests.llm.test_decontaminate import WORD
from tests.llm.test_decontaminate import plain as hits
from tests.llm.test_repeats import plain as repeats
from tests.llm.test_near_groups import plain as groups


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_each_stage_is_brute_force_and_the_last_holds_the_rest(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [k for k, _ in pipeline.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]

    kept = pipeline.language_id(spark, docs, small)
    assert kept.columns == docs.columns
    assert rows(kept) == rows(docs)  # all documents here are clean prose or junk of some language

    first = rows(pipeline.near_dedup(spark, kept, small))
    texts = {d: r["text"] for d, r in rows(kept).items()}
    assert set(first) == {d for d, c in groups(texts).items() if d == c}

    before = {d: r["text"] for d, r in first.items()}
    dedup = pipeline.near_dedup(spark, kept, small)
    cut = rows(pipeline.cut_repeats(spark, dedup, small))
    expected = {d: [x for x, g in zip(w, gone) if not g] for d, (w, gone, _) in repeats(before, 13).items()}
    assert {d: words(r["text"]) for d, r in cut.items()} == {d: w for d, w in expected.items() if w or not words(before[d])}
    assert all(r["text"] == before[d] for d, r in cut.items() if len(words(r["text"])) == len(words(before[d])))

    cut_frame = spark.createDataFrame(list(cut.values()), docs.schema)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = rows(pipeline.cut_benchmark(spark, cut_frame, small))
    for d, n, n_hit, _ in hits([(d, r["text"]) for d, r in cut.items()], items):
        assert (d in clean) == (n_hit == 0 or n_hit < n)
        if d in clean:
            assert len(WORD.findall(clean[d]["text"].lower())) == n - n_hit
            assert n_hit or clean[d] == cut[d]

    packed = pipeline.packing(spark, spark.createDataFrame(list(clean.values()), docs.schema), small).collect()
    sizes = collections.Counter()
    for r in packed:
        sizes[r["doc_id"]] += r["length"]
    encode = encoder(ranks_path()).encode_ordinary
    assert sizes == {d: len(encode(r["text"])) + 1 for d, r in clean.items()}

    whole = pipeline.run(spark, small).collect()
    assert sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in whole) == sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packed)


def test_stages_stand_edge_rows(spark, small):
    from pyspark.sql import functions as F

    docs = edge(spark).select("doc_id", "text", F.when(F.col("doc_id") % 2 == 1, "aa").alias("lang"), "source", "n_chars")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, small)
        left = {r["doc_id"] for r in out.select("doc_id").collect()}
        ids = {d for d, _ in EDGE}
        assert left == {"language_id": ids - {2, 3, 4, 10, 12}, "simhash_near_dedup": ids - {1, 3, 4, 6, 7, 9}, "substring_dedup": ids - {7, 9}, "benchmark_decontamination": ids, "best_fit_packing": ids}[name]
        assert stage(spark, docs.limit(0), small).count() == 0
        if name != "best_fit_packing":
            assert out.columns == docs.columns
