"""Windows that don't overlap, by doubled pointers: the same as going through each host in order."""

import math
import random

import pytest
from pyspark.sql import functions as F

from logsift.operators import chains, rollups


def fold(times, window):
    out = []
    for t in sorted(times):
        if not out or t > out[-1] + window:
            out.append(t)
    return out


def _starts(spark, by_host):
    return spark.createDataFrame([(h, t) for h, ts in by_host.items() for t in set(ts)], "host string, at long").repartition(5)


@pytest.mark.parametrize("seed, window", [(1, 10), (2, 1), (3, 60)])
def test_same_as_a_fold(spark, seed, window):
    rng = random.Random(seed)
    hosts = {f"h{i}": [rng.randrange(-500, rng.choice([0, 600, 5000])) for _ in range(rng.choice([1, 5, 60]))] for i in range(25)}
    hosts["edges"] = [k * window for k in range(40)] + [k * (window + 1) + 7000 for k in range(40)] + [9000, 9000 + 2 * window, 9000 + 2 * window + 1]
    got = sorted(map(tuple, chains.chosen_starts(_starts(spark, hosts), window).collect()))
    assert got == sorted((h, t) for h, ts in hosts.items() for t in fold(ts, window))


def test_one_host_with_an_unbroken_series(spark, monkeypatch):
    rounds = []
    real = chains.cut
    monkeypatch.setattr(chains, "cut", lambda df: rounds.append(1) or real(df))
    hosts = {"hot": list(range(0, 3000, 3)), **{f"h{i}": [i, i + 5] for i in range(900)}}
    got = sorted(map(tuple, chains.chosen_starts(_starts(spark, hosts), 10).collect()))
    assert got == sorted((h, t) for h, ts in hosts.items() for t in fold(ts, 10))
    assert len([1 for h, _ in got if h == "hot"]) == 250
    assert len(rounds) <= 2 + 3 * (math.ceil(math.log2(250)) + 1)
    assert chains.chosen_starts(_starts(spark, {"h": []}), 10).count() == 0


def test_no_plan_orders_a_host_by_itself(spark):
    df = spark.range(200).select((F.col("id") + 1).alias("row_num"), F.lit("one").alias("host"))
    matches = df.select("row_num", F.concat(F.lit("t"), F.col("row_num") % 4).alias("tactic_id"), F.lit("n").alias("tactic_name"), F.lit("x").alias("technique_id"), F.lit("y").alias("technique_name"), F.lit("k").alias("keyword"), F.lit("c").alias("column_name"), F.lit(50).alias("score"), F.lit("keyword").alias("source"))
    times = df.select("row_num", (F.col("row_num") * 1000).alias("epoch_ms"), F.lit("").alias("utc_text"))
    capped = chains.attack_chains(matches, df, times, "host", window_ms=10_000, cap=120)
    assert capped.agg(F.sum("event_count")).first()[0] == 119 // 11 * 11 + 10 and capped.count() == 11
    # a story of timed chains: each event with its chain, once
    found = chains.attack_chains(matches, df, times, "host", window_ms=10_000)
    story = rollups.attack_story(found, matches, df, "host", times, most=None)
    told = story.filter("seq > 0").groupBy("chain_id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))
    assert told.join(found, "chain_id").filter("n <> event_count or n <> last").count() == 0 and told.count() == found.count()
    assert "chain_id" in story.columns and story.count() == 200 + found.count() - (200 - found.agg(F.sum("event_count")).first()[0])
