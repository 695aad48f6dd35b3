"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import cut


def _large(links: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least node it knows."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small(links: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node that each linked node can reach; nodes without a link are absent.

    ``links`` has one row a link, in either order; nulls and loops are dropped, repeats don't matter and
    an empty table gives an empty result. Every round is written to the checkpoint folder; a round is
    two aggregates and two joins over the links, and there are about as many rounds as the logarithm of the
    largest component. Hot nodes are reduced by partial aggregates; joins on them can be split.
    """
    now = cut(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))

    def told(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    # all stars point from a larger node to a smaller one from the first round on
    was = None
    while True:
        now = cut(_small(_large(now)))
        state = told(now)
        if state == was:
            break
        was = state
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
