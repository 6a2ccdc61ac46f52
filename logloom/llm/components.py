"""Connected components of a link table, by alternating star contraction.

Each round hangs every node under the smallest node it can see, first its larger neighbours
(large star), then its smaller ones (small star). Rounds are joins and combinable `min`
aggregations; the links of a round are written to the shared folder, and the loop ends when a
round changes nothing (same count, same sum of hashes). A round reads only the one before it, so
older ones are deleted. No component is ever gathered, and joins never broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.plans.staging import discard, stage


def sorted_side(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: by sort-merge it never passes through the driver."""
    return side.hint("merge")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(sorted_side(least), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(sorted_side(least), "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """Columns a, b (long) to node, label: the smallest node of its component, for linked nodes."""
    def signature(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    links = stage(links.filter("a <> b").distinct(), "links")
    before = signature(links)
    while before[0]:
        last, links = links, stage(_small_star(_large_star(links)), "links")
        after = signature(links)
        discard(last)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
