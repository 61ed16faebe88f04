"""Connected components by alternating large and small stars, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm.common import keep


def connected_components(edges: DataFrame) -> DataFrame:
    """(src long, dst long) to (node, component), component being the smallest node reachable; nodes that are their own component aren't returned.

    Each round links every node to smaller ones (Kiveris et al., 2014); the number of rounds grows with the logarithm of the
    longest path. Rounds are written to the shared folder, so a lost executor repeats one round at most. Nulls and loops link nothing;
    an empty input gives no rows.
    """
    src, dst = F.col("src"), F.col("dst")
    now = keep(edges.where(src != dst).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct(), "edges")
    before = None
    while (mark := _mark(now)) != before and mark[0]:
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = keep(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = keep(small.unionByName(low.withColumnRenamed("m", "v")).where("u <> v").distinct(), "small")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Number and checksum of the edges: equal marks in two rounds mean that stars stand alone."""
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]
