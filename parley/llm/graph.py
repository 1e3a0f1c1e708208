"""Connected components of an edge table, by alternating large and small stars (Kiveris et al., 2014). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm._store import drop_table, materialise


#: Edges up to which one task may take them all.
SMALL = 200_000


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (bigint). Returns node, component (the smallest node it reaches), one row per node that has an edge to another.

    Each round cuts lineage at a table in the shared folder. Rounds go with the logarithm of the longest path.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark, small = None, now.limit(SMALL + 1).count() <= SMALL
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # as a table of its own, its join with a hub's many edges can be split
        least = least if small else materialise(least, "edges-least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        low = low if small else materialise(low, "edges-low")
        next_ = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        old, now = now, materialise(next_.where("a <> b").distinct(), "edges")
        drop_table(old)
        got = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).collect()[0]
        if (got["n"], got["x"]) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = (got["n"], got["x"])
