"""Connected components of a graph by alternating large-star and small-star rounds, each written to the shared folder.

Edges with a null end are ignored, as are loops and repeated edges; without edges there are no rows. No neighbourhood is gathered:
least neighbours are aggregates with partial sums, joined back to the edges. The edges of one node meet in one task of that join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import forget, written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node but the smallest of its component, from edges (a long, b long) in any direction."""

    def tidy(e: DataFrame) -> DataFrame:
        return written(e.where("a <> b").groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(F.lit(1).alias("one")).drop("one"), name)

    e, before = tidy(edges), None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = e.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = written(large, name)
        forget(e)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = tidy(small.unionAll(least.select("a", F.col("m").alias("b"))))
        forget(large)
