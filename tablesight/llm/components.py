"""Connected components of a link table, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesight.session import scratch_table



def _least_neighbour(links: DataFrame) -> DataFrame:
    """Per node u its least neighbour; partial sums absorb hot nodes."""
    return links.groupBy("u").agg(F.min("v").alias("least"))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b of one orderable
    type); root is the least node of the component.

    Large-star hangs a node's larger neighbours under its least one, small-star
    its smaller ones; the edge table shrinks to stars in a logarithmic number of
    rounds.  Each round is written to the shared folder, so no lineage builds up.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = scratch_table(edges.filter("u <> v").distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mins = _least_neighbour(both).select("u", F.least("u", "least").alias("least"))
        large = (both.join(mins, "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("least").alias("v")).distinct())
        mins = _least_neighbour(large)
        small = (large.join(mins, "u")
                 .select(F.explode(F.array(
                     F.struct(F.col("u"), F.col("least").alias("v")),
                     F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("e"))
                 .select("e.u", "e.v").filter("u <> v").distinct())
        edges = scratch_table(small, "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = tuple(state)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
