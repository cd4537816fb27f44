"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apiloom.llm.common import released, written


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b of one orderable type); component is its smallest node.

    Each round moves every neighbour to the smallest node known (large star, then small star, after Kiveris et al.
    2014), which takes a logarithmic number of rounds. Each round's links are written to the shared folder, so
    lineage does not grow and no link reaches the driver. Rows with a null end and self links give no link.
    """
    ends = links.select("a", "b").where("a is not null and b is not null and a <> b")
    edges = written(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        released(before)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
