"""Connected components by alternating large-star and small-star steps (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.session import checkpoint_dir


def _pointed(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m): m is the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").withColumn("m", F.least("m", "u"))


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of longs -> (u, root): the least node that each node with an edge can reach; roots are left out.

    Each round is a few grouped minima and joins over what is left of the edges, written to the shared checkpoint folder.
    Rounds grow with the logarithm of the longest path. Nothing but a count and a sum reaches the driver.
    """
    checkpoint_dir(edges.sparkSession)
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    seen = None
    while True:
        said = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if said == seen or said[0] == 0:
            return now.select("u", F.col("v").alias("root"))
        seen = said
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _pointed(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _pointed(large)
        now = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct().checkpoint()
