"""Connected components of an edge table, by alternating large and small stars.

Each round reduces by aggregates and joins only (a hub's edges never meet in one task: its minimum is a
map-side aggregate, the join back is one that Spark splits when skewed) and is written to shared storage.
Rounds grow with the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` of every id on an edge; the component is its smallest id."""
    hi, lo = F.greatest(a, b).alias("v"), F.least(a, b).alias("m")
    now = stage(edges.where(F.col(a) != F.col(b)).select(hi, lo).distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or not mark["n"]:
            break
        before = mark
        both = now.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(now.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("t")).select("u", F.least("u", "t").alias("t"))
        large = (both.join(least, "u").where(F.col("w") > F.col("u"))
                 .select(F.col("w").alias("v"), F.col("t").alias("m")).distinct())
        large = stage(large, "large-star")
        root = large.groupBy("v").agg(F.min("m").alias("t"))
        small = (large.join(root, "v").where(F.col("m") != F.col("t")).select(F.col("m").alias("v"), F.col("t").alias("m"))
                 .unionByName(root.select("v", F.col("t").alias("m"))).distinct())
        now = stage(small, "small-star")
    return (now.groupBy("v").agg(F.min("m").alias("component")).select(F.col("v").alias("id"), "component")
            .unionByName(now.select(F.col("m").alias("id"), F.col("m").alias("component")).distinct()))
