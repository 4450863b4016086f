"""Connected components of an edge table by alternating stars, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, keep


def components(edges: DataFrame, folder: str, most: int = 60) -> DataFrame:
    """node, root (the least node of its component) for every node of edges (a, b) that has an edge to another node.

    Each round links all neighbours of a node to the least of them (large star, then small star); stars are what
    remains when nothing changes.  Minima are aggregated before they are shuffled, so a node with many edges is no
    burden to one task.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    e, last, state = keep(e, f"{folder}/edges-0"), f"{folder}/edges-0", None
    for i in range(1, most):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = keep(small.select("e.*").where("a != b").distinct(), f"{folder}/edges-{i}")
        now = tuple(new.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        drop(spark, last)
        e, last = new, f"{folder}/edges-{i}"
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
