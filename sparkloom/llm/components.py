"""Connected components of a distributed edge list by alternating large and small stars.

Each round sends every vertex's larger neighbours to its smallest neighbour, then the rest. Edges stay a
DataFrame; a round is written to the shared folder, so lineage stays short and lost executors cost one round at most.
A hub's edges are dealt by joins that adaptive execution can split; no vertex's neighbours are gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root): for each vertex of ``edges`` the smallest vertex it is connected with. Loops and repeats do no harm."""
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = scratch.keep(now, "cc0")
    mark, k = _mark(now), 0
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        large = scratch.keep(large, f"cc{k}l")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).distinct()
        now = scratch.keep(small, f"cc{k + 1}")
        new = _mark(now)
        scratch.drop(f"cc{k}", f"cc{k}l")
        k += 1
        if new == mark:
            break
        mark = new
    # Every vertex but a root now has one edge, to its root.
    found = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return found.union(found.select(F.col("root").alias("id"), "root").distinct())


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return r[0], r[1]
