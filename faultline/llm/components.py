"""Connected components of a distributed edge list by alternating large-star and small-star contraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch, saved


def _lowest(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with the least of u and its neighbours as m; aggregation is partial before the shuffle."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _lowest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    with_m = _lowest(down)
    return with_m.select(F.col("v").alias("u"), F.col("m").alias("v")).union(with_m.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, rounds: int = 60, save: Callable = saved) -> DataFrame:
    """(node, label) of every node of `edges` (columns a, b of one integer type); label is the least node reachable.

    Each round writes its edges to the shared folder, so lineage stays short and no state is held in executors; only the
    result's table stays.  An empty table gives an empty result; a node that meets only itself is left out.
    """
    with Scratch(edges.sparkSession) as scratch:
        now = scratch.saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
        mark = None
        for _ in range(rounds):
            now = scratch.saved(_small_star(_large_star(now)).filter("u <> v").distinct(), "edges")
            found = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
            if found == mark:
                break
            mark = found
        else:
            raise RuntimeError(f"components have not settled in {rounds} rounds")
        roots = now.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
        return save(now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots), "labels")
