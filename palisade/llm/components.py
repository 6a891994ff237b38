"""Connected components of an edge table with joins only; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node of its component) for every node of ``edges`` (u, v of one type that has an order).

    Alternating large-star and small-star steps: each round hangs the larger neighbours of a node, then its
    smaller ones, below the smallest.  The rounds grow with the logarithm of the longest chain.  Each round's
    edges are written to the shared folder, and ``common.drop_table`` deletes the last ones; a hub's edges are not gathered: its smallest neighbour is found by partial
    aggregation and brought to them by ``attach``.
    """
    current = common.write_table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = common.attach(both.where("v > u"), least, "u", 2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = common.write_table(large.distinct(), "stars")
        small = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        hung = common.attach(large, small, "u", state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        following = common.write_table(hung.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _state(following)
        common.drop_table(current)
        common.drop_table(large)
        current = following
        if after == state:
            break
        state = after
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = roots.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
    out._palisade_path = current._palisade_path
    return out
