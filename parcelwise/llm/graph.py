"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum("v")).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of the undirected edges ``(u, v)``; a component is named by its smallest node.

    Alternates large-star and small-star steps until the edges are stars, each round written to shared storage. A step
    is a minimum by node, which is combined before the shuffle, and a join that adaptive execution splits where a node
    has many edges. Null ends, loops and repeated edges are ignored; an empty table has no components.
    """
    ends = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state = _state(ends := written(ends, "edges"))
    while state[0]:
        both = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        ends = written(moved.unionByName(low.withColumnRenamed("m", "v")).distinct(), "edges")
        before, state = state, _state(ends)
        if state == before:
            break
    return ends.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        ends.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
