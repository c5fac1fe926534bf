"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import discard, materialise


def _linked_to_least(edges: DataFrame, larger: bool) -> DataFrame:
    """Each node's neighbours (larger ones, or smaller ones and itself) joined to its least neighbour."""
    if larger:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with an edge to another; root is the least node of its component.

    Rounds grow with the logarithm of a component's longest path. Each round is written to the shared
    folder; only a count and a checksum come to the driver. No edges: no rows.
    """
    def written(frame: DataFrame) -> tuple[DataFrame, tuple]:
        frame = materialise(frame)
        return frame, tuple(frame.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    stars, sign = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    while sign[0]:
        before, read = sign, stars
        stars, sign = written(_linked_to_least(_linked_to_least(stars, True).where("u <> v"), False))
        discard(read)
        if sign == before:
            break
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
