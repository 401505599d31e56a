"""Connected components by alternating large-star and small-star rounds (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchweave.llm.staging import discard, stage


def _fingerprint(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u long, v long) to ``(node, component)``, component being the smallest node reached.

    Nodes without an edge to another node do not appear; null ends are ignored; repeated edges and self-loops are
    harmless. Every round keeps at most as many edges as came in and ends in a staged table; rounds go on until
    the stars stop changing. Only a count and a checksum reach the driver.
    """
    typed = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    current = stage(typed.where("u is not null and v is not null and u <> v").distinct(), "edges")
    seen = _fingerprint(current)
    while seen[0]:
        following = stage(_small_star(_large_star(current)), "stars")
        state = _fingerprint(following)
        discard(current)
        current = following
        if state == seen:
            break
        seen = state
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(current.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
