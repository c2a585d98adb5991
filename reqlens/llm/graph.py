"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqlens.llm.util import stored


def components(links: DataFrame, folder: str, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable over the links, for every node
    that has one. Each round attaches a node's larger neighbours to its smallest
    one (large star), then a node and its smaller neighbours (small star), until
    nothing changes; the rounds are few, as paths shorten by half. A node with
    very many links is only aggregated (combined map-side) and joined, both of
    which Spark can split. Self links and nulls are ignored."""
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                   .where("u is not null and v is not null and u <> v").distinct(), folder, "edges-0")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v")
        if large:
            both = both.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(low, "u")
        if large:
            moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return moved.where("u <> v").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before, k = state(edges), 0
    while True:
        k += 1
        edges = stored(star(star(edges, True), False), folder, f"edges-{k}")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")) \
        .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
