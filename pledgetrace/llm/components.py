"""Connected components as Spark joins: each component ends as a star around its least node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

MAX_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges`` that is not the least of its component.

    Alternates two steps until nothing changes: every node hands its larger neighbours its least
    neighbour, then its smaller ones. The edges halve the distance to the least node each round.
    Minima are partial aggregates; the joins are on single nodes, so that a hot one is split."""
    star = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                 .filter("u > v").distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        both = star.select("u", "v").union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stage(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .filter("u > v").distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = stage(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        # a fixed point of both steps is a set of stars; rows and a digest tell whether it moved
        now = tuple(star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return star.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
