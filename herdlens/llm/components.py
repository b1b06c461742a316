"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round rewires every node towards the smallest id it has seen; the edges
become stars around the smallest id of each component. Minima per node are
partial aggregates and each round is stored, so a hub is joined against a
stored table (both join sides have an exchange of their own, which lets AQE
split a hot node) and no lineage builds up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdlens.llm.common import stored


def _turn(e: DataFrame) -> DataFrame:
    return e.select(F.col("v").alias("u"), F.col("u").alias("v"))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(_turn(e))
    low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-low")
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = stored(down.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v; longs) but the roots; root is the smallest id reachable."""

    def tidy(e: DataFrame) -> DataFrame:
        return stored(e.where("u <> v").distinct(), "cc-edges")

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = tidy(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    now = mark(e)
    while now[0]:
        e = tidy(_small_star(tidy(_large_star(e))))
        was, now = now, mark(e)
        if was == now:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
