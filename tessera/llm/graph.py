"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Workspace, cut


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable) for every node of edges (a, b)."""
    with Workspace(edges.sparkSession, "components") as work:
        stars = star_forest(edges, work, most_rounds)
        return cut(stars.union(stars.select(F.col("component").alias("node"), "component").distinct()))


def star_forest(edges: DataFrame, work: Workspace, most_rounds: int = 60) -> DataFrame:
    """node, component for every node of edges (a, b) that isn't the least of its component.

    Rounds of large-star and small-star hooking until no node is both an end and a centre.
    Aggregates combine before they shuffle; the tables joined are written first, so that the join can split a
    hub's rows over tasks, and each is deleted once its successor exists.
    """
    links = work.put(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    for _ in range(most_rounds):
        # A forest of stars: every v has one u, and no v is a u.
        ends = links.select(F.col("v").alias("node"), F.lit(1).alias("is_end"), F.lit(0).alias("is_centre")).union(links.select("u", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("is_end").alias("n"), F.max("is_centre").alias("c")).where("n > 1 OR (n = 1 AND c = 1)").isEmpty():
            return links.select(F.col("v").alias("node"), F.col("u").alias("component"))
        both = links.select("v", "u").union(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = work.put(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m")))
        large = work.put(both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct())
        work.drop(links, least)
        least = work.put(large.groupBy("v").agg(F.min("u").alias("m")))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).union(least.select("v", F.col("m").alias("u"))).where("v <> u")
        links = work.put(small.select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).distinct())
        work.drop(large, least)
    raise RuntimeError("components did not settle")
