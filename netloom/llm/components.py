"""Connected components of a link table, by alternating large and small stars.

Each step links every node's neighbours to the smallest of them (first the larger neighbours, then the
smaller ones), until nothing changes; the number of steps grows with the logarithm of the longest path.
Only the smallest neighbour of a node is ever gathered, so a node may have any number of links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netloom.session import cut_lineage


LINKS_OF_A_TASK = 100_000


def _star(links: DataFrame) -> DataFrame:
    """(a, b) with a > b from (u, v) rows: v and u linked to the smallest neighbour of u."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return links.join(least, F.col("u") == F.col("_u"))


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node in ``links`` (a, b); NULLs are no nodes."""
    links = cut_lineage(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
        # a stage's tasks follow the number of links, so that few links are not spread over many tiny files
        tasks = max(1, -(-now[0] // LINKS_OF_A_TASK))
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).coalesce(tasks).distinct()
        down = _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")))
        small = down.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            down.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").coalesce(tasks).distinct()
        links = cut_lineage(small.coalesce(tasks))
    stars = links.groupBy("a").agg(F.min("b").alias("b"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
