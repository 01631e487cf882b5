"""Connected components of an undirected graph given by its links.

Large-star and small-star steps in turn: every step replaces a node's links by
links to its smallest neighbour, which keeps components whole and makes each of
them a star around its smallest node. The minimum of a node is combined before
it is shuffled, and written before it is joined back, so that a node with very
many links is a skewed join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from murmuration.llm.common import stored


def _towards_smallest(pairs: DataFrame) -> DataFrame:
    smallest = stored(pairs.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "smallest")
    return pairs.join(smallest, "u")


def _distinct(u: Column, v: Column, rows: DataFrame) -> DataFrame:
    return rows.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct()


def large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    rows = _towards_smallest(both).filter("v > u")
    return _distinct(F.col("v"), F.col("m"), rows)


def small_star(links: DataFrame) -> DataFrame:
    rows = _towards_smallest(links)
    ends = rows.select(F.explode(F.array("u", "v")).alias("n"), "m")
    return _distinct(F.col("n"), F.col("m"), ends)


def components(links: DataFrame) -> DataFrame:
    """(node, component): every node that has a link, and the smallest node of
    its component. ``links`` has two bigint columns, in any order and repeated."""
    a, b = (F.col(c).cast("long") for c in links.columns)
    now = stored(_distinct(a, b, links), "links")
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count(F.lit(1))
    before = now.agg(*digest).first()
    while before[1]:
        now = stored(small_star(stored(large_star(now), "links")), "links")
        after = now.agg(*digest).first()
        if after == before:
            break
        before = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
