"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.checkpoint import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One round over ``a > b`` links: each node's neighbours are linked to the least of them and itself.

    The large star acts on the neighbours above the node, the small star on those below; both keep
    the components, and a group of n links makes at most n links.
    """
    if large:
        sided = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    else:
        sided = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    least = sided.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root"))
    joined = sided.join(least, "node")
    if large:
        new = joined.where(F.col("other") > F.col("node")).select(F.col("other").alias("a"), F.col("root").alias("b"))
    else:
        new = joined.select(F.col("other").alias("a"), F.col("root").alias("b")).unionAll(least.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return new.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): for every node of ``links`` other than a component's least one, that least node.

    Links are undirected; self links, repeated links and rows with a null end count for nothing.
    """
    now = cut(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    digest = None
    for _ in range(most_rounds):
        now = cut(_star(_star(now, large=True), large=False))
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == digest or seen[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        digest = seen
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
