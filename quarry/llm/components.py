"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_alone


def components(links: DataFrame) -> DataFrame:
    """id and component, the least id that links (a, b) lead to, of each id in a link.

    Alternates large-star and small-star: every neighbour above a node is linked to the least of the
    node's neighbourhood, then every neighbour below and the node itself. A round has three shuffles: the links of
    a node meet in one task, which sorts them and spills beyond its memory. Ends when no link changes, after
    about as many rounds as the logarithm of the longest path.
    """
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    each = lambda e, *pairs: e.select(F.inline(F.array(*pairs)))
    least = F.min("b").over(Window.partitionBy("a"))
    edges = keep_alone(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        near = each(edges, pair("a", "b"), pair("b", "a")).withColumn("m", F.least("a", least))
        large = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = each(large.withColumn("m", least), pair("b", "m"), pair("a", "m"))
        edges = keep_alone(small.where("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
