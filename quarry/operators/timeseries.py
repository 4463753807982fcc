"""Channels of time series: figures of each, trend labels and one-line summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def channel_stats(points: DataFrame, series: str, channel: str, at: str, value: str) -> DataFrame:
    """Of each channel with two points or more: count, first, last, delta, mean, and the extremes with the
    earliest time of each."""
    v, t = F.col(value), F.col(at)
    found = points.where(v.isNotNull()).groupBy(series, channel).agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(v, t).alias("first"),
        F.max_by(v, t).alias("last"),
        F.avg(v).alias("mean"),
        F.max(v).alias("high"),
        F.min(F.struct((-v).alias("v"), t.alias("t")))["t"].alias("high_at"),
        F.min(v).alias("low"),
        F.min(F.struct(v.alias("v"), t.alias("t")))["t"].alias("low_at"),
    )
    return found.where("n >= 2").withColumn("delta", F.col("last") - F.col("first"))


def trend(delta: Column, start: Column) -> Column:
    flat = F.abs(delta) <= F.greatest(F.lit(1e-6), 0.03 * F.abs(start))
    return F.when(flat, "flat").when(delta > 0, "up").otherwise("down")


def summaries(stats: DataFrame, series: str, channel: str, k: int = 3) -> DataFrame:
    """A line for each series about its first k channels."""
    rows = stats.withColumn("_n", F.row_number().over(Window.partitionBy(series).orderBy(channel))).where(F.col("_n") <= k)
    part = F.format_string("%s: %.3f -> %.3f (%+.3f, %s)", F.col(channel), F.col("first"), F.col("last"), F.col("delta"), trend(F.col("delta"), F.col("first")))
    lines = F.array_sort(F.collect_list(F.struct("_n", part.alias("p"))))
    return rows.groupBy(series).agg(F.array_join(F.transform(lines, lambda x: x["p"]), "; ").alias("summary"))


def channel_names(points: Column, given: Column) -> Column:
    """Given names, else the keys of the points' values in the order of their first use."""
    own = F.array_distinct(F.filter(F.transform(F.flatten(F.transform(points, lambda p: F.map_keys(p["values"]))), lambda x: F.trim(x)), lambda x: x != ""))
    return F.when(given.isNotNull(), F.filter(F.transform(given, lambda x: F.trim(x)), lambda x: x != "")).otherwise(own)
