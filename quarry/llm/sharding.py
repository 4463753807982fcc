"""Sharding by a hierarchical weighted hash tree.

Regions hold racks, racks hold shards. A row descends by weighted hash draws: each region has a stream of
arrivals, whose gaps are exponential variates at the rate of its full capacity; an arrival draws one of the
region's racks, one of the rack's shards and a level, and is taken where the shard exists and its weight is above
the level. A region stands with its first arrival that is taken, and the row goes to the shard of the earliest
region. A shard's weight decides about its own arrivals alone, so a change of weight moves rows only into or out
of the subtree where it changes, and a new shard takes rows only into itself. A row costs a few draws for each
region and level, not one for each shard.

Defined results: null text has no bytes; long texts count whole; rows of equal id meet in one shard, null ids too;
an empty table gives none. Slots count from 0 without gaps within a shard, in the order of buckets of rows; rows of
equal id and text differ in nothing, so reruns agree. Columns of docs beside the id and the text are not returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GOLDEN, keep, mix, small

RACK_SHARDS, REGION_RACKS = 5, 4
CAPACITY = 4.0
OVERHEAD = 16
SLOT_ROWS = 100_000


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def first_arrivals(keys: np.ndarray, weights: list[float], capacity: float = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """For each key (unsigned 64-bit) and region, when its first taken arrival comes, and its shard."""
    size = RACK_SHARDS * REGION_RACKS
    regions = -(-len(weights) // size)
    w = np.zeros(regions * size)
    w[: len(weights)] = weights
    if w.max(initial=0.0) > capacity or w.min(initial=0.0) < 0:
        raise ValueError("weights lie between 0 and the capacity of a shard")
    when, shard = np.full((len(keys), regions), np.inf), np.full((len(keys), regions), -1, np.int32)
    for r in range(regions):
        if not w[r * size : (r + 1) * size].any():
            continue
        waiting, time, h = np.arange(len(keys)), np.zeros(len(keys)), mix(keys + np.array([r + 1], np.uint64) * GOLDEN)
        while len(waiting):
            h = mix(h + GOLDEN)
            time = time - np.log(_unit(h)) / (capacity * size)
            rack = (_unit(mix(h ^ np.uint64(1))) * REGION_RACKS).astype(np.int32)
            leaf = (_unit(mix(h ^ np.uint64(2)) + rack.astype(np.uint64)) * RACK_SHARDS).astype(np.int32)
            leaf += rack * RACK_SHARDS + r * size
            taken = _unit(mix(h ^ np.uint64(3))) * capacity < w[leaf]
            when[waiting[taken], r], shard[waiting[taken], r] = time[taken], leaf[taken]
            waiting, time, h = waiting[~taken], time[~taken], h[~taken]
    return when, shard


def draws(key: Column, weights: list[float], seed: int = 0, capacity: float = CAPACITY) -> Column:
    """For each region the time of its first taken arrival and its shard. weights: of the shards, in the order of
    their racks and regions; one without weight never wins, and none may be above the capacity."""

    @F.pandas_udf("array<struct<at: double, shard: int>>")
    def draw(hashed: pd.Series) -> pd.Series:
        when, shard = first_arrivals(hashed.to_numpy(np.int64).view(np.uint64), weights, capacity)
        return pd.Series([[{"at": a, "shard": int(s)} for a, s in zip(x, y, strict=True)] for x, y in zip(when.tolist(), shard.tolist(), strict=True)])

    return draw(F.xxhash64(key, F.lit(seed)))


def descend(drawn: Column, n: int) -> Column:
    """The shard of the earliest of the regions that n shards fill."""
    return F.array_min(F.slice(drawn, 1, -(-n // (RACK_SHARDS * REGION_RACKS))))["shard"]


def place(key: Column, layouts: list[list[float]], seed: int = 0, capacity: float = CAPACITY) -> Column:
    """An array of the shards that a key has under several lists of weights."""

    @F.pandas_udf("array<int>")
    def own(hashed: pd.Series) -> pd.Series:
        keys, found = hashed.to_numpy(np.int64).view(np.uint64), []
        for weights in layouts:
            when, shard = first_arrivals(keys, weights, capacity)
            found.append(shard[np.arange(len(keys)), when.argmin(axis=1)])
        return pd.Series(list(np.stack(found, axis=1)))

    return own(F.xxhash64(key, F.lit(seed)))


def with_slots(rows: DataFrame, shard: str, *order: str, bucket_rows: int = SLOT_ROWS) -> DataFrame:
    """Adds slot. A shard is numbered bucket by bucket, so that no task holds a whole shard; order: columns that
    tell rows apart, as far as they differ, and deal them to buckets. rows: kept, as they are read twice."""
    # buckets of a shard number by the rows that the largest may have, so a hot id is no hot task either
    n = max(1, -(-rows.count() // bucket_rows))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order, F.lit(7)), F.lit(n)))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(shard, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(shard, "_bucket").orderBy(*order)
    return (
        rows.withColumn("_rank", F.row_number().over(within) - 1)
        .join(small(keep(counts)), [shard, "_bucket"])
        .withColumn("slot", (F.col("_from") + F.col("_rank")).cast("long"))
        .drop("_bucket", "_rank", "_from")
    )


def shard_documents(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard of n, and grown_shard, that with one shard more."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        place(F.col(id_col), [[1.0] * n, [1.0] * (n + 1)]).alias("_at"),
    )
    return rows.select("doc_id", "size", "text_crc32", F.col("_at")[0].alias("shard"), F.col("_at")[1].alias("grown_shard"))


def op3_sharding(docs: DataFrame, n: int = 40) -> DataFrame:
    placed = with_slots(keep(shard_documents(docs, n)), "shard", "doc_id", "text_crc32", "size")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
