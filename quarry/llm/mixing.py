"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sources in the order of their code points (null last) have the weights 5, 2, 1, repeating, and share
`share` of all sizes; a target stops at `most` times its source's size and the excess is shared by
weight among the others until none is above. A source's documents are dealt by hash into blocks. Whole
passes over a source take every block; the part of a pass that is left takes blocks in permuted order,
and within the block where the target falls documents in hashed order, and one more document whose size
comes nearest to what is missing.

Every block that a pass takes is one ticket of its source. The splitting tree halves the output shards
again and again: at each node the tickets, in hashed order, go half to either side, so that the sources'
counts on each side are a multivariate hypergeometric draw and add up exactly. A source's blocks, in
another permuted order, then fill its quotas, disjointly; within a shard documents are ordered by hash.

Only DataFrame operations are used. All draws are hashes of a seed, the source and doc_id, so reruns
agree. Tickets number a few thousand at any size of input. Defined results: null text has size 0; null is
a source; rows that repeat a doc_id are taken alike; long texts are counted and taken whole; a source without words
has target 0; an empty table gives none; columns of docs keep their names and values. Sources are few: a row for each
of them, and for each ticket at the tree's root, is handled by one task, which suits tens of thousands of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free, keep, small

WEIGHTS = (5, 2, 1)
BLOCKS = 4096
SHARDS_LOG2 = 3
BLOCK_DOCS = 64


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources (source, source_size) with target. With caps in the order of cap over weight, the
    first k stop at their caps; k is the least for which the level of the rest is at most the next cap; from there on levels fall."""
    by_name = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    deal = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), deal + 1)
    known = sources.withColumn("_w", weight).withColumn("_cap", most * F.col("source_size").cast("double"))
    known = known.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_ratio", F.col("source").cast("binary"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    known = known.withColumn("_level", level)
    settled = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything)
    target = F.least(F.col("_cap"), F.coalesce(settled, F.lit(float("inf"))) * F.col("_w"))
    return known.withColumn("target", target).select("source", "source_size", "target")


def _hash(*parts: Column | str, seed: int, salt: int) -> Column:
    return F.xxhash64(*parts, F.lit(seed), F.lit(salt))


def split_quotas(tickets: DataFrame, levels: int, seed: int) -> DataFrame:
    """source, shard and quota. tickets: source and the number n of its tickets."""
    one = tickets.select("source", F.explode(F.expr("sequence(1L, n)")).alias("_t")).withColumn("shard", F.lit(0))
    for level in range(levels):
        node = Window.partitionBy("shard")
        turn = F.row_number().over(node.orderBy(_hash("source", "_t", "shard", seed=seed, salt=100 + level), "source", "_t"))
        right = turn > F.floor((F.count(F.lit(1)).over(node) + 1) / 2)
        one = one.withColumn("shard", F.col("shard") * 2 + right.cast("int"))
    return one.groupBy("source", "shard").agg(F.count(F.lit(1)).alias("quota"))


def plan_mix(docs: DataFrame, seed: int = 0, levels: int = SHARDS_LOG2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs, all columns in a struct `row`, with _size, _source_size, _target, _copies (0 to 2) and _shards, that of each copy."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    key = _hash(F.col(id_col), seed=seed, salt=1)
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), size.alias("_size"), key.alias("_key"), F.col(source_col).alias("_source"))
    lean = base.select(F.col("_source").alias("source"), "_key", F.col("_size").alias("size"))
    # one row for each id: repeated rows of an id are taken together
    lean = keep(lean.groupBy("source", "_key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")))
    sources = keep(lean.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("rows").alias("n_rows")))
    total = F.sum("n_rows").over(Window.partitionBy())
    n_blocks = F.greatest(F.lit(1), F.least(F.ceil(F.lit(BLOCKS) * F.col("n_rows") / total), F.ceil(F.col("n_rows") / BLOCK_DOCS))).cast("long")
    size, target = F.col("source_size"), F.col("target")
    shares = keep(
        targets(sources)
        .join(sources.withColumn("n_blocks", n_blocks).select(F.col("source").alias("_s"), "n_blocks"), F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("passes", F.when(size > 0, F.floor(target / size)).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", target - F.col("passes") * size)
    )

    def of_source(rows: DataFrame, *wanted: str) -> DataFrame:
        some = shares.select(F.col("source").alias("_s"), *wanted)
        return rows.join(some, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    def block() -> Column:
        return F.pmod(F.xxhash64("_key", F.lit(2)), F.col("n_blocks"))

    dealt = of_source(lean, "n_blocks", "passes", "rest").withColumn("block", block())
    # blocks of a source in permuted order, with the words before each
    blocks = dealt.groupBy("source", "block", "passes", "rest").agg(F.sum("size").alias("words"))
    permuted = Window.partitionBy("source").orderBy(_hash("source", "block", seed=seed, salt=3), "block")
    blocks = keep(
        blocks.withColumn("place", F.row_number().over(permuted))
        .withColumn("upto", F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("whole", F.col("upto") <= F.col("rest"))
    )
    edge = blocks.where("not whole").groupBy("source").agg(F.min_by(F.struct("block", "place", (F.col("rest") - F.col("upto") + F.col("words")).alias("left")), "place").alias("e"))
    edge = edge.select(F.col("source").alias("_s"), F.col("e.block").alias("edge_block"), F.col("e.left").alias("left"))
    in_edge = dealt.join(edge, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("edge_block"))).drop("_s")
    so_far = Window.partitionBy("source").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    in_edge = in_edge.withColumn("upto", F.sum("size").over(so_far)).withColumn("_in", F.col("upto") <= F.col("left"))
    missing = F.col("left") - F.coalesce(F.max(F.when(F.col("_in"), F.col("upto"))).over(Window.partitionBy("source")), F.lit(0))
    gap = F.abs(F.col("size") - F.col("missing"))
    cut = (
        in_edge.withColumn("missing", missing)
        .groupBy("source", "edge_block")
        .agg(
            F.max(F.when(F.col("_in"), F.col("_key"))).alias("last_key"),
            F.min_by("_key", F.when(~F.col("_in") & (gap < F.col("missing")), F.struct(gap, "_key"))).alias("fill_key"),
        )
    )
    # tickets and where they go
    counts = blocks.groupBy("source").agg(F.sum(F.col("passes") + F.col("whole").cast("long")).alias("n"))
    cuts = keep(cut.select(F.col("source").alias("_s"), "edge_block", "last_key", "fill_key"))
    on = F.col("source").eqNullSafe(F.col("_s"))
    has_edge = (F.col("last_key").isNotNull() | F.col("fill_key").isNotNull()).cast("long")
    tickets = counts.join(cuts, on, "left").select("source", (F.col("n") + has_edge).alias("n")).where("n > 0")
    quotas = split_quotas(tickets, levels, seed)
    upto = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ranges = quotas.withColumn("_to", F.sum("quota").over(upto)).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("_to", "shard"))).alias("ranges"))
    copies = F.col("passes") + F.when(F.col("whole") | ((F.col("block") == F.col("edge_block")) & (has_edge == 1)), 1).otherwise(0)
    dealing = Window.partitionBy("source").orderBy(_hash("source", "block", "_pass", seed=seed, salt=4), "block", "_pass")
    one = (
        blocks.join(cuts, on, "left")
        .withColumn("_most", copies)
        .where("_most > 0")
        .select("source", "block", F.explode(F.expr("sequence(1L, _most)")).alias("_pass"))
        .withColumn("_nth", F.row_number().over(dealing))
        .join(ranges.select(F.col("source").alias("_s"), "ranges"), on)
        .withColumn("shard", F.element_at(F.filter("ranges", lambda x: x["_to"] >= F.col("_nth")), 1)["shard"])
        .groupBy("source", "block")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_pass", "shard"))), lambda x: x["shard"]).alias("shards"))
    )
    chosen = keep(
        blocks.join(one.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "shards"), on & (F.col("block") == F.col("_b")), "left")
        .drop("_s", "_b")
        .join(cuts, on, "left")
        .select("source", "block", "passes", "whole", "shards", (F.col("block") == F.col("edge_block")).alias("is_edge"), "last_key", "fill_key")
    )
    # each row decides for itself from its block's row
    # a row for each source, and one for each block; beyond that many sources, joins that split a hot one
    some = small(shares).select(F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "n_blocks")
    rows = base.join(some, F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_block", block())
    chosen = small(chosen).select(F.col("source").alias("_c"), F.col("block").alias("_b"), "passes", "whole", "shards", "is_edge", "last_key", "fill_key")
    rows = rows.join(chosen, F.col("_s").eqNullSafe(F.col("_c")) & (F.col("_block") == F.col("_b")))
    more = F.col("whole") | (F.coalesce("is_edge", F.lit(False)) & F.coalesce((F.col("_key") <= F.col("last_key")) | (F.col("_key") == F.col("fill_key")), F.col("_key") == F.col("fill_key"), F.lit(False)))
    rows = rows.withColumn("_copies", (F.col("passes") + more.cast("long")).cast("long"))
    shards = F.slice(F.coalesce("shards", F.array().cast("array<int>")), F.lit(1), F.col("_copies").cast("int"))
    return rows.withColumn("_shards", shards).select("row", "_size", "_source_size", "_target", "_copies", "_shards")


def mix_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows that the mix takes, repeats too, with docs' columns: by shard, shuffled within each."""
    planned = plan_mix(docs, seed)
    turn = F.posexplode("_shards").alias("_copy", "_shard")
    taken = planned.select("row", turn).withColumn("_order", _hash("row.doc_id", "_copy", "_shard", seed=seed, salt=5))
    return taken.repartition("_shard", F.pmod("_order", F.lit(32))).sortWithinPartitions("_shard", "_order").select("row.*")


def op8_mixing(docs: DataFrame) -> DataFrame:
    planned = plan_mix(docs.select("doc_id", "text", "source"))
    return planned.select(
        "row.doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"),
        F.col("_copies").alias("copies"),
        F.col("_shards").alias("shards"),
    )
