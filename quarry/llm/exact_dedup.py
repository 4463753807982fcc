"""Exact dedup with a minimal perfect hash over digests seen before.

Texts are equal when they are identical after each run of white space became one space. History is
the distinct digests that recur. It is cut into shards of a bounded number of digests; each shard is
a minimal perfect hash whose slots hold the full digest, the winner's id and the group's size. A row
looks its digest up in its shard and compares all 32 bytes, so a digest that is not a member is never
taken for one; nonmembers are grouped among themselves.

Defined results: null text counts as empty; the winner is the smallest id, null ids come last; rows
that repeat an id together with its text are all kept, or all dropped, as they have the winner's id; where no row of a
group has an id, all are kept, though the SQL says null for that; long texts are digested whole; an empty table gives
none; columns beside the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, SPACE, keep, mix

SHARD_DIGESTS = 50_000
SLICE_ROWS = 200_000
LEVEL_FACTOR = 2.0
BROADCAST_SHARDS = 100_000

INDEX = "shard long, levels array<binary>, digests binary, winners array<long>, sizes array<long>"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and digest, the SHA-256 of the normalised text, of each row."""
    normal = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(normal, 256)).alias("digest"))


def _halves(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = np.ascontiguousarray(found).view("<u8").reshape(len(found), 4)
    return words[:, 0] ^ words[:, 2], words[:, 1] ^ words[:, 3]


def build_mph(found: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of bits for distinct digests (rows of 32 bytes), and each digest's slot.

    At each level a key hashes to one bit. The bits that one key alone hits are set, and those keys
    are placed; the rest go on to the next level. A key's slot is the rank of its bit over all levels.
    """
    a, b = _halves(found)
    slot, rest, levels, base = np.full(len(found), -1, np.int64), np.arange(len(found)), [], 0
    while len(rest):
        m = max(8, int(LEVEL_FACTOR * len(rest)) + 7 & ~7)
        at = (mix(a[rest] + np.uint64(len(levels)) * (b[rest] | np.uint64(1))) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m) == 1
        placed = alone[at]
        rank = np.cumsum(alone) - 1
        slot[rest[placed]] = base + rank[at[placed]]
        base += int(alone.sum())
        levels.append(alone)
        rest = rest[~placed]
    return levels, slot


def find_slots(levels: list[np.ndarray], asked: np.ndarray) -> np.ndarray:
    """The slot that each digest would have; -1 where no level has its bit."""
    a, b = _halves(asked)
    slot, rest, base = np.full(len(asked), -1, np.int64), np.arange(len(asked)), 0
    for i, bits in enumerate(levels):
        if not len(rest):
            break
        at = (mix(a[rest] + np.uint64(i) * (b[rest] | np.uint64(1))) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[at]
        slot[rest[hit]] = base + (np.cumsum(bits) - 1)[at[hit]]
        base += int(bits.sum())
        rest = rest[~hit]
    return slot


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _build(found: pa.Table) -> pa.Table:
    keys = _matrix(found["digest"])
    levels, slot = build_mph(keys)
    order = np.empty(len(keys), np.int64)
    order[slot] = np.arange(len(keys))
    return pa.table(
        {
            "shard": pa.array([found["shard"][0].as_py()], pa.int64()),
            "levels": pa.array([[np.packbits(x).tobytes() for x in levels]], pa.list_(pa.binary())),
            "digests": pa.array([keys[order].tobytes()], pa.binary()),
            "winners": pa.array([found["winner"].to_numpy()[order]], pa.list_(pa.int64())),
            "sizes": pa.array([found["size"].to_numpy()[order]], pa.list_(pa.int64())),
        }
    )


def _look_up(rows: pa.Table, index: pa.Table) -> pa.Table:
    n = rows.num_rows
    winner, size, member = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    if n and index.num_rows:
        row = index.slice(0, 1)
        levels = [np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for x in row["levels"][0].as_py()]
        slots = np.frombuffer(row["digests"][0].as_py(), np.uint8).reshape(-1, 32)
        asked = _matrix(rows["digest"])
        slot = find_slots(levels, asked)
        at = np.maximum(slot, 0)
        member = (slot >= 0) & (slots[at] == asked).all(axis=1)
        winner = np.asarray(row["winners"][0].values)[at]
        size = np.asarray(row["sizes"][0].values)[at]
    return pa.table({"id": rows["id"], "digest": rows["digest"], "winner": pa.array(winner, mask=~member), "size": pa.array(size, mask=~member), "member": pa.array(member)})


def recurring(found: DataFrame) -> DataFrame:
    """History of one table: digest, winner and size of each digest that two rows or more have."""
    return found.groupBy("digest").agg(F.min("id").alias("winner"), F.count(F.lit(1)).alias("size")).where("size > 1 and winner is not null")


def build_index(history: DataFrame, n_shards: int) -> DataFrame:
    """A row for each shard. history: distinct digest (32 bytes), winner, size."""
    return history.withColumn("shard", _shard(n_shards)).groupBy("shard").applyInArrow(_build, INDEX)


def _shard(n: int):
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history: DataFrame | None = None) -> DataFrame:
    """id, digest, winner, size and member of each row of docs; member: history has the digest.

    history: what an earlier run left, as recurring() returns it; none: that of docs itself. With a
    history from elsewhere its winners stand, and its sizes don't count the rows of docs.
    """
    found = keep(digests(docs, id_col, text_col))
    history = keep(recurring(found) if history is None else history.select("digest", "winner", "size"))
    n_shards = max(1, -(-history.count() // SHARD_DIGESTS))
    index = build_index(history, n_shards)
    rows = found.withColumn("shard", _shard(n_shards))
    # a digest that a third of all rows have makes one shard's rows many: they are dealt in slices
    slices = rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("long").alias("slices"))
    slices = F.broadcast(slices) if n_shards <= BROADCAST_SHARDS else slices  # a row of two numbers for each shard
    rows = rows.join(slices, "shard").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")))
    index = index.join(slices, "shard").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    looked = keep(
        rows.select("shard", "slice", "id", "digest")
        .groupBy("shard", "slice")
        .cogroup(index.select("shard", "slice", "levels", "digests", "winners", "sizes").groupBy("shard", "slice"))
        .applyInArrow(_look_up, "id long, digest binary, winner long, size long, member boolean")
    )
    new = looked.where("not member").select("id", "digest")
    groups = new.groupBy("digest").agg(F.min("id").alias("winner"), F.count(F.lit(1)).alias("size"))
    return looked.where("member").unionByName(new.join(groups, "digest").withColumn("member", F.lit(False)))


def op2_exact_dedup(docs: DataFrame) -> DataFrame:
    done = exact_dedup(docs)
    return done.select(
        F.col("id").alias("doc_id"),
        F.col("winner").alias("keep_id"),
        F.col("size").alias("group_size"),
        F.coalesce(F.col("id") == F.col("winner"), F.col("winner").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = r"""
with n as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, text_sha256
from n window w as (partition by text_sha256)
"""
