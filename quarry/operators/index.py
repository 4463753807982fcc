"""Index upkeep: which files to build anew, merged manifests, and tables without deleted files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rebuild_plan(manifest: DataFrame, snapshot: DataFrame) -> DataFrame:
    """relative_path and kind: reuse, new, modified or deleted. Both have size, mtime and sha256. Equal size
    and time need no look at the content; equal content is reused as well."""
    m = manifest.select("relative_path", *[F.col(c).alias(f"m_{c}") for c in ("size", "mtime", "sha256")])
    rows = snapshot.join(m, "relative_path", "full_outer")
    same = (F.col("size") == F.col("m_size")) & (F.abs(F.col("mtime") - F.col("m_mtime")) < 1e-6)
    kind = F.when(F.col("size").isNull(), "deleted").when(F.col("m_size").isNull(), "new").when(same | (F.col("sha256") == F.col("m_sha256")), "reuse").otherwise("modified")
    return rows.select("relative_path", kind.alias("kind"))


def index_mode(plan: DataFrame, allow_append: bool = True) -> DataFrame:
    """One row: reuse without changes; append if files are only new; else full."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    counts = plan.agg(*[n(k).alias(k) for k in ("reuse", "new", "modified", "deleted")])
    full = (F.col("deleted") > 0) | (F.col("modified") > 0) | F.lit(not allow_append)
    return counts.withColumn("mode", F.when(F.col("new") + F.col("modified") + F.col("deleted") == 0, "reuse").when(full, "full").otherwise("append"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new, and of old the rows whose key new doesn't have."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def drop_deleted(rows: DataFrame, files: DataFrame, key: str = "relative_path") -> DataFrame:
    return rows.join(files.select(key), key, "left_semi")


def file_key(path):
    """The name of a file's cache."""
    return F.substring(F.sha1(path.cast("binary")), 1, 20)
