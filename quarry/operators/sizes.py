"""Broadcasts behind a check of size, and small tables that are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 100_000


def small(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows; else as it is, for Spark to choose a join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


PUSHED_IDS = 2_000


def held(df: DataFrame) -> DataFrame:
    """df, computed once: in the checkpoint folder where the session has one, else on the executors."""
    context = df.sparkSession.sparkContext
    return df.localCheckpoint() if context.getCheckpointDir() is None else df.checkpoint()


def of_ids(rows: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """rows whose id is among those of ids: while these are few they reach the scan as a filter, so that no other row's texts move."""
    few = [r[id_col] for r in ids.select(id_col).distinct().limit(PUSHED_IDS + 1).collect()]
    return rows.where(F.col(id_col).isin(few)) if len(few) <= PUSHED_IDS else rows.join(ids.select(id_col), id_col, "left_semi")
