"""Structured Streaming forms of the append logs, episodes and expiry. Extensions: batch operators define the results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.memory import EPISODE_TURNS


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Starts the log's writer: records as JSON lines, each once."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, key: str, width: str, late: str) -> DataFrame:
    """Counts by window and key; rows later than the watermark are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), key).count()


def inactive_sessions(stream: DataFrame, at: str, key: str, gap: str, late: str) -> DataFrame:
    """Sessions that a gap of inactivity ends: what has expired."""
    found = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).count()
    return found.select(key, F.col("w.start").alias("created"), F.col("w.end").alias("expires"), F.col("count").alias("n"))


def closed_episodes(stream: DataFrame, key: str = "conv_id") -> DataFrame:
    """Of each session, every EPISODE_TURNS turns as they arrive: key, episode, n_turns."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, episode = state.get if state.exists else (0, 0)
        held += sum(map(len, batches))
        closed = held // EPISODE_TURNS
        state.update((held % EPISODE_TURNS, episode + closed))
        yield pd.DataFrame({key: [k[0]] * closed, "episode": range(episode, episode + closed), "n_turns": [EPISODE_TURNS] * closed})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} long, episode int, n_turns int", "held int, episode int", "append", "NoTimeout")
