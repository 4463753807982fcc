"""Exact nearest vectors of many queries: blocks of queries against all rows, by matrix products.

While the queries' matrix is small it goes to every executor; beyond that, queries are dealt into blocks and
rows meet each block once. Either way a task keeps only its best k for each query before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import top

BROADCAST_NUMBERS = 4_000_000
BLOCK = 1024
SLICE = 20_000
TILE = 1024
METRICS = ("l2sq", "l2", "cosine")


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        norm = np.maximum(np.linalg.norm(q, axis=1), 1e-9)[:, None] * np.maximum(np.linalg.norm(x, axis=1), 1e-9)[None, :]
        return 1 - (q @ x.T) / norm
    d = np.maximum(0, (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * q @ x.T)
    return d if metric == "l2sq" else np.sqrt(d)


def _nearest(q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Places in ids, which ascend, and distances of each query's k nearest; tiles of TILE queries and rows are met one by one."""
    pick, best = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
    for lo in range(0, len(x), TILE):
        d = np.round(_distances(q, x[lo : lo + TILE], metric), 6) + 0.0
        at = np.argsort(d, axis=1, kind="stable")[:, :k]
        pick, best = np.concatenate([pick, at + lo], axis=1), np.concatenate([best, np.take_along_axis(d, at, axis=1)], axis=1)
        # what came before has smaller ids, so that a stable sort keeps ties in their order
        order = np.argsort(best, axis=1, kind="stable")[:, :k]
        pick, best = np.take_along_axis(pick, order, axis=1), np.take_along_axis(best, order, axis=1)
    return pick, best


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, metric: str):
    """Batches of query_id, id and distance: the k nearest rows of each query."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    for lo in range(0, len(q), TILE):
        pick, best = _nearest(q[lo : lo + TILE], ids, x, k, metric)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids[lo : lo + TILE], pick.shape[1])), pa.array(ids[pick.ravel()]), pa.array(best.ravel())], ["query_id", "id", "distance"])


def dense_scores(queries: DataFrame, rows: DataFrame, k: int, metric: str = "l2sq") -> DataFrame:
    """query_id, id and distance: each task's k nearest. queries: query_id, v; rows: id, v."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    out = "query_id long, id long, distance double"
    first = queries.select(F.size("v").alias("d")).first()
    if first is None:
        return queries.sparkSession.createDataFrame([], out)
    rows, n = rows.select(F.col("id").cast("long"), "v").where("v is not null"), queries.count()
    if n * first["d"] <= BROADCAST_NUMBERS:
        asked = queries.orderBy("query_id").collect()
        q_ids, q = np.array([r["query_id"] for r in asked], np.int64), np.array([r["v"] for r in asked], np.float64)

        def run(batches):
            for b in batches:
                if b.num_rows:
                    yield from _best(q_ids, q, b.column("id").to_numpy(), _matrix(b.column("v"), b.num_rows), k, metric)

        return rows.mapInArrow(run, out)
    blocks = -(-n // BLOCK)
    dealt = queries.select("query_id", F.col("v").alias("q")).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    slices = max(1, -(-rows.count() // SLICE))
    spread = rows.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    dealt = dealt.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        a, b = a.combine_chunks(), b.combine_chunks()
        q, x = _matrix(a["q"].combine_chunks(), a.num_rows), _matrix(b["v"].combine_chunks(), b.num_rows)
        return pa.Table.from_batches(_best(a["query_id"].to_numpy(), q, b["id"].to_numpy(), x, k, metric))

    return dealt.groupBy("block", "slice").cogroup(spread.groupBy("block", "slice")).applyInArrow(meet, out)


def dense_topk(queries: DataFrame, rows: DataFrame, k: int, metric: str = "l2sq") -> DataFrame:
    """query_id, rank, id, distance."""
    return top(dense_scores(queries, rows, k, metric), k, "query_id", score="distance", descending=False)


def dense_bundle_topk(queries: DataFrame, rows: DataFrame, k: int, metric: str = "l2sq") -> DataFrame:
    """query_id, rank, id, distance: k rows near any of a query's vectors, each by the nearest of them. queries may have several
    rows of a query_id; each gives its k nearest."""
    asked = queries.select("query_id", "v").withColumn("_one", F.xxhash64("query_id", "v"))
    near = dense_scores(asked.select(F.col("_one").alias("query_id"), "v"), rows, k, metric)
    near = top(near, k, "query_id", score="distance", descending=False).select(F.col("query_id").alias("_one"), "id", "distance")
    best = near.join(asked.select("_one", "query_id").distinct(), "_one").groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    return top(best, k, "query_id", score="distance", descending=False)


def dense_grouped_topk(queries: DataFrame, rows: DataFrame, k: int, group: str, metric: str = "l2sq") -> DataFrame:
    """The k nearest of each query in each group of rows (id, v, group), in one pass over the rows; null is a group.
    A task keeps its best k for each query and group."""
    first = queries.select(F.size("v").alias("d")).first()
    kind = rows.schema[group].dataType.simpleString()
    out = f"query_id long, id long, distance double, `{group}` {kind}"
    if first is None:
        return queries.sparkSession.createDataFrame([], out + ", rank int")
    n = queries.count()
    if n * first["d"] > BROADCAST_NUMBERS:
        raise ValueError("too many queries at once: ask in parts")
    asked = queries.orderBy("query_id").collect()
    q_ids, q = np.array([r["query_id"] for r in asked], np.int64), np.array([r["v"] for r in asked], np.float64)

    def run(batches):
        for b in batches:
            own = b.column(group).dictionary_encode(null_encoding="encode")
            codes = own.indices.to_numpy()
            for g in np.unique(codes):
                part = b.take(pa.array(np.flatnonzero(codes == g)))
                for best in _best(q_ids, q, part.column("id").to_numpy(), _matrix(part.column("v"), part.num_rows), k, metric):
                    label = part.column(group).take(pa.array(np.zeros(best.num_rows, np.int64)))
                    yield pa.RecordBatch.from_arrays([*best.columns, label], [*best.schema.names, group])

    found = rows.select(F.col("id").cast("long"), "v", group).where("v is not null").mapInArrow(run, out)
    return top(found, k, "query_id", group, score="distance", descending=False)


def relevance(distance):
    return 1 / (1 + distance)
