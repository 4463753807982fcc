"""Helpers that the operators share: tables, durable intermediate results, Arrow buffers."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of its own only in local mode without a setting."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quarry-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def keep(df: DataFrame) -> DataFrame:
    """Computes df once into the checkpoint folder, so that a lost executor costs a reread. Spark
    deletes the files of results that nothing refers to any more where the session has
    spark.cleaner.referenceTracking.cleanCheckpoints; otherwise the folder is to be emptied between runs."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep_alone(df: DataFrame) -> DataFrame:
    """keep(df), whose shuffle files go as soon as the result is written, not when the driver happens to collect its garbage:
    many small steps leave more of them than data. Spark before 4.1 doesn't know the setting and leaves them."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return keep(df.select("*"))  # planned anew, as a plan takes the setting when it is made
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own, beginning with underscores, that none of df's begin with."""
    taken = [c.lower() for c in df.columns]
    lead = "_"
    while any(c.startswith(lead) for c in taken):
        lead += "_"
    return [lead + n for n in names]


BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its rows, which are of a few numbers, are at most BROADCAST_ROWS. df: kept."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


BATCH_ROWS = 1000


def tidy(spark: SparkSession | None = None) -> None:
    """Gives free memory back to the system; with a session, that of the driver's JVM and the executors' too."""
    if spark is not None:
        cores = spark.sparkContext.defaultParallelism
        # a task for each core, so that each executor gets some
        spark.range(0, cores, 1, cores).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()
        spark.sparkContext._jvm.System.gc()
        trim_jvm(spark)
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        getattr(ctypes.CDLL(None), "malloc_trim", int)(0)


def trim_jvm(spark: SparkSession) -> None:
    """Has malloc give back what the driver's JVM has freed outside its heap: the compiler's and the collector's memory stays in
    the arenas of hundreds of threads. JVMs without the command (it came with Java 17.0.9, for Linux) go on as they are."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    # by the interface, as the class of the server isn't exported
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    args = gateway.new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        pass


def releasing(run):
    """run, a function from batches to batches, which at a partition's end gives free memory back to the
    system: Python workers wait for more work, and what they hold counts for their executor."""

    def released(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return released


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows, where the session has Spark's default of ten times as many: texts
    can be long, and a batch is held several times over on its way to Python and back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, str(BATCH_ROWS))


def short_plans(spark: SparkSession) -> None:
    """Descriptions of plans of at most 100,000 characters, where the session has Spark's default, which has no bound: the
    driver keeps those of a thousand queries, and a literal map fills some MB of each."""
    key = "spark.sql.maxPlanStringLength"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, "100000")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, dtype=np.int64, count=column.offset + n + 1)[column.offset :] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, size: int = 1 << 19):
    """Ranges of rows of about so many bytes together, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield lo, hi
        lo = hi


M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
_BASE = 0xD6E8FEB86659FD93


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), _BASE, np.uint64)]))


def hash_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, prefixes: tuple[int, ...] = ()):
    """A 64-bit hash of each word of the rows of a block, and where each row's words begin.

    inside: which of the 256 byte values belong to words. Words end at row ends too. With prefixes, a
    list follows: for each length, hashes of the first so many bytes of words, 0 for shorter words.
    """
    at = offsets - offsets[0]
    n = int(at[-1])
    word = inside[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edge = at[:-1][at[:-1] < n]
    first[edge] |= word[edge]
    place = np.flatnonzero(word)
    if not len(place):
        none = np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        return (*none, [none[0] for _ in prefixes]) if prefixes else none
    begin = np.flatnonzero(first[place])
    start = place[begin]
    length = np.diff(np.append(begin, len(place)))
    within = np.arange(len(place)) - np.repeat(begin, length)
    part = _BYTE[data[place]] * _powers(int(length.max()))[within]
    h = mix(np.add.reduceat(part, begin) ^ (length.astype(np.uint64) * GOLDEN))
    row = np.searchsorted(start, at)
    if not prefixes:
        return h, row
    cut = [np.where(length >= k, mix(np.add.reduceat(part * (within < k), begin) ^ np.uint64(k)), np.uint64(0)) for k in prefixes]
    return h, row, cut


def fold_case(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z, and of the letters that UTF-8 writes as C3 80 to C3 9E."""
    low = data + np.uint8(32) * ((data >= 65) & (data <= 90))
    if len(data) > 1:
        low[1:] += np.uint8(32) * ((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97))
    return low


def labelled(labels: DataFrame, mark: str, folds: int, held: int, bound: int | None = None) -> DataFrame:
    """doc_id and mark of labelled rows that are not held out: all, or at most `bound` of them, chosen by a hash."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(mark).isin(0, 1) & ~held_out(F.col("doc_id"), folds, held))
    rows = rows.groupBy("doc_id").agg(F.max(mark).cast("int").alias("mark"))
    return rows if bound is None else rows.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(bound)


def held_out(doc_id, folds: int, held: int):
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == held, F.lit(False))
