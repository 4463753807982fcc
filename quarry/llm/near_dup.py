"""Near-dedup by fast similarity sketching, banding and exact verification.

A document's set is the distinct 64-bit hashes of the shingles of its words. Documents with equal sets are
one class at once, and only a class's first document goes on. Its sketch has T coordinates: in round i
each element goes to the coordinate that a hash of the element and i names, with a value that begins with i; in
round T + i all elements go to coordinate i. Rounds end when every coordinate is filled, so none stays empty,
and two sketches agree in a share of coordinates that is concentrated about the similarity. Bands of
some coordinates each are hashed to buckets: with 36 of 5 a pair of similarity 0.8 shares no bucket once in about
1.6 million, with 30 of 6 a pair of 0.85 once in about 1.5 million.

A bucket's documents are compared with its first one only, which gives links enough for most. Documents in
buckets that hold more than one component after that are open. Of their shingles those that lie in at most
RARE components are set apart. Two open documents of different components either share such a shingle, and
then meet by it; or what they share is among their other shingles, whose numbers bound their similarity: only
pairs whose bound reaches the threshold are left. Both are exact, so every pair that shares a bucket
is verified to be linked or not, or can't be linked, or lies in one component already; and a passage that very
many documents share makes no pairs. Verification compares whole sets, from the texts of the documents in
candidate pairs alone.

Defined results: null and empty texts, and texts without words, have an empty set and are linked with
nothing; fewer words than a shingle's are one shingle; rows that repeat an id come back each with its
own set's size, and all with the component of the one whose set has the least hash; null ids are linked with nothing; long
texts are read whole; an empty table gives none; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, M1, M2, blocks, hash_words, keep_alone, mix, releasing, small_batches, utf8
from .components import components

ROWS, BANDS = 5, 36
RARE = 8
IN_WORD = np.ones(256, bool)
IN_WORD[[9, 10, 11, 12, 13, 32]] = False


def shingles(texts: pa.Array, k: int):
    """For each row its set, as a sorted array."""
    data, at = utf8(texts)
    for lo, hi in blocks(at):
        part = data[at[lo] : at[hi]]
        part = part + np.uint8(32) * ((part >= 65) & (part <= 90))
        words, row = hash_words(part, at[lo : hi + 1], IN_WORD)
        n = len(words)
        every = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            every = mix(every * M1 + words[j : n - k + 1 + j] + GOLDEN) if n >= k else every
        for i in range(hi - lo):
            a, b = row[i], row[i + 1]
            if b - a >= k:
                found = np.sort(every[a : b - k + 1])
                yield found[np.concatenate([[True], found[1:] != found[:-1]])]
            else:
                short = np.full(int(b > a), b - a, np.uint64)
                for w in words[a:b]:
                    short = mix(short * M2 + w)
                yield short


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """A row of t coordinates for each set; an empty set's are all ones."""
    size = np.array([len(x) for x in sets], np.int64)
    out = np.full(len(sets) * t, ~np.uint64(0))
    elements = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), size)
    for i in range(2 * t):
        if not len(elements):
            break
        h = mix(elements + np.array(i + 1, np.uint64) * GOLDEN)
        place = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(h), i - t)
        np.minimum.at(out, owner * t + place, np.uint64(i) << np.uint64(48) | mix(h) >> np.uint64(16))
        if i < 4 or i % 8 == 7:  # those whose coordinates are all filled are done
            live = (out.reshape(-1, t) == ~np.uint64(0)).any(axis=1)[owner]
            elements, owner = elements[live], owner[live]
    return out.reshape(-1, t)


def bands_of(sketch: np.ndarray, rows: int) -> np.ndarray:
    n, t = sketch.shape
    out = np.tile(np.arange(1, t // rows + 1, dtype=np.uint64) * GOLDEN, (n, 1))
    for j in range(rows):
        out = mix(out * M1 + sketch[:, j::rows][:, : t // rows])
    return out.view(np.int64)


def _sketch(k: int, rows: int, n_bands: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            sets: list[np.ndarray] = []
            lo = size = 0
            for i, found in enumerate(shingles(texts, k)):
                sets.append(found)
                size += len(found)
                if size >= 500_000 or i == batch.num_rows - 1:
                    bands = bands_of(sketches(sets, rows * n_bands), rows)
                    flat = pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), n_bands).cast(pa.list_(pa.int64()))
                    keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, len(sets)), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.binary()), flat], ["id", "n", "key", "bands"])
                    sets, lo, size = [], i + 1, 0

    return run


def _alike(k: int, percent: int):
    """Of pairs with both texts, those that are similar enough."""

    def run(batches):
        for batch in batches:
            pairs = zip(shingles(batch.column("text_a"), k), shingles(batch.column("text_b"), k), strict=True)
            good = []
            for a, b in pairs:
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(bool(both) and 100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. docs: id and text."""
    texts_a = docs.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    texts_b = docs.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    with_a = pairs.join(texts_a, "a")
    return with_a.join(texts_b, "b").select("a", "b", "text_a", "text_b").mapInArrow(releasing(_alike(k, percent)), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, n_bands: int = BANDS) -> DataFrame:
    """id, n (its set's size) and component (the least id that links lead to) of each document.

    Links hold where 100 * intersection >= percent * union of sets of k-word shingles. ids are integers.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = keep_alone(docs.mapInArrow(releasing(_sketch(k, rows, n_bands)), "id long, n long, key binary, bands array<long>"))
    repeats = _repeats(made)
    sketched = made.where("id is not null").groupBy("id").agg(F.min_by(F.struct("n", "key", "bands"), "key").alias("s")).select("id", "s.*") if repeats else made
    full = sketched.where("n > 0 and id is not null")
    classes = full.groupBy("key").agg(F.min("id").alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = keep_alone(classes)
    placed = keep_alone(classes.select("first", "n", F.explode("bands").alias("bucket")))
    heads = placed.groupBy("bucket").agg(F.min(F.struct("first", "n")).alias("h"), F.count(F.lit(1)).alias("m")).where("m > 1")
    heads = heads.select("bucket", F.col("h.first").alias("a"), F.col("h.n").alias("n_a"))
    shared = keep_alone(placed.join(heads, "bucket"))
    fits = lambda x, y: F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y)
    pairs = keep_alone(shared.where(F.col("first") > F.col("a")).where(fits(F.col("n_a"), F.col("n"))).select("a", F.col("first").alias("b")).distinct())
    texts = docs.where("id is not null").join(classes.select(F.col("first").alias("id")), "id", "left_semi")
    links = keep_alone(verify(pairs, texts, k, percent))
    found = keep_alone(components(links))
    # buckets whose members are in different components still
    named = shared.select("bucket", "first", "n").join(found.withColumnRenamed("id", "first"), "first", "left")
    named = keep_alone(named.withColumn("component", F.coalesce("component", "first")))
    open_ = named.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    left = keep_alone(named.join(open_, "bucket", "left_semi"))
    across = keep_alone(_across(left, texts, k, percent).join(pairs, ["a", "b"], "left_anti"))
    more = keep_alone(verify(across, texts, k, percent))
    if not more.isEmpty():
        found = keep_alone(components(links.union(more)))
    named = classes.select("key", "first").join(found.select(F.col("id").alias("first"), "component"), "first", "left")
    named = named.select(F.col("key").alias("_key"), F.coalesce("component", "first").alias("component"))
    sketched = sketched.withColumn("_full", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("key")))
    done = sketched.join(named, F.col("_full") == F.col("_key"), "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    if repeats:
        done = made.select("id", "n").join(done.select("id", "component"), "id", "left")
    return done


def _exploded(k: int):
    def run(batches):
        for batch in batches:
            ids, parts, size, names = [], [], 0, ["id", "component", "shingle"]
            for i, found in enumerate(shingles(batch.column("text"), k)):
                ids.append(np.full(len(found), i))
                parts.append(found)
                size += len(found)
                if size >= 500_000 or i == batch.num_rows - 1:
                    at = pa.array(np.concatenate(ids))
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("component").take(at), pa.array(np.concatenate(parts).view(np.int64))], names)
                    ids, parts, size = [], [], 0

    return run


def _across(left: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of open documents (bucket, first, n, component) across components that can be links."""
    open_ids = left.select(F.col("first").alias("id"), "n", "component").distinct()
    rows = texts.join(open_ids.select("id", "component"), "id").mapInArrow(releasing(_exploded(k)), "id long, component long, shingle long")
    rows = keep_alone(rows)
    spread = rows.select("shingle", "component").distinct().groupBy("shingle").agg(F.count(F.lit(1)).alias("spread")).where(F.col("spread") <= RARE)
    rare = keep_alone(rows.join(spread, "shingle"))
    others = open_ids.join(rare.groupBy("id").agg(F.count(F.lit(1)).alias("r")), "id", "left")
    others = others.select(F.col("id").alias("first"), "n", (F.col("n") - F.coalesce("r", F.lit(0))).alias("e"))
    # alive: even if all of the others are shared
    sides = keep_alone(left.drop("n").join(others, "first").where(F.lit(100) * F.col("e") >= F.lit(percent) * F.col("n")))
    every = sides.groupBy("first").agg(F.collect_list("bucket").alias("all"))
    sides = sides.join(every, "first")
    one, two = (sides.select("bucket", F.col("first").alias(x), F.col("n").alias(f"n_{x}"), F.col("component").alias(f"c_{x}"), F.col("e").alias(f"e_{x}"), F.col("all").alias(f"all_{x}")) for x in "ab")
    most = F.least("e_a", "e_b")
    reach = F.lit(100) * most >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - most)
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    once = one["bucket"] == F.array_min(F.array_intersect("all_a", "all_b"))  # of the buckets that they share
    bounded = one.join(two, (one["bucket"] == two["bucket"]) & (F.col("c_a") < F.col("c_b")) & reach & once).select(*pair)
    shared = rare.where("spread > 1")
    shared = shared.join(others.withColumnRenamed("first", "id"), "id")
    one, two = (shared.select("shingle", F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("component").alias(f"c_{x}"), F.col("e").alias(f"e_{x}")) for x in "ab")
    met = one.join(two, (one["shingle"] == two["shingle"]) & (F.col("c_a") < F.col("c_b")))
    met = met.groupBy("a", "b", "n_a", "n_b", "e_a", "e_b").agg(F.count(F.lit(1)).alias("m"))
    most = most + F.col("m")
    met = met.where(F.lit(100) * most >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - most)).select(*pair)
    return bounded.union(met).distinct()


def _repeats(made: DataFrame) -> bool:
    """Whether an id comes twice."""
    return not made.groupBy("id").count().where("count > 1 and id is not null").isEmpty()


def op5_near_dup(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs, k=3, percent=85, rows=6, n_bands=30)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
