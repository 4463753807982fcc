"""Building a base of knowledge step by step: only files that are new or changed are read, cut and embedded again.

A base is a folder of tables. chunks is append-only: each row carries its file's path, the hash of its content and that of the
settings, and counts while the newest manifest names just these, so a build that is cut off leaves what was there before
valid, and files go by leaving the manifest. manifest has a part for each build. The lexical index and the sentence index
are written anew for a build that changes anything. compact() drops rows that no longer count.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import index, lexical, references, split
from quarry.sources.files import list_files, load_documents

from .config import EngineConfig
from .search import embed, hash_embedding

MANIFEST = "relative_path string, size long, mtime double, sha256 string, settings string, n_chunks long, build int"


@dataclass(frozen=True)
class Built:
    """What a build did: its number, mode (reuse, append or full), and how many files of each kind it met."""

    build: int
    mode: str
    files: dict[str, int]


def settings_key(config: EngineConfig) -> str:
    return hashlib.sha256(json.dumps(asdict(config), sort_keys=True).encode()).hexdigest()[:16]


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def manifest(spark: SparkSession, base: str) -> DataFrame:
    """The newest build's files; none before the first build."""
    if not _exists(spark, f"{base}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    every = spark.read.parquet(f"{base}/manifest")
    newest = every.agg(F.max("build")).first()[0]
    return every.where(F.col("build") == newest)


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder as a manifest knows them."""
    files = list_files(spark, folder)
    return files.select("relative_path", "size", (F.col("mtime") / 1000).alias("mtime"), F.sha2("content", 256).alias("sha256"))


def chunks(spark: SparkSession, base: str) -> DataFrame:
    """The chunks that count."""
    valid = manifest(spark, base).select("relative_path", "sha256", "settings")
    return spark.read.parquet(f"{base}/chunks").join(valid, ["relative_path", "sha256", "settings"], "left_semi")


def damaged(spark: SparkSession, base: str) -> DataFrame:
    """relative_path of files whose stored chunks aren't as many as the manifest says, or lack a vector."""
    stored = chunks(spark, base).groupBy("relative_path").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("vectors"))
    rows = manifest(spark, base).join(stored, "relative_path", "left")
    fine = (F.coalesce("n", F.lit(0)) == F.col("n_chunks")) & (F.coalesce("vectors", F.lit(0)) == F.col("n_chunks"))
    return rows.where(~fine).select("relative_path")


def rebuild(spark: SparkSession, folder: str, base: str, config: EngineConfig | None = None, model: Callable | None = None, allow_append: bool = True) -> Built:
    """Brings a base up to date with a folder of files."""
    config, model = config or EngineConfig(), model or hash_embedding()
    key, old = settings_key(config), manifest(spark, base)
    first = old.isEmpty()
    number = 0 if first else old.first()["build"] + 1
    bad = None if first else damaged(spark, base)
    usable = old.where(F.col("settings") == key)
    usable = usable if bad is None else usable.join(bad, "relative_path", "left_anti")
    now = snapshot(spark, folder)
    plan = index.rebuild_plan(usable.select("relative_path", "size", "mtime", "sha256"), now)
    # files that stand in the old manifest under other settings, or damaged, are modified, not new
    known = old.select("relative_path").withColumn("known", F.lit(True))
    plan = plan.join(known, "relative_path", "full_outer").select("relative_path", F.when(F.col("kind").isNull(), "deleted").when((F.col("kind") == "new") & F.col("known"), "modified").otherwise(F.col("kind")).alias("kind"))
    counts = index.index_mode(plan, allow_append).first()
    files = {k: counts[k] for k in ("reuse", "new", "modified", "deleted")}
    if counts["mode"] == "reuse" and not first:
        return Built(number - 1, "reuse", files)
    changed = plan.where("kind in ('new', 'modified')").select("relative_path")
    # texts by section; a file's sections are documents of their own
    docs = load_documents(spark, folder).join(F.broadcast(changed) if files["new"] + files["modified"] <= 100_000 else changed, "relative_path", "left_semi")
    docs = docs.withColumn("doc_id", F.format_string("%s#section-%04d", "relative_path", "pos")).drop("pos")
    cut = split.chunk_by_kind(docs, config.chunk_size, config.chunk_overlap).withColumnRenamed("chunk", "chunk_text")
    numbered = references.number_chunks(cut.join(docs.drop("text"), "doc_id")).withColumn("id", F.xxhash64("chunk_id"))
    rows = embed(numbered, "chunk_text", "v", model).join(now.select("relative_path", "sha256"), "relative_path").withColumn("settings", F.lit(key))
    rows.write.mode("append").parquet(f"{base}/chunks")
    made = now.join(plan.where("kind <> 'deleted'"), "relative_path")
    stored = spark.read.parquet(f"{base}/chunks").where(F.col("settings") == key).groupBy("relative_path", "sha256").agg(F.countDistinct("id").alias("n_chunks"))
    made = made.join(stored, ["relative_path", "sha256"], "left").select("relative_path", "size", "mtime", "sha256", F.lit(key).alias("settings"), F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"), F.lit(number).alias("build"))
    made.write.mode("append").parquet(f"{base}/manifest")
    live = chunks(spark, base)
    lexical.write_index(live, f"{base}/lexical/{number}", "id", "chunk_text")
    entries = split.sentence_entries(live.withColumn("source_modality", F.lit("text")), config.sentence_min_chars, config.sentence_max_chars, config.sentences_per_chunk, "id", "chunk_text")
    embed(entries, "sentence", "v", model).write.mode("overwrite").parquet(f"{base}/sentences/{number}")
    return Built(number, "full" if first else counts["mode"], files)


def lexical_index(spark: SparkSession, base: str) -> lexical.LexicalIndex:
    return lexical.read_index(chunks(spark, base), f"{base}/lexical/{manifest(spark, base).first()['build']}", "id", "chunk_text")


def sentence_index(spark: SparkSession, base: str) -> DataFrame:
    """sentence_id, parent (a chunk's id), sentence and v."""
    return spark.read.parquet(f"{base}/sentences/{manifest(spark, base).first()['build']}")


def compact(spark: SparkSession, base: str) -> None:
    """Writes the chunks that count into a new table, which takes the old one's place."""
    chunks(spark, base).write.mode("overwrite").parquet(f"{base}/chunks-new")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    files.rename(path(f"{base}/chunks"), path(f"{base}/chunks-old"))
    files.rename(path(f"{base}/chunks-new"), path(f"{base}/chunks"))
    files.delete(path(f"{base}/chunks-old"), True)


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """A row for each base below root: name, build, files, chunks and bytes of the newest build."""
    rows = spark.read.parquet(f"{root}/*/manifest").withColumn("name", F.regexp_extract(F.input_file_name(), "([^/]+)/manifest/[^/]*$", 1))
    newest = rows.groupBy("name").agg(F.max("build").alias("build"))
    kept = rows.join(newest, ["name", "build"])
    return kept.groupBy("name", "build").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chunks").alias("chunks"), F.sum("size").alias("bytes"))
