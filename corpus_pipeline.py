"""A pipeline over documents: toxic documents go, then boilerplate lines, then near copies; what is left
is mixed to source weights and encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet into the
shared checkpoint folder and reads again for the next one. All but the last return the columns of docs.
Null and empty texts pass every stage; null ids are kept by the filters; rows that repeat an id stay or go together,
but for texts that differ in the toxicity stage; long texts are read whole; an empty table gives an empty one; further
columns go along with their names and values, but for ones named ids, n_tokens or round_trip, which the last stage replaces.
Each stage begins with free memory given back, as the JVMs otherwise hold what the stages before it needed most.
run() leaves its five tables in the checkpoint folder, as the result reads the last of them.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, line_dedup, mixing, near_dup, toxicity
from quarry.llm.common import checkpoint_folder, free, keep, small, table, tidy


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the rejection threshold."""
    tidy(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    (score,) = free(docs, "toxicity")
    return toxicity.score_toxicity(docs, model, score=score, evidence=None).where(F.col(score) < toxicity.REJECT).drop(score)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate in their source; n_chars follows the text."""
    tidy(spark)
    (dropped,) = free(docs, "dropped")
    clean = line_dedup.dedup_lines(docs, dropped=dropped)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.drop(dropped)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near copies."""
    tidy(spark)
    found = near_dup.near_duplicates(docs)
    (gone,) = free(docs, "gone")
    dropped = small(keep(found.where(F.col("id") != F.col("component")).select(F.col("id").alias(gone))))
    return docs.join(dropped, F.col("doc_id") == F.col(gone), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    tidy(spark)
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with ids, n_tokens, and round_trip: the ids decode to the text."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    (back,) = free(docs, "back")
    done = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=back, carry_text=True)
    same = F.col(back) == F.coalesce("text", F.lit("")).cast("binary")
    own = [f"`{c}`" for c in docs.columns if c not in ("ids", "n_tokens", "round_trip")]
    return done.select(*own, "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
