"""From ranked chunks to references: neighbours, overviews, dedup, merges and grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import fingerprint

from .sizes import small


def number_chunks(chunks: DataFrame, doc: str = "doc_id", order: str = "pos") -> DataFrame:
    """chunk_index from 0 within a document, and chunk_id."""
    index = F.row_number().over(Window.partitionBy(doc).orderBy(order)) - 1
    return chunks.withColumn("chunk_index", index).withColumn("chunk_id", F.format_string("%s::chunk-%04d", F.col(doc).cast("string"), F.col("chunk_index")))


def expand_neighbours(chunks: DataFrame, n: int, doc: str = "doc_id", index: str = "chunk_index", text: str = "text") -> DataFrame:
    """Adds context: the distinct non-empty texts of a chunk and those up to n places beside it."""
    near = Window.partitionBy(doc).orderBy(index).rangeBetween(-n, n)
    around = F.array_sort(F.collect_list(F.struct(index, F.trim(text).alias("t"))).over(near))
    texts = F.array_distinct(F.filter(F.transform(around, lambda x: x["t"]), lambda x: x != ""))
    return chunks.withColumn("context", F.array_join(texts, "\n"))


def neighbours_of(chosen: DataFrame, chunks: DataFrame, n: int, doc: str = "doc_id", index: str = "chunk_index", text: str = "text") -> DataFrame:
    """doc, index and context of chosen chunks (distinct doc and index): as expand_neighbours() has it, but only chunks beside
    chosen ones are read together, by a join on their places."""
    wanted = chosen.select(doc, F.col(index).alias("_own"), F.explode(F.sequence(F.col(index) - n, F.col(index) + n)).alias(index))
    met = chunks.select(doc, index, F.trim(text).alias("t")).join(small(wanted), [doc, index])
    around = F.array_sort(F.collect_list(F.struct(index, "t")))
    texts = F.array_distinct(F.filter(F.transform(around, lambda x: x["t"]), lambda x: x != ""))
    return met.groupBy(doc, F.col("_own").alias(index)).agg(F.array_join(texts, "\n").alias("context"))


def places_beside(chosen: DataFrame, chunks: DataFrame, n: int, doc: str = "doc_id", index: str = "chunk_index") -> DataFrame:
    """id of the chunks up to n places beside chosen ones (doc and index), themselves included; no text is read."""
    wanted = chosen.select(doc, F.explode(F.sequence(F.col(index) - n, F.col(index) + n)).alias(index)).distinct()
    return chunks.select("id", doc, index).join(small(wanted), [doc, index]).select("id")


def overview(references: DataFrame, modality: str, *keys: str) -> DataFrame:
    grouped = references.groupBy(*keys) if keys else references.groupBy()
    return grouped.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(modality) == "text").alias("n_text"), F.countDistinct(modality).alias("n_modalities"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """Counts by value; null and blank are missing."""
    value = F.coalesce(F.nullif(F.trim(F.col(column).cast("string")), F.lit("")), F.lit("missing"))
    return rows.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def prompt_order(references: DataFrame, k: int, text: str = "text", relevance: str = "relevance", *keys: str) -> DataFrame:
    """References of distinct fingerprints, the first of each by relevance, k at most."""
    rows = references.withColumn("_fp", fingerprint(F.col(text), 180, F.col("id")))
    first = Window.partitionBy(*keys, "_fp").orderBy(F.desc(relevance), "id")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    every = Window.partitionBy(*keys).orderBy(F.desc(relevance), "id")
    return rows.withColumn("place", F.row_number().over(every)).where(F.col("place") <= k).drop("_n", "_fp")


def corrective_merge(first: DataFrame, second: DataFrame, k: int, relevance: str = "relevance") -> DataFrame:
    """Both passes' references, each once with its larger relevance, k at most for each query."""
    best = first.unionByName(second).groupBy("query_id", "id").agg(F.max(relevance).alias(relevance))
    order = Window.partitionBy("query_id").orderBy(F.desc(relevance), "id")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def append_unseen(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second.join(first.select("query_id", "id"), ["query_id", "id"], "left_anti"))


def grade(references: DataFrame, relevance: str = "relevance") -> DataFrame:
    """relevant, partial or insufficient, from how many references there are and how relevant."""
    n, high, mean = F.col("n"), F.col("high"), F.col("mean")
    found = references.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max(relevance).alias("high"), F.avg(relevance).alias("mean"))
    return found.withColumn("grade", F.when((n >= 2) & (high >= 0.78) & (mean >= 0.62), "relevant").when((high >= 0.55) | (mean >= 0.42), "partial").otherwise("insufficient"))


def evidence_type(modality: Column) -> Column:
    return F.when(modality == "ocr", "ocr").when(modality.isin("vision", "image"), "vision").when(modality == "multimodal", "multimodal").otherwise("text")
