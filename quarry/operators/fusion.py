"""Candidates of several retrievers as one table by (query_id, id), and their fused scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.profiles import extension_bonus, modality_bonus
from quarry.functions.text import date_ordinals, labelled_date_ordinals, years
from quarry.plans.config import EngineConfig

DEFAULT = EngineConfig()


def merge_candidates(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """dense: query_id, id, rank, distance; lexical: query_id, id, rank, score. All of either side stay."""
    d = dense.select("query_id", "id", F.col("rank").alias("dense_rank"), (1 / (1 + F.col("distance"))).alias("dense_relevance"))
    s = lexical.select("query_id", "id", F.col("rank").alias("lexical_rank"), F.col("score").alias("lexical_score"))
    return d.join(s, ["query_id", "id"], "full_outer").fillna(0.0, ["dense_relevance", "lexical_score"])


def highest(column: str, *keys: str) -> Column:
    """The largest value of a group; 1 where that is 0."""
    return F.coalesce(F.nullif(F.max(column).over(Window.partitionBy(*keys)), F.lit(0.0)), F.lit(1.0))


def fuse(candidates: DataFrame, bonus: Column | None = None, config: EngineConfig = DEFAULT, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Adds fused_score: reciprocal ranks and both scores as shares of their maxima, and a bonus."""
    reciprocal = lambda rank: F.coalesce(1.0 / (config.rrf_k + F.col(rank)), F.lit(0.0))
    score = reciprocal("dense_rank") + reciprocal("lexical_rank")
    score += config.dense_weight * (F.col("dense_relevance") / highest("dense_relevance", *keys))
    score += config.lexical_weight * (F.col("lexical_score") / highest("lexical_score", *keys))
    return candidates.withColumn("fused_score", score if bonus is None else score + bonus)


def rrf(*lists: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, id, rank)."""
    parts = [x.select("query_id", "id", (1.0 / (k + F.col("rank"))).alias("s")) for x in lists]
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return every.groupBy("query_id", "id").agg(F.sum("s").alias("score"))


def merge_lists(first: DataFrame, second: DataFrame, score: str = "fused_score") -> DataFrame:
    """Of each (query_id, id) the row with the larger score, that of first on ties."""
    every = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1)))
    best = Window.partitionBy("query_id", "id").orderBy(F.desc(score), "_side")
    return every.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_side")


def path_bonus(path: Column, hints: Column) -> Column:
    """0.02 for each hint that the path holds, 0.06 at most."""
    matched = F.size(F.filter(hints, lambda t: (t != "") & F.contains(F.lower(path), t)))
    return F.least(F.lit(0.06), 0.02 * matched)


def temporal_anchor(text: Column) -> Column:
    """The latest date in the text, else the last day of its latest year, as an ordinal."""
    head = F.substring(text, 1, 1200)
    last_year = F.array_max(years(head))
    end = F.date_diff(F.make_date(last_year, F.lit(12), F.lit(31)), F.lit("0001-01-01").cast("date")) + 1
    return F.coalesce(F.array_max(date_ordinals(head)), end)


def document_anchor(text: Column, date: Column, *fields: Column) -> Column:
    """A document's date as an ordinal: that of its date field, else the latest labelled one in its title, section, source
    and text, else the latest one there, else the end of the latest year."""
    head = F.concat_ws("\n", *fields, F.substring(text, 1, 1200))
    return F.coalesce(F.array_max(date_ordinals(date)), F.array_max(labelled_date_ordinals(head)), temporal_anchor(head))


def candidate_bonus(kind: Column, modality: Column, extension: Column, hints: Column, *fields: Column) -> Column:
    """What a candidate's modality, extension and path earn under a kind of question."""
    return modality_bonus(kind, modality) + extension_bonus(kind, extension) + path_bonus(F.concat_ws(" ", *fields), hints)


def fuse_mode(candidates: DataFrame, mode: str, adjustment: Column | None = None, config: EngineConfig = DEFAULT, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """fused_score and relevance of one retrieval alone (bm25 or dense) or of both (hybrid): a side counts where it ranks a candidate."""
    sides = {"dense": ("dense_rank", "dense_relevance", config.dense_weight), "bm25": ("lexical_rank", "lexical_score", config.lexical_weight)}
    used = [sides[m] for m in ("dense", "bm25") if mode in (m, "hybrid")]
    if not used:
        raise ValueError(f"unknown mode {mode!r}")
    rows = candidates.where(" or ".join(f"{rank} is not null" for rank, _, _ in used))
    parts = [F.when(F.col(rank).isNotNull(), 1.0 / (config.rrf_k + F.col(rank)) + weight * F.col(value) / highest(value, *keys)).otherwise(0.0) for rank, value, weight in used]
    total = parts[0] if len(parts) == 1 else parts[0] + parts[1]
    score = total if adjustment is None else total + adjustment
    return rows.withColumn("fused_score", score).withColumn("relevance", F.greatest("fused_score", *[value for _, value, _ in used]))


def sentence_hits(candidates: DataFrame, sentences: DataFrame) -> DataFrame:
    """candidates with the rank, relevance and text of their nearest sentence, where one was found; nothing is added.
    sentences: query_id, parent, sentence and distance of the nearest sentences of each query."""
    best = sentences.groupBy("query_id", F.col("parent").alias("id")).agg(F.min(F.struct("distance", "sentence")).alias("s"))
    order = Window.partitionBy("query_id").orderBy("s.distance", "id")
    best = best.select("query_id", "id", F.row_number().over(order).alias("sentence_rank"), (1 / (1 + F.col("s.distance"))).alias("sentence_relevance"), F.col("s.sentence").alias("sentence"))
    return candidates.join(best, ["query_id", "id"], "left")


def modality_limits(docs: DataFrame, dense_k: int, lexical_k: int, k: int, modality: str = "source_modality") -> DataFrame:
    """One row: how many modalities there are, whether dense retrieval goes by modality, and how many each gives."""
    name = F.nullif(F.trim(F.col(modality)), F.lit(""))
    found = docs.agg(F.countDistinct(F.coalesce(name, F.lit("text"))).alias("modalities"), F.count(name).alias("named"), F.count(F.lit(1)).alias("n"))
    m = F.greatest(F.col("modalities"), F.lit(1))
    grouped = (F.col("modalities") > 1) & (F.col("named") / F.greatest(F.col("n"), F.lit(1)) >= 0.9)
    return found.select("modalities", grouped.alias("grouped"), (F.greatest(F.lit(1), F.ceil(dense_k / m)) + 2).cast("long").alias("dense_limit"), F.greatest(F.lit(k), F.ceil(lexical_k / m)).cast("long").alias("lexical_limit"))


def asked_modalities(queries: DataFrame, modalities: DataFrame) -> DataFrame:
    """query_id, modality and turn: the modalities that a query of its kind looks at, the preferred ones first; a time
    series only where the question is about one. queries: query_id, kind and preferred; modalities: modality."""
    met = queries.join(F.broadcast(modalities.select("modality").distinct()))  # a handful of modalities
    at = F.array_position("preferred", F.col("modality"))
    kept = met.where((F.col("modality") != "timeseries") | (F.col("kind") == "timeseries_related") | (at > 0))
    order = Window.partitionBy("query_id").orderBy(F.when(at > 0, at).otherwise(1_000), "modality")
    return kept.select("query_id", "modality", F.row_number().over(order).alias("turn"))


def fuse_branches(candidates: DataFrame, branch: str, config: EngineConfig = DEFAULT) -> DataFrame:
    """Each branch's candidates scored by its own maxima, then merged with the larger score of each."""
    scored = fuse(candidates, config=config, keys=("query_id", branch))
    best = Window.partitionBy("query_id", "id").orderBy(F.desc("fused_score"), branch)
    return scored.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def temporal_adjustment(candidates: DataFrame, query_years: Column, query_dates: Column, recent: Column, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Adds temporal_bonus to candidates that have years (array) and anchor (ordinal or null)."""
    window = Window.partitionBy(*keys)
    oldest, newest, anchor = F.min("anchor").over(window), F.max("anchor").over(window), F.col("anchor")
    asked = F.size(query_years)
    overlap = F.size(F.array_intersect("years", query_years)) / F.greatest(asked, F.lit(1))
    by_year = F.when((asked > 0) & (overlap > 0), 0.08 + 0.08 * overlap).when((asked > 0) & (F.size("years") > 0), F.lit(-0.05)).otherwise(F.lit(0.0))
    by_date = F.when(anchor.isNotNull() & F.exists(query_dates, lambda q: F.abs(anchor - q) <= 3), 0.08).otherwise(F.lit(0.0))
    newer = F.when(newest > oldest, 0.10 * (anchor - oldest) / F.greatest(newest - oldest, F.lit(1))).otherwise(F.lit(0.04))
    rest = F.when(recent & anchor.isNotNull(), newer).when(anchor.isNotNull(), F.lit(0.03)).when(F.size("years") > 0, F.lit(0.01)).otherwise(F.lit(-0.02))
    return candidates.withColumn("temporal_bonus", by_year + by_date + rest)
