"""The engine: build an index of chunks, and search it with many queries at once.

Search is one plan: lexical and dense candidates under filters, sentence hits, fusion with bonuses by modality, path and time,
the full rerank with joint features, group adjustments, threshold, diversity and neighbours of the chosen chunks alone. The embedding comes in
as a function; the stand-in here is deterministic and claims no parity with a model.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import profiles as P
from quarry.functions.text import years
from quarry.operators import dense, lexical, references, rerank
from quarry.operators.filters import Condition, filtered
from quarry.operators.fusion import candidate_bonus, document_anchor, fuse, merge_candidates, sentence_hits, temporal_adjustment
from quarry.operators.sizes import held, of_ids, small
from quarry.operators.split import chunk_documents

from .config import EngineConfig


def hash_embedding(width: int = 64) -> Callable[[pd.Series], pd.Series]:
    """A stand-in for a model: hashed counts of words, of length 1."""
    import zlib

    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(width)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % width] += 1 if h >> 31 else -1
            out.append((v / max(1e-9, np.linalg.norm(v))).tolist())
        return pd.Series(out)

    return embed


def embed(rows: DataFrame, text: str, out: str, model: Callable[[pd.Series], pd.Series]) -> DataFrame:
    return rows.withColumn(out, F.pandas_udf(model, "array<double>")(F.col(text)))


def build_index(docs: DataFrame, path: str, config: EngineConfig | None = None, model: Callable | None = None) -> DataFrame:
    """Writes chunks with numbers, ids and vectors, and returns them as written. docs: doc_id, text, and others."""
    config, model = config or EngineConfig(), model or hash_embedding()
    cut = chunk_documents(docs, config.chunk_size, config.chunk_overlap).withColumnRenamed("chunk", "chunk_text")
    numbered = references.number_chunks(cut.join(docs.drop("text"), "doc_id"))
    embed(numbered.withColumn("id", F.xxhash64("chunk_id")), "chunk_text", "v", model).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


def search(chunks: DataFrame, queries: DataFrame, config: EngineConfig | None = None, conditions: list[Condition] = (), mode: str = "and", model: Callable | None = None, text: str = "chunk_text", group: str = "doc_id",
           sample: str | None = None, index: lexical.LexicalIndex | None = None, sentences: DataFrame | None = None, variants: DataFrame | None = None) -> DataFrame:
    """query_id, place, id, rerank_score, relevance, text and context of the references of each query.

    chunks: id, text, v, doc_id, chunk_index, source; source_modality, extension and title where there are. queries: query_id,
    query; v too, or a model. sample: a column whose dominant group is raised, and alone kept where it leads by enough.
    index: a written lexical index of the chunks; none: postings are made here. sentences: nearest sentences of each query.
    variants: more texts of the queries, as a rewriting model or expansion gives them (query_id, query, and v or a model): they retrieve, queries rank.
    """
    config = config or EngineConfig()
    if "v" not in queries.columns:
        queries = embed(queries, "query", "v", model or hash_embedding())
    every = queries.select("query_id", "query", "v")
    if variants is not None:
        more = variants if "v" in variants.columns else embed(variants, "query", "v", model or hash_embedding())
        every = every.unionByName(more.select("query_id", "query", "v"))
    rows = filtered(chunks, list(conditions), mode)
    scope = rows if conditions else None
    # figures are those of all chunks, results those of the chunks that the conditions leave
    found = lexical.bm25_indexed(index, every, scope=scope) if index else lexical.bm25(lexical.tokens(chunks, "id", text), every, scope=scope)
    body = lexical.bodies(rows, "id", text) if index is None else index.bodies if scope is None else index.bodies.join(scope.select("id"), "id", "left_semi")
    lex = lexical.top(lexical.with_phrase_bonus(body, found, every), config.lexical_top_k, "query_id")
    nearest = dense.dense_topk if variants is None else dense.dense_bundle_topk
    near = nearest(every.select("query_id", "v"), rows.select("id", "v"), config.dense_top_k, config.metric)
    bundle = F.array("query")
    asked = queries.select("query_id", "query").withColumn("kind", P.kind(bundle)).withColumns({"hints": P.path_hints(bundle, F.col("kind")), "joint": P.joint(bundle), "times": P.temporal(bundle)})
    fields = [c for c in ("title", "source", "source_modality", "extension", "location", "event_type", "channel_names", "date") if c in rows.columns]
    own = [c for c in ("doc_id", "chunk_index", *fields, *([sample] if sample else [])) if c in rows.columns]
    # retrieved once, whatever follows; then only the candidates' chunks are read with their texts
    met = held(merge_candidates(near, lex))
    full = met.join(of_ids(rows, met).select("id", text, *dict.fromkeys(own)), "id").join(small(asked), "query_id")
    if sentences is not None:
        full = sentence_hits(full, sentences)
    get = lambda name: F.col(name) if name in fields else F.lit(None).cast("string")
    full = full.withColumn("source_modality", F.coalesce(F.nullif(F.trim(get("source_modality")), F.lit("")), F.lit("text")))
    named = F.concat_ws(" ", get("title"), get("source"))
    full = full.withColumns({"years": years(F.col(text)), "anchor": document_anchor(F.col(text), get("date"), get("title"), get("source")), "modality_bonus": candidate_bonus(F.col("kind"), F.col("source_modality"), get("extension"), F.col("hints"), named)})
    timed = temporal_adjustment(full, F.col("times.years"), F.col("times.days"), F.col("times.recent"))
    timed = timed.withColumn("temporal_bonus", F.when(F.col("times.temporal"), F.col("temporal_bonus")).otherwise(0.0))
    scored = fuse(timed, F.col("modality_bonus") + F.col("temporal_bonus"), config)
    ranked = rerank.full_rerank(rerank.with_joint_features(scored.withColumnRenamed(text, "text")))
    ranked = ranked.withColumn("rerank_score", rerank.joint_boost(F.col("rerank_score"), F.col("joint"), F.col("source_modality")))
    if sample:
        ranked = rerank.trim_groups(rerank.boost_groups(ranked, sample, "rerank_score"), sample, "rerank_score")
    ranked = lexical.top(ranked.where(F.round("relevance", 6) >= config.score_threshold), config.rerank_top_k * config.overfetch, "query_id", score="rerank_score")
    chosen = held(rerank.diversify(ranked, group, config.rerank_top_k))
    places = chosen.select("doc_id", "chunk_index").distinct()
    beside = references.places_beside(places, rows, config.neighbours)
    around = references.neighbours_of(places, of_ids(rows, beside).select("doc_id", "chunk_index", F.col(text).alias("text")), config.neighbours)
    return chosen.join(around, ["doc_id", "chunk_index"]).select("query_id", "place", "id", "doc_id", "rerank_score", "relevance", "text", "context")
