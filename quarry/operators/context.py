"""From references to the text of a prompt: groups, limits, evidence blocks, sections, web rows, diagnostics.

References are rows with query_id, id, relevance and whatever fields their kind has; a field that a table lacks counts
as null. Sections are collected per query from at most a few references, as prompts are cut before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.profiles import reference_limit, snippet_limit
from quarry.functions.text import clip, fingerprint, optional, strip, text

from .references import evidence_type

# fixed values: sections of a prompt in their order
SECTIONS = {"text": "文本证据", "timeseries": "时间序列证据", "ocr": "OCR 证据", "vision": "视觉描述证据"}
PREVIEW = 200


def field(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def context_group(modality: Column, ocr_text: Column, caption: Column) -> Column:
    """timeseries, ocr, vision or text: by the modality, else by which texts an image left."""
    m = F.lower(strip(text(modality)))
    by_name = F.when(m.isin("timeseries", "ocr"), m).when(m.isin("vision", "image", "ocr+vision"), "vision")
    has_caption, has_ocr = text(caption) != "", text(ocr_text) != ""
    return F.coalesce(by_name, F.when(has_caption, "vision").when(has_ocr, "ocr").otherwise("text"))


def to_references(candidates: DataFrame, content: str = "context") -> DataFrame:
    """Candidates (distance or null, relevance, fields of chunks) as references: with content, its preview, the raw
    score (distance, else what relevance lacks to 1) and the kind of evidence."""
    some = F.col(content)
    raw = F.coalesce(field(candidates, "distance").cast("double"), F.greatest(F.lit(0.0), 1 - F.col("relevance")))
    cleaned = {c: optional(F.col(c)) for c in ("content_type", "source_modality", "ocr_text", "image_caption", "evidence_summary", "series_id", "start_time", "end_time", "ts_summary", "event_type", "location") if c in candidates.columns}
    rows = candidates.withColumns(cleaned | {"content": some, "content_preview": F.substring(some, 1, PREVIEW), "raw_score": raw})
    return rows.withColumn("evidence_type", evidence_type(field(rows, "source_modality")))


def evidence_block(df: DataFrame, index: Column, limit: Column | int) -> Column:
    """A reference as lines: number and origin, then what its kind has, then its text cut to limit."""
    get = lambda name: field(df, name)
    modality, shown = F.lower(strip(text(get("source_modality")))), limit if isinstance(limit, Column) else F.lit(limit)

    def labelled(label: str, value: Column, rule: Column | None = None) -> Column:
        there = text(value) != ""
        return F.when(there if rule is None else there & rule, F.concat(F.lit(label), value.cast("string")))

    series = modality == "timeseries"
    head = F.concat_ws(
        " | ", F.concat(F.lit("source="), text(get("source"))), F.concat(F.lit("page="), get("page").cast("string")), labelled("section=", get("section_title")),
        labelled("modality=", get("source_modality")), labelled("type=", get("content_type")), F.format_string("relevance=%.3f", F.col("relevance")),
    )
    whole = F.coalesce(F.nullif(text(get("content")), F.lit("")), text(get("content_preview")))
    times = F.when(series & ((text(get("start_time")) != "") | (text(get("end_time")) != "")), F.concat(F.lit("time_range: "), F.coalesce(F.nullif(get("start_time"), F.lit("")), F.lit("?")), F.lit(" -> "), F.coalesce(F.nullif(get("end_time"), F.lit("")), F.lit("?"))))
    summary = get("evidence_summary")
    room = F.when(text(summary) != "", F.greatest(F.lit(120), shown)).otherwise(shown)
    return F.concat_ws(
        "\n", F.concat(F.lit("["), index.cast("string"), F.lit("] "), head), labelled("evidence_summary: ", summary), labelled("series_id: ", get("series_id"), series), times,
        labelled("location: ", get("location"), series), labelled("event_type: ", get("event_type"), series), labelled("channel_names: ", get("channel_names"), series),
        labelled("ts_summary: ", clip_to(get("ts_summary"), F.least(F.lit(280), shown + 80)), series), labelled("ocr_text: ", clip_to(get("ocr_text"), F.least(F.lit(240), shown))),
        labelled("image_caption: ", clip_to(get("image_caption"), F.least(F.lit(240), shown))), F.concat(F.lit("content:\n"), clip_to(whole, room)),
    )


LIMITS = (120, 160, 200, 220, 240, 260, 280, 300, 320, 340, 360)


def clip_to(value: Column, limit: Column) -> Column:
    """clip() at a limit that is one of the few that policies know; null stays null."""
    every = F.when(value.isNull(), F.lit(None).cast("string"))
    for n in LIMITS:
        every = every.when(limit == n, clip(value, n))
    return every.otherwise(strip(value))


def for_prompt(references: DataFrame, detail: bool = False) -> DataFrame:
    """references with place, the first of each fingerprint in the order of a prompt: those with a summary first, then by
    relevance, shorter previews first, and id. detail: tell them apart by their texts before their summaries."""
    get = lambda name: text(field(references, name))
    preview, content, summary = get("content_preview"), get("content"), get("evidence_summary")
    shown = F.coalesce(F.nullif(preview, F.lit("")), content)
    base = F.coalesce(F.nullif(shown, F.lit("")), summary) if detail else F.coalesce(F.nullif(summary, F.lit("")), shown)
    order = [F.when(summary != "", 0).otherwise(1), F.desc("relevance"), F.length(shown), F.col("id")]
    rows = references.withColumn("_fp", fingerprint(base, 260 if detail else 180, F.col("id")))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "_fp").orderBy(*order))).where("_n = 1")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).drop("_n", "_fp")


def build_context(references: DataFrame, queries: DataFrame, detail: bool = False) -> DataFrame:
    """query_id and context: sections of numbered evidence blocks. queries: query_id, query and policy."""
    counts = references.groupBy("query_id").agg(F.count(F.lit(1)).alias("_all"))
    rows = for_prompt(references, detail).join(counts, "query_id").join(queries.select("query_id", "query", "policy"), "query_id")
    rows = rows.where(F.col("place") <= reference_limit(F.col("query"), F.col("_all")))
    rows = rows.withColumn("_g", context_group(field(rows, "source_modality"), field(rows, "ocr_text"), field(rows, "image_caption")))
    rows = rows.withColumn("_limit", snippet_limit(F.col("_g"), F.col("policy")))
    blocks = rows.select("query_id", "_g", "place", evidence_block(rows, F.col("place"), F.col("_limit")).alias("block"))
    own = F.array_sort(F.collect_list(F.struct("place", "block")))
    grouped = blocks.groupBy("query_id", "_g").agg(F.array_join(F.transform(own, lambda x: x["block"]), "\n\n").alias("body"))
    titles = F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])
    turn = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("_g"))
    parts = F.array_sort(F.collect_list(F.struct(turn.alias("turn"), F.concat(F.lit("## "), titles[F.col("_g")], F.lit("\n"), F.col("body")).alias("section"))))
    return grouped.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["section"]), "\n\n").alias("context"))


def web_references(results: DataFrame, most: int = 400) -> DataFrame:
    """Results of a web search (query_id, rank, title, url, snippet, domain) as references, less relevant by rank."""
    title, snippet = F.col("title"), strip(text("snippet"))
    content = F.concat_ws("\n", F.concat(F.lit("title: "), title), F.concat(F.lit("url: "), "url"), F.when(snippet != "", F.concat(F.lit("snippet: "), snippet)))
    relevance = F.greatest(F.lit(0.3), 0.68 - 0.08 * (F.col("rank") - 1))
    return results.select(
        "query_id", "rank", F.concat(F.lit("web::"), F.substring(F.sha1(F.col("url").cast("binary")), 1, 16)).alias("chunk_id"), F.substring(F.coalesce(F.nullif(title, F.lit("")), "domain"), 1, 120).alias("source"),
        F.col("url").alias("source_path"), F.substring(title, 1, 160).alias("title"), F.col("domain").alias("section_title"), F.lit("web_search_result").alias("content_type"), F.lit("text").alias("source_modality"),
        F.concat("domain", F.lit(" 网络结果摘要")).alias("evidence_summary"), content.alias("content"), F.rtrim(F.substring(content, 1, most)).alias("content_preview"), relevance.alias("relevance"), (1 - relevance).alias("raw_score"),
    )


def corrective_settings(k: Column, threshold: Column) -> tuple[Column, Column]:
    """How many references and which threshold a second pass works with."""
    return F.least(F.lit(20), F.greatest(k + 2, F.lit(6))), F.least(threshold, F.lit(0.25))


def corrective_pass(first: DataFrame, graded: DataFrame, search, queries: DataFrame, k: int, threshold: float) -> DataFrame:
    """first's references, and for queries that aren't graded relevant merged with those of a second, wider search.
    search: a function of (queries, k, threshold) that returns query_id, id and relevance."""
    from .references import corrective_merge

    weak = graded.where("grade <> 'relevant'").select("query_id")
    wide_k, low = min(20, max(k + 2, 6)), min(threshold, 0.25)
    again = search(queries.join(weak, "query_id", "left_semi"), wide_k, low).select("query_id", "id", "relevance")
    own = first.select("query_id", "id", "relevance")
    fixed = corrective_merge(own.join(weak, "query_id", "left_semi"), again, wide_k)
    settled = own.join(weak, "query_id", "left_anti").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "id")))
    return fixed.unionByName(settled.where(F.col("place") <= k))


def topk_diagnostics(ranked: DataFrame, k: int, scores: tuple[str, ...], modality: str = "source_modality", rank: str = "place") -> DataFrame:
    """For each query the modalities and the rounded scores of its best rows in order, and whether text and series are both there."""
    kept = ranked.where(F.col(rank) <= max(4, k))
    rows = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.coalesce(F.nullif(strip(text(modality)), F.lit("")), F.lit("text")).alias("m"), *[F.round(c, 3).alias(c) for c in scores])))
    found = kept.groupBy("query_id").agg(rows.alias("_r"))
    modalities = F.transform("_r", lambda x: x["m"])
    both = F.array_contains(modalities, "text") & F.array_contains(modalities, "timeseries")
    return found.select("query_id", modalities.alias("modalities"), both.alias("joint_coverage"), *[F.col(f"_r.{c}").alias(c) for c in scores])
