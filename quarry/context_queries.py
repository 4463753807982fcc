"""Queries from references to prompts, over the documents. The eight longest documents of a source stand for the references of a
query, in that order; languages stand for modalities. Each has SQL over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import profiles as P
from quarry.operators import context
from quarry.queries import add, table

MODALITY = {"en": "text", "de": "timeseries", "fr": "ocr", "es": "vision"}
SPACE = "^\\s+|\\s+$"
CLIP_AT = "['。', '！', '？', '；', chr(10), '，', ',', '、']"
STRIP = "'[ ，,、；;:：]+$'"
WHOLE = "coalesce(text, '')"


def references_of(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    modality = F.create_map(*[F.lit(x) for pair in MODALITY.items() for x in pair])[F.col("lang")]
    rows = docs.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).where("rank <= 8")
    rows = rows.withColumns({"query_id": F.col("source"), "id": F.col("doc_id"), "relevance": F.round(1.0 / F.col("rank"), 6), "source_modality": modality, "content": F.col("text"), "content_preview": F.substring("text", 1, 200)})
    summary = F.when(F.col("rank") == 5, F.concat(F.lit("summary of "), F.col("doc_id").cast("string")))
    return rows.withColumns({"evidence_summary": summary, "page": F.when(F.col("rank") == 2, 7), "location": F.lit("site"), "ocr_text": F.when(F.col("lang") == "fr", F.col("text")), "start_time": F.lit("2024")})


REFS = f"""rf as (select *, source as query_id, doc_id as id, round(1.0 / rank, 6) as relevance, case lang {' '.join(f"when '{k}' then '{v}'" for k, v in MODALITY.items())} end as modality,
  case when rank = 5 then 'summary of ' || doc_id end as summary, case when rank = 2 then 7 end as page from (select *, row_number() over (partition by source order by n_chars desc, doc_id) as rank from documents) where rank <= 8)"""


def clip_sql(t: str, limit: str) -> str:
    """The cut at a boundary as in snippet_clip, for a limit given by an expression."""
    s = f"regexp_replace({t}, '{SPACE}', '', 'g')"
    head = f"substr({s}, 1, {limit})"
    last = f"(list_max([case when instr({head}, x) = 0 then 0 else length({head}) - instr(reverse({head}), x) + 1 end for x in {CLIP_AT}]) - 1)"
    cut = f"regexp_replace(substr({head}, 1, greatest({last}, 0)), {STRIP}, '')"
    return f"case when length({s}) <= {limit} then {s} when {last} >= greatest(24, {limit} // 2) and {cut} <> '' then {cut} else regexp_replace({head}, {STRIP}, '') end"


def block_sql(place: str, limit: str) -> str:
    head = "'source=' || source || coalesce(' | page=' || page, '') || ' | modality=' || modality || ' | relevance=' || printf('%.3f', relevance)"
    room = f"(case when summary is not null then greatest(120, {limit}) else {limit} end)"
    return (
        f"'[' || {place} || '] ' || {head} || coalesce(chr(10) || 'evidence_summary: ' || summary, '') || case when modality = 'timeseries' then chr(10) || 'time_range: 2024 -> ?' || chr(10) || 'location: site' else '' end"
        f" || case when lang = 'fr' and coalesce(text, '') <> '' then chr(10) || 'ocr_text: ' || {clip_sql('text', f'least(240, {limit})')} else '' end || chr(10) || 'content:' || chr(10) || {clip_sql(WHOLE, room)}"
    )


@add("context_groups", f"with {REFS} select source, case modality when 'vision' then 'vision' when 'ocr' then 'ocr' when 'timeseries' then 'timeseries' else 'text' end as context_group, count(*) as n from rf group by all")
def _(spark, d):
    rows = references_of(spark, d)
    group = context.context_group(F.col("source_modality"), F.col("ocr_text"), F.lit(None).cast("string"))
    return rows.groupBy("source", group.alias("context_group")).agg(F.count(F.lit(1)).alias("n"))


@add("evidence_blocks", f"with {REFS} select id, {block_sql('rank', '160')} as block from rf")
def _(spark, d):
    rows = references_of(spark, d)
    return rows.select("id", context.evidence_block(rows, F.col("rank"), 160).alias("block"))


@add("reference_rows", f"with {REFS} select id, left(text, 200) as content_preview, round(case when rank % 2 = 0 then rank / 10.0 else greatest(0, 1 - relevance) end, 6)::double as raw_score, case modality when 'ocr' then 'ocr' when 'vision' then 'vision' else 'text' end as evidence_type from rf")
def _(spark, d):
    rows = references_of(spark, d).withColumn("distance", F.when(F.col("rank") % 2 == 0, F.col("rank") / 10.0))
    made = context.to_references(rows.drop("content", "content_preview"), "text")
    return made.select("id", "content_preview", F.round("raw_score", 6).alias("raw_score"), "evidence_type")


PROMPT = f"""{REFS}, fp as (select *, case when fpt <> '' then left(fpt, 180) else id::varchar end as fp from (select *, regexp_replace(lower(coalesce(summary, left(text, 200), '')), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}_一-鿿]+', '', 'g') as fpt from rf)),
fd as (select * from (select *, row_number() over (partition by query_id, fp order by (summary is null)::int, relevance desc, length(left(text, 200)), id) as n from fp) where n = 1),
pl as (select *, row_number() over (partition by query_id order by (summary is null)::int, relevance desc, length(left(text, 200)), id) as place from fd)"""


@add("prompt_references", f"with {PROMPT} select query_id, id, place from pl where place <= 5")
def _(spark, d):
    return context.for_prompt(references_of(spark, d)).where("place <= 5").select("query_id", "id", "place")


QUESTION = "how are the steps of src done and 为什么 步骤"


@add("context_build", f"""with {PROMPT}, lm as (select *, case when modality = 'timeseries' then 260 when modality in ('ocr', 'vision') then 220 else 320 end as lim, case modality when 'text' then 1 when 'timeseries' then 2 when 'ocr' then 3 when 'vision' then 4 end as turn from pl where place <= 5),
bl as (select query_id, turn, place, {block_sql('place', 'lim')} as block from lm), se as (select query_id, turn, '## ' || ['文本证据', '时间序列证据', 'OCR 证据', '视觉描述证据'][turn] || chr(10) || string_agg(block, chr(10) || chr(10) order by place) as section from bl group by query_id, turn)
select query_id, string_agg(section, chr(10) || chr(10) order by turn) as context from se group by 1""")
def _(spark, d):
    refs = references_of(spark, d)
    asked = refs.select("query_id").distinct().withColumn("query", F.lit(QUESTION)).withColumn("policy", P.answer_policy(F.lit(QUESTION)))
    return context.build_context(refs, asked)


@add("web_references", "select page_id as query_id, 'web::' || left(sha1(url), 16) as chunk_id, 'page' as source, round(greatest(0.3, 0.68 - 0.08 * (page_id % 9)), 6)::double as relevance, 'title: page' || chr(10) || 'url: ' || url || chr(10) || 'snippet: of it' as content from pages")
def _(spark, d):
    rows = table(spark, d, "pages").select(F.col("page_id").alias("query_id"), (F.col("page_id") % 9 + 1).alias("rank"), F.lit("page").alias("title"), F.lit(" of it").alias("snippet"), F.lit("x.org").alias("domain"), "url")
    return context.web_references(rows).select("query_id", "chunk_id", "source", F.round(F.col("relevance").cast("double"), 6).alias("relevance"), "content")


@add("topk_diagnostics", f"with {REFS} select query_id, string_agg(modality, '|' order by rank) as modalities, bool_or(modality = 'text') and bool_or(modality = 'timeseries') as joint_coverage, string_agg(round(relevance, 3)::double::varchar, '|' order by rank) as relevances from rf where rank <= 5 group by 1")
def _(spark, d):
    rows = context.topk_diagnostics(references_of(spark, d), 5, ("relevance",), rank="rank")
    return rows.select("query_id", F.array_join("modalities", "|").alias("modalities"), "joint_coverage", F.array_join(F.transform("relevance", lambda x: x.cast("string")), "|").alias("relevances"))


@add("corrective_pass", f"""with {REFS}, g as (select query_id, avg(relevance) as mean, max(relevance) as high, count(*) as n from rf where rank <= 3 group by 1), gr as (select query_id, n >= 2 and high >= 0.78 and mean >= 0.62 as fine from g),
u as (select query_id, id, max(r) as relevance from (select query_id, id, relevance as r from rf where rank <= 3 union all select query_id, id, relevance * 1.1 from rf where rank <= 6) group by all),
m as (select u.*, row_number() over (partition by query_id order by relevance desc, id) as place from u join gr using (query_id) where not fine),
s as (select query_id, id, relevance, row_number() over (partition by query_id order by relevance desc, id) as place from rf join gr using (query_id) where fine and rank <= 3)
select query_id, id, round(relevance, 6) as relevance, place from m where place <= 6 union all select query_id, id, round(relevance, 6), place from s""")
def _(spark, d):
    from quarry.operators.references import grade

    refs = references_of(spark, d)
    first = refs.where("rank <= 3")
    asked = refs.select("query_id").distinct()
    wider = lambda q, k, threshold: refs.where(F.col("rank") <= k).join(q, "query_id", "left_semi").withColumn("relevance", F.col("relevance") * 1.1)
    return context.corrective_pass(first, grade(first), wider, asked, 3, 0.5).withColumn("relevance", F.round("relevance", 6))

