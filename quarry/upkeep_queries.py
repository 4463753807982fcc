"""Queries of lifecycles, memory, passages, key matches and questions of cases, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import evaluate, lexical, lifecycle, memory, passages, split
from quarry.profile_queries import VALUES, questions
from quarry.queries import BUNDLE_SQL, add, bundle, docs_of, table, topk

TTL = 180
LIFE = f"ma as (select user_id, min(ts) as created, min(ts) + interval {TTL} minutes as expires, user_id % 2 = 0 as touch from events group by 1)"


def manifests(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("knowledge_id")).agg(F.min("ts").alias("created_at"))
    expires = F.col("created_at") + F.expr(f"interval {TTL} minutes")
    return rows.withColumns({"ttl_minutes": F.lit(TTL), "expires_at": expires, "touch_on_access": F.col("knowledge_id") % 2 == 0, "cleanup_state": F.lit("active")})


@add("ttl_access", f"""with {LIFE}, l as (select e.user_id as knowledge_id, ts as "at", touch, expires, case when touch and lag(ts) over w is not null then lag(ts) over w + interval {TTL} minutes else expires end <= ts as late from events e join ma using (user_id) window w as (partition by e.user_id order by ts)),
g as (select *, coalesce(sum(late::int) over (partition by knowledge_id order by "at" rows between unbounded preceding and 1 preceding), 0) > 0 as dead from l)
select knowledge_id, "at", case when dead then 'gone' when late then 'expired_on_access' else 'ok' end as status, case when dead or late then null when touch then "at" + interval {TTL} minutes else expires end as expires_at from g""")
def _(spark, d):
    accesses = table(spark, d, "events").select(F.col("user_id").alias("knowledge_id"), F.col("ts").alias("at"))
    return lifecycle.access(manifests(spark, d), accesses)


@add("ttl_cleanup", f"with {LIFE} select user_id as knowledge_id, expires <= timestamp '2024-01-10 00:00:00' as expired, expires <= timestamp '2024-01-10 00:00:00' as removed, case when expires <= timestamp '2024-01-10 00:00:00' then 'expired' else 'not_expired' end as reason from ma")
def _(spark, d):
    return lifecycle.clean_up(manifests(spark, d), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))


COSINE = "round(list_dot_product(v, q) / ((sqrt(list_dot_product(v, v)) + 1e-9) * (sqrt(list_dot_product(q, q)) + 1e-9)), 6)"


@add("memory_recall", f"""with e as (select label as session, vec_id, embedding::double[] as v from embeddings), a as (select session, arg_min(v, vec_id) as q from e group by 1),
f as (select session, 'f' || vec_id as fact, 'e' || (vec_id + 1) as ep, {COSINE} as near from (select e.session, vec_id, v, q from e join a on e.session = a.session)), k as (select * from (select *, row_number() over (partition by session order by near desc, fact) as n from f) where n <= 5),
o as (select e.session, 'e' || vec_id as ep, {COSINE} as near, exists (select 1 from k where k.session = e.session and k.ep = 'e' || vec_id) as met from e join a on e.session = a.session),
p as (select * from (select *, row_number() over (partition by session order by (not met)::int, near desc, ep) as n from o) where n <= 3),
kf as (select session, string_agg(fact, '|' order by n) as facts, string_agg('- ' || fact, chr(10) order by n) as fl from k group by 1), pe as (select session, string_agg(ep, '|' order by n) as episodes, string_agg('- [talk (' || ep || ')] about ' || ep, chr(10) order by n) as el from p group by 1)
select session, facts, episodes, 0 as turns, '语义层事实：' || chr(10) || fl || chr(10) || chr(10) || '相关会话摘要：' || chr(10) || el as memory from kf join pe using (session)""")
def _(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("label").alias("session"), "vec_id", F.col("embedding").alias("v"))
    name = lambda n: F.concat(F.lit("e"), n.cast("string"))
    facts = rows.select("session", F.concat(F.lit("f"), F.col("vec_id").cast("string")).alias("fact"), name(F.col("vec_id") + 1).alias("episode_id"), "v")
    told = rows.select("session", name(F.col("vec_id")).alias("episode_id"), F.lit("talk").alias("title"), F.concat(F.lit("about "), name(F.col("vec_id"))).alias("summary"), "v")
    asked = rows.groupBy("session").agg(F.min_by("v", "vec_id").alias("v"))
    return memory.recall(asked, facts, told)


SCANNED = "ps as (select doc_id::varchar || chr(9) || source as doc_key, doc_id, source as title, i - 1 as psg_id, trim(regexp_replace(p[i], '\\s+', ' ', 'g')) as contents from (select doc_id, source, string_split(text, chr(10)) as p from documents where text is not null), unnest(generate_series(1, len(p))) t(i))"


def scanned(spark: SparkSession, d: str) -> DataFrame:
    docs = docs_of(spark, d).where("text is not null").select(F.col("doc_id").alias("id"), F.col("source").alias("url"), F.col("source").alias("title"), F.lit(None).cast("string").alias("date"), F.split("text", "\n", -1).alias("passages"))
    return passages.scan_passages(docs)


@add("passage_scan", f"with {SCANNED} select doc_key, title, psg_id::int as psg_id, contents from ps")
def _(spark, d):
    return scanned(spark, d).select("doc_key", "title", "psg_id", "contents")


@add("passage_bm25_topk", f"""with {SCANNED}, {BUNDLE_SQL}, tk as (select doc_id * 100000 + psg_id as doc_id, regexp_extract_all(title || '。' || contents, '[A-Za-z0-9_]+') as t from ps), dl as (select doc_id, len(t) as dl from tk),
tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(t) as term from tk) group by all), df as (select term, count(*) as df from tf group by 1), st as (select count(*) as n, avg(dl) as avgdl from dl),
r as (select term, ln(n - df + 0.5) - ln(df + 0.5) as raw from df, st), e as (select avg(raw) as mean from r), q as (select query_id, term, count(*) as times from (select query_id, unnest(regexp_extract_all(query, '[A-Za-z0-9_]+')) as term from b) group by all),
s as (select query_id, doc_id, sum(times * case when raw < 0 then 0.25 * mean else raw end * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))) as score from tf join q using (term) join r using (term) join dl using (doc_id), st, e group by all)
{topk('s', 20)}""")
def _(spark, d):
    rows = scanned(spark, d).withColumn("id", F.regexp_extract("doc_key", "^([^\t]*)", 1).cast("long") * 100000 + F.col("psg_id"))
    return lexical.top(passages.passage_bm25(rows, bundle(spark), passages.passage_text()), 20, "query_id").withColumnRenamed("id", "doc_id")


@add("eval_key_hits", """with r as (select lang, source, row_number() over (partition by lang order by n_chars desc, doc_id) as rank from documents), e as (select distinct lang, source from documents),
h as (select e.lang, e.source, min(rank) as rank from e left join r on e.lang = r.lang and lower(e.source) = lower(r.source) and rank <= 5 group by all)
select lang as query_id, coalesce(min(rank) <= 1, false) as hit_top1, coalesce(min(rank) <= 3, false) as hit_top3, coalesce(min(rank) <= 5, false) as hit_top5, count(rank) as matched, count(rank) >= count(*) as all_covered from h group by 1""")
def _(spark, d):
    docs = docs_of(spark, d)
    none = F.lit(None).cast("string")
    run = docs.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")))
    run = run.select(F.col("lang").alias("query_id"), "rank", evaluate.sample_keys(none, F.upper("source"), none).alias("keys"))
    expected = docs.select(F.col("lang").alias("query_id"), F.col("source").alias("expected_id")).distinct()
    expected = expected.withColumn("keys", evaluate.sample_keys(none, F.col("expected_id"), none))
    return evaluate.expected_hits(evaluate.key_hits(run, expected))


@add("case_queries", f"""with {VALUES}, c as (select query_id, trim(regexp_replace(coalesce(query, ''), '\\s+', ' ', 'g')) as q, trim(regexp_replace(coalesce(variant, ''), '\\s+', ' ', 'g')) as e, coalesce(query, '') as raw, trim(coalesce(variant, '')) as h from v)
select query_id, case when q <> '' and e <> '' then e || chr(10) || q when q <> '' then q else e end as asked, trim(regexp_replace('2024年 ' || raw, '\\s+', ' ', 'g')) as timed, trim(regexp_replace(h || ' ' || raw, '\\s+', ' ', 'g')) as talk from c""")
def _(spark, d):
    q, none = questions(spark), F.lit(None).cast("string")
    task = lambda name, date, history: evaluate.task_query(F.lit(name), F.col("query"), date, history)
    past = F.array("variant")
    return q.select("query_id", evaluate.case_query(none, F.col("variant"), F.col("query")).alias("asked"), task("time", F.lit("2024"), past).alias("timed"), task("conversation", none, past).alias("talk"))


@add("chunk_by_kind")
def _(spark, d):
    kind = F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "de", ".PDF").otherwise(".txt")
    return split.chunk_by_kind(docs_of(spark, d).withColumn("extension", kind), 400, 80)


@add("sentence_entries")
def _(spark, d):
    return split.sentence_entries(split.chunk_documents(docs_of(spark, d), 400, 80).select(F.concat_ws("-", "doc_id", "pos").alias("chunk_id"), F.col("chunk").alias("text"), F.lit("text").alias("source_modality")), 12, 220, 12)
