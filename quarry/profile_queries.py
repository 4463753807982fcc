"""Queries over literal questions: profiles, rewriting guards, answer policies. Each has SQL over the same values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import profiles as P
from quarry.functions import words as W
from quarry.queries import add

# question, variant, a model's rewriting of it
QUESTIONS = [
    ("2023年报名时间是什么时候？", "报名 2023", "1. 检索查询：2023年 报名安排"),
    ("计算机专业和软件工程专业的共同目标与区别分别是什么", " ", "计算机专业和软件工程专业 对比"),
    ("图片里画了什么内容？", "截图 ocr", "- 图片内容描述。"),
    ("文档中的参数配置有哪些", "", "文档参数"),
    ("北京市PM2.5浓度为什么在2024-01-03之后回落？只看空气质量", "北京市 臭氧 趋势", "北京市PM2.5 回落原因\n北京市空气质量 2024-01-03 原因；冷空气"),
    ("订单服务latency_ms异常和error_rate峰值对比", "回滚 发布", "query: latency_ms 峰值"),
    ("现任校长是谁？", "", "`现任校长`"),
    ("问题：说明书中如何拆卸螺栓？以及更换步骤", "", "拆卸螺栓步骤"),
    ("IN 和 EX 分别表示什么；A、B 含义是什么", "", "IN EX 含义"),
    ("办学理念是什么等级", "", "办学理念"),
    ("The report of 2019 and 2021", "a report", "report 2019"),
    ("", "  ", ""),
    (None, None, None),
    ("招生人数是多少人", "招生", "招生人数 多少"),
    ("既有图片又有文档的资料同时在哪里", "书籍 照片", "图片 文档"),
    ("苏州 上海 1月3日 海风与阵雨的影响", "高温 静稳", "苏州 海风"),
    ("请回答：最新开设了哪些语言课程，包括哪些专业", "", "最新 语言 课程"),
    ("序列波动", "是否同步", "序列 波动"),
    ("目前截止时间 2024 年 2 月 30 日 与 2024/2/3 的查询", "", "2024 截止"),
    ("市场营销专业与会计学专业比较", "", "会计学专业 比较"),
]
BODIES = [
    "办学理念：立德树人。共招收30人，2019年3月1日成立，被评为A级。", "校长张三负责人；开设汉语、英语、法语", "no answer in here, 2021", "招生人数为一百二十人，分别录取。", "",
]


def questions(spark: SparkSession) -> DataFrame:
    rows = [(i, *q) for i, q in enumerate(QUESTIONS)]
    made = spark.createDataFrame(rows, "query_id long, query string, variant string, rewrite string")
    return made.withColumn("bundle", F.array("query", "variant"))


def quoted(x: str | None) -> str:
    return "null" if x is None else "'" + x.replace("'", "''") + "'"


def listed(words) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def any_of(t: str, words) -> str:
    return f"len([w for w in {listed(words)} if contains({t}, w)]) > 0"


def all_of(t: str, words) -> str:
    return f"[w for w in {listed(dict.fromkeys(words))} if contains({t}, w)]"


def distinct(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


VALUES = "v(query_id, query, variant, rewrite) as (values " + ", ".join(f"({i}::bigint, {', '.join(map(quoted, q))})" for i, q in enumerate(QUESTIONS)) + ")"
PARTS = f"""{VALUES}, p as (select *, [x for x in [trim(coalesce(query, '')), trim(coalesce(variant, ''))] if x <> ''] as parts from v),
c as (select *, array_to_string(parts, ' ') as raw, lower(array_to_string(parts, ' ')) as low, lower(coalesce(parts[1], '')) as first from p)"""
SERIES = f"""{PARTS}, l as (select *, regexp_extract_all(raw, '{W.LOCATION}') as lo from c),
t as (select *, {distinct('lo')}[1:4] as locations, {all_of('low', W.SERIES_DOMAIN)} as domains, {all_of('low', W.SERIES + W.SERIES_CHANNEL + W.SERIES_DOMAIN)} as keywords,
  {any_of('low', W.SERIES_WINDOW)} as has_window, {any_of('low', W.SERIES_GUARD)} as guard, {any_of('low', W.SERIES_CAUSAL + W.SERIES_COMPARISON + W.SERIES_GUARD)} as asks from l),
ts as (select *, low <> '' and (len(keywords) > 0 or has_window or (asks and (len(locations) > 0 or len(domains) > 0))) as related from t)"""
MULTI = f"({any_of('first', W.JOINT_IMAGE)}) and (({any_of('first', W.JOINT_BOTH)}) or ({any_of('first', W.JOINT_TEXT)}))"
KIND = f"""{SERIES}, k as (select *, case when low = '' then 'none' when related then 'timeseries_related' when {MULTI} then 'multimodal_joint'
  when len([w for w in {listed(W.IMAGE)} if contains(low, w)]) > len([w for w in {listed(W.TEXT)} if contains(low, w)]) then 'image_related' else 'text_related' end as kind from ts)"""


def joined(column) -> F.Column:
    return F.array_join(column, "|")


@add("query_timeseries_profile", f"with {SERIES} select query_id, related, has_window, guard, array_to_string(keywords, '|') as keywords, array_to_string(locations, '|') as locations, array_to_string(domains, '|') as domains from ts")
def _(spark, d):
    rows = questions(spark).withColumn("t", P.timeseries(F.col("bundle")))
    return rows.select("query_id", "t.related", F.col("t.window").alias("has_window"), "t.guard", *[joined(F.col(f"t.{c}")).alias(c) for c in ("keywords", "locations", "domains")])


@add("query_joint_profile", f"""with {SERIES}, e as (select *, regexp_extract_all(raw, '{W.LOCATION_ELSE}') as le, regexp_extract_all(low, '{W.CHANNEL}') as ch from ts),
j as (select *, case when len(locations) > 0 then locations else {distinct('le')}[1:4] end as places, {all_of('raw', W.EVENTS)}[1:5] as events, {distinct('ch')}[1:6] as channels,
  related or {any_of('raw', W.TREND)} as series, {any_of('raw', W.BACKGROUND)} as background from e)
select query_id, (series and background) or (guard and (series or background)) or (series and (len(places) > 0 or len(domains) > 0 or len(events) > 0) and {any_of('raw', W.JOINT_WHY)}) as is_joint,
  series, background, array_to_string(places, '|') as places, array_to_string(events, '|') as events, array_to_string(channels, '|') as channels from j""")
def _(spark, d):
    rows = questions(spark).withColumn("j", P.joint(F.col("bundle")))
    return rows.select("query_id", F.col("j.joint").alias("is_joint"), "j.series", "j.background", joined(F.col("j.locations")).alias("places"), joined(F.col("j.events")).alias("events"), joined(F.col("j.channels")).alias("channels"))


def bonus_sql(table: dict, key: str, value: str) -> str:
    return "case " + " ".join(f"when kind = {quoted(k)} and {value} = {quoted(m)} then {b}" for k, e in table.items() for m, b in e.items()) + " else 0.0 end"


@add("query_modality_profile", f"""with {KIND} select query_id, kind, {bonus_sql(W.MODALITY_BONUS, 'kind', "'vision'")}::double as vision_bonus, {bonus_sql(W.EXTENSION_BONUS, 'kind', "'.png'")}::double as png_bonus,
  case {' '.join(f"when kind = {quoted(k)} then {quoted('|'.join(v))}" for k, v in W.PREFERRED.items())} end as preferred,
  case {' '.join(f"when kind = {quoted(k)} then {quoted('|'.join(v))}" for k, v in W.REQUIRED.items())} else '' end as required,
  case kind when 'multimodal_joint' then greatest(10, 7 * 4, 12) when 'image_related' then greatest(10, 7 * 3, 10) else 10 end::int as cutoff,
  case {' '.join(f"when kind = {quoted(k)} then {quoted('|'.join(v))}" for k, v in W.PATH_HINTS.items())} when kind = 'none' then ''
    else array_to_string({distinct("flatten([regexp_extract_all(x, '[一-鿿]{2,}') for x in parts])")}[1:8], '|') end as hints from k""")
def _(spark, d):
    rows = questions(spark).withColumn("kind", P.kind(F.col("bundle")))
    k = F.col("kind")
    return rows.select(
        "query_id", "kind", P.modality_bonus(k, F.lit("vision")).alias("vision_bonus"), P.extension_bonus(k, F.lit(".PNG")).alias("png_bonus"),
        joined(P.preferred_modalities(k)).alias("preferred"), joined(P.required_modalities(k)).alias("required"), P.rerank_cutoff(k, F.lit(7)).alias("cutoff"), joined(P.path_hints(F.col("bundle"), k)).alias("hints"),
    )


def more_sql(x: str) -> str:
    suffixes = ", ".join(f"{x} || ' {s}'" for s in W.IMAGE_SUFFIXES[:3])
    return f"case when {any_of(f'lower({x})', W.IMAGE_SUFFIXES)} then []::varchar[] else [{suffixes}] || case when kind = 'multimodal_joint' then [{x} || ' 文档内容', {x} || ' 图片内容'] else []::varchar[] end end"


@add("query_bundle", f"""with {KIND}, b as (select *, {distinct('parts')} as base from k),
w as (select *, base || case when kind in ('image_related', 'multimodal_joint') then case when len(base) > 0 then {more_sql('base[1]')} else []::varchar[] end || case when len(base) > 1 then {more_sql('base[2]')} else []::varchar[] end else []::varchar[] end as every from b)
select query_id, len({distinct('every')})::int as n, array_to_string({distinct('every')}, '|') as queries from w""")
def _(spark, d):
    rows = questions(spark).withColumn("q", P.query_bundle(F.col("bundle"), P.kind(F.col("bundle"))))
    return rows.select("query_id", F.size("q").alias("n"), joined(F.col("q")).alias("queries"))


YEARS = "regexp_extract_all(regexp_replace({t}, '(\\d+)', ' \\1 ', 'g'), ' ((?:19|20)\\d\\d) ', 1)"
DAYS = "list_sort([date_diff('day', date '0001-01-01', x) + 1 for x in [try_cast(regexp_extract_all(y, '\\d+')[1] || '-' || lpad(regexp_extract_all(y, '\\d+')[2], 2, '0') || '-' || lpad(regexp_extract_all(y, '\\d+')[3], 2, '0') as date) for y in regexp_extract_all({t}, '(?:19|20)\\d{{2}}\\s*[-/.年]\\s*\\d{{1,2}}\\s*[-/.月]\\s*\\d{{1,2}}')] if x is not null])"
TEMPORAL = f"""{KIND}, y as (select *, list_sort(list_distinct({YEARS.format(t='low')})) as ys, {DAYS.format(t='low')} as days, {any_of('low', W.RECENT)} as recent,
  regexp_matches(low, '\\d{{1,2}}\\s*月\\s*\\d{{1,2}}\\s*(日|号)') as month_day from k),
te as (select *, recent or len(ys) > 0 or len(days) > 0 or month_day or {any_of('low', W.TEMPORAL)} as temporal, ({any_of('low', W.MULTI_DOC)}) and ({any_of('low', W.CONNECTORS)}) as diverse,
  first <> '' and {any_of('first', W.SEEKING)} as seeks from y)"""


@add("query_temporal_profile", f"with {TEMPORAL} select query_id, temporal, recent, array_to_string(ys, '|') as years, array_to_string(list_distinct(days), '|') as days from te")
def _(spark, d):
    rows = questions(spark).withColumn("t", P.temporal(F.col("bundle")))
    return rows.select("query_id", "t.temporal", "t.recent", *[joined(F.transform(F.col(f"t.{c}"), lambda x: x.cast("string"))).alias(c) for c in ("years", "days")])


COUNT = " + ".join(f"((length(first) - length(replace(first, '{w}', ''))) / {len(w)})::int" for w in W.CONNECTORS)


@add("query_routing", f"""with {TEMPORAL} select query_id, diverse, seeks, case when temporal then 'temporal' when diverse then 'multi_doc' when seeks then 'answer_focused' when kind = 'none' then 'text_related' else kind end as route,
  seeks and not ({any_of('first', W.TEMPORAL + W.RECENT)}) and not ({any_of('first', W.MULTI_DOC)}) and {COUNT} < 2 and {any_of('first', W.LABELS + ('语言',) + W.EXTRACTIVE)} as sentences from te""")
def _(spark, d):
    b = F.col("bundle")
    rows = questions(spark).withColumn("kind", P.kind(b))
    return rows.select("query_id", P.diverse(b).alias("diverse"), P.seeks_answer(P.primary(b)).alias("seeks"), P.model_route(b, F.col("kind")).alias("route"), P.uses_sentences(b).alias("sentences"))


CLEAN = f"""{VALUES}, o as (select query_id, trim(coalesce(query, '')) as o, trim(regexp_extract(trim(coalesce(rewrite, ''), ' `'), '^([^\\n\\r]*)', 1)) as r0 from v),
r1 as (select *, trim(regexp_replace(r0, '^(?:[-*]\\s*|\\d+[.)]\\s*|[一二三四五六七八九十]+[、.]\\s*)', '')) as a from o),
r as (select *, trim(trim(regexp_replace(a, '^(?:{"|".join(W.QUERY_PREFIXES)})', '')), '。 ') as c from r1)"""
KEEP = f"""{CLEAN}, kw as (select *, {distinct(f"({YEARS.format(t='o')})")} as ys, {all_of('o', W.SLOTS)} as slots, {all_of('o', W.RECENT)} as recent, [w for w in {listed(W.KEPT)} if contains(o, w) and not contains(c, w)] as missing from r),
ad as (select *, case when len(slots) > 0 and len([w for w in slots if contains(c, w)]) = 0 then [slots[1]] else []::varchar[] end || case when len(recent) > 0 and len([w for w in recent if contains(c, w)]) = 0 then [recent[1]] else []::varchar[] end as f from kw),
al as (select *, f || missing[1:greatest(1, 2 - len(f))] as added from ad),
tm as (select *, case when c = '' or o = '' then c when len([y for y in ys if not contains(c, y)]) > 0 then '' when len(added) > 0
  then array_to_string(list_filter(string_split_regex(c || ' ' || array_to_string(added, ' '), '\\s+'), lambda x, i: list_position(string_split_regex(c || ' ' || array_to_string(added, ' '), '\\s+'), x) = i), ' ') else c end as timed from al)"""


@add("rewrite_sanitise", f"with {CLEAN} select query_id, c as clean from r")
def _(spark, d):
    return questions(spark).select("query_id", P.sanitised_rewrite(F.col("rewrite")).alias("clean"))


@add("rewrite_keeps_times", f"with {KEEP} select query_id, timed from tm")
def _(spark, d):
    return questions(spark).select("query_id", P.keep_times(P.sanitised_rewrite(F.col("rewrite")), F.col("query")).alias("timed"))


MARKS = " ，,。；;？?"
ENTITIES = f"""{KEEP}, pr as (select *, case when contains(o, '专业') then regexp_extract(o, '^(?s)(.*?)专业', 1) else '' end as prefix from tm),
lr as (select *, trim(regexp_extract(prefix, '^(?s)(.*?)(?:与|和|及|以及)', 1), '{MARKS}') as le, trim(regexp_extract(prefix, '^(?s).*?(?:与|和|及|以及)(.*)$', 1), '{MARKS}') as ri, regexp_extract_all(o, '[一-鿿A-Za-z0-9]+?专业') as nm from pr),
en as (select *, case when le <> '' and ri <> '' then list_distinct([le || '专业', ri || '专业']) else {distinct('nm')}[1:2] end as pair from lr),
ce as (select *, case when {any_of('o', W.COMPARING)} and {any_of('o', W.RELATING)} and contains(o, '专业') and len(pair) >= 2 then list_sort(pair) else []::varchar[] end as entities from en)"""


@add("rewrite_guard", f"with {ENTITIES} select query_id, array_to_string(entities, '|') as entities, case when len([e for e in entities if not contains(timed, e)]) > 0 then '' when length(timed) > greatest(96, 2 * length(o)) then '' else timed end as accepted from ce")
def _(spark, d):
    q = questions(spark)
    return q.select("query_id", joined(F.array_sort(P.compared_entities(F.col("query")))).alias("entities"), P.accepted_rewrite(F.col("rewrite"), F.col("query")).alias("accepted"))


LAST = "greatest(" + ", ".join(f"case when contains(w, '{m}') then length(w) - position('{m[::-1]}' in reverse(w)) + 2 else 0 end" for m in W.QUESTION_MARKS) + ")"
POLICY = f"""{VALUES}, wq as (select query_id, trim(coalesce(query, '')) as w from v), lq as (select *, coalesce(nullif(trim(substr(w, {LAST}::bigint)), ''), w) as q from wq)"""


def parts_sql(t: str) -> str:
    cuts = f"[y for y in [trim(x, '{MARKS}') for x in string_split_regex({t}, '[；;。\\n]')] if y <> '']"
    joins = " || ".join(f"case when contains(s, '{j}') then [trim(z, '{MARKS}') for z in string_split(s, '{j}')] else []::varchar[] end" for j in W.REQUIREMENT_JOINS)
    return f"list_filter(flatten([[s] || {joins} for s in {cuts}]), lambda x: x <> '')"


@add("answer_policy", f"""with {POLICY}, rq as (select *, len(list_distinct({parts_sql('w')}))::int as requirements, len(list_distinct({parts_sql('q')})) as own from lq)
select query_id, requirements, q <> '' and own <= 1 and {any_of('q', W.DIRECT)} as direct, q <> '' and {any_of('q', W.ANSWER_RELATING)} and {any_of('q', W.ANSWER_COMPARING)} and {any_of('q', W.ENTITIES)} as comparative,
  q <> '' and {any_of('q', W.PROCEDURAL)} as procedural, q <> '' and {any_of('q', W.NUMERIC)} as numeric, q <> '' and ({any_of('q', W.MEANING)} or len({all_of('upper(q)', W.SYMBOLS)}) >= 2) as symbols, q as question from rq""")
def _(spark, d):
    rows = questions(spark).withColumn("p", P.answer_policy(F.col("query")))
    return rows.select("query_id", "p.*", P.last_question(F.col("query")).alias("question"))


@add("requirement_parts", f"with {POLICY}, rq as (select *, {parts_sql('w')} as every from lq) select query_id, array_to_string({distinct('every')}, '|') as parts from rq")
def _(spark, d):
    return questions(spark).select("query_id", joined(P.requirement_parts(F.col("query"))).alias("parts"))


BODY_SQL = "bo(body_id, body) as (values " + ", ".join(f"({i}::bigint, {quoted(b)})" for i, b in enumerate(BODIES)) + ")"


@add("answer_support", f"""with {VALUES}, {BODY_SQL}, x as (select query_id, lower(trim(coalesce(query, ''))) as q, body_id, body, lower(body) as low, {all_of("lower(trim(coalesce(query, '')))", W.LABELS)}[1] as label from v, bo)
select query_id, body_id, round(case when q <> '' and {any_of('q', W.SEEKING)} then least(0.14,
  case when label is not null and len([m for m in ['：', ':', '是', '为'] if contains(low, label || m)]) > 0 then 0.06 else 0 end
  + case when {any_of('q', W.HOW_MANY)} and regexp_matches(body, '{W.AMOUNT}') then 0.05 else 0 end
  + case when {any_of('q', W.WHEN)} and len({YEARS.format(t='body')}) > 0 then 0.05 else 0 end
  + case when contains(q, '等级') and regexp_matches(body, '{W.GRADE}') then 0.05 + case when {any_of('low', W.RATED)} then 0.03 else 0 end else 0 end
  + case when {any_of('q', W.WHO)} and {any_of('body', W.ROLES)} then 0.05 else 0 end
  + case when contains(q, '语言') and len({all_of('body', W.LANGUAGES)}) >= 2 then 0.06 else 0 end
  + case when {any_of('q', W.LISTING)} and {any_of('body', W.LIST_MARKS)} then 0.03 else 0 end) else 0 end, 6)::double as support from x""")
def _(spark, d):
    bodies = spark.createDataFrame(list(enumerate(BODIES)), "body_id long, body string")
    pairs = questions(spark).join(F.broadcast(bodies), how="cross")  # literal rows
    return pairs.select("query_id", "body_id", F.round(P.answer_support(F.col("query"), F.col("body")), 6).alias("support"))


PROMPT_SQL = f"case when w = '' then case when n >= 5 then 5 else 3 end when {any_of('low', W.MULTI_PART)} then 5 when {any_of('low', W.SINGLE_FACT)} then 3 when n >= 5 then 5 else 3 end::int"


@add("prompt_limits", f"with {POLICY}, n as (select *, query_id % 7 as n, lower(w) as low from lq) select query_id, {PROMPT_SQL} as references_shown from n")
def _(spark, d):
    return questions(spark).select("query_id", P.reference_limit(F.col("query"), F.col("query_id") % 7).alias("references_shown"))
