"""Reranking by features, group adjustments, selection and diversity. Ranked tables have query_id, id and a score."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.profiles import answer_support, literal_array, seeks_answer
from quarry.functions.text import match_terms, normalize_search, overlap_ratio, rerank_text, strip, text

from .fusion import highest
from .split import answer_segments

TOP_OF_GROUP, TRIM_COUNT, TRIM_DOMINANCE = 3, 3, 0.15


def heuristic_rerank(candidates: DataFrame, query: str = "query", text: str = "text", source: str = "source") -> DataFrame:
    """Adds overlap, rerank_score and relevance to fused candidates that carry the query and the text."""
    wanted, body = F.array_distinct(match_terms(F.col(query))), F.col(text)
    normal = normalize_search(F.col(query))
    plain = F.lower(strip(F.col(query)))
    share = lambda c: F.col(c) / highest(c, "query_id")
    rows = candidates.withColumns(
        {
            "overlap": overlap_ratio(match_terms(body), wanted),
            "phrase": F.when((plain != "") & F.contains(F.lower(body), plain), 1.0).otherwise(0.0),
            "normal": F.when((normal != "") & F.contains(normalize_search(body), normal), 1.0).otherwise(0.0),
            "in_source": F.when(F.exists(wanted, lambda t: (F.length(t) >= 2) & F.contains(F.lower(F.col(source)), t)), 0.4).otherwise(0.0),
            "_f": share("fused_score"),
            "_d": share("dense_relevance"),
            "_l": share("lexical_score"),
        }
    )
    c = F.col
    score = 0.35 * c("_f") + 0.25 * c("_d") + 0.20 * c("_l") + 0.16 * c("overlap") + 0.06 * c("phrase") + 0.10 * c("normal") + 0.04 * c("in_source")
    relevance = c("dense_relevance") + 0.22 * c("_l") + 0.26 * c("overlap") + 0.10 * c("phrase") + 0.15 * c("normal") + 0.05 * c("in_source")
    return rows.withColumn("rerank_score", score).withColumn("relevance", F.greatest(F.lit(-0.25), F.least(F.lit(1.0), relevance))).drop("_f", "_d", "_l")


def with_window(rows: DataFrame, out: str, query: Column, body: Column, wanted: Column, most: int, settled: int, least: float, support: float = 1.0, mark: str = "\n") -> DataFrame:
    """Adds out: the part of a text that answers best. It begins as the segment with the best score (shared terms and
    support of an answer), and takes in the better of its two neighbours until most characters are reached, or from
    settled characters on until the neighbour is worthless or too long. The whole text where no segment reaches least."""
    keep = rows.columns
    rows = rows.withColumns({"_body": strip(text(body)), "_seg": answer_segments(body)})
    score = lambda x: overlap_ratio(match_terms(x), wanted) + support * answer_support(query, x)
    rows = rows.withColumn("_sc", F.transform("_seg", score))
    rows = rows.withColumn("_at", F.coalesce(F.array_position("_sc", F.array_max("_sc")), F.lit(0)).cast("int"))
    size, at = F.size("_seg"), F.col("_at")

    def grow(s: Column, _: Column) -> Column:
        left, right = s["l"] - 1, s["r"] + 1
        a, b = (F.when(i.between(1, size), F.get("_sc", i - 1)) for i in (left, right))
        to_left = F.coalesce((a > b) | ((a == b) & (at - left <= right - at)), a.isNotNull())
        value = F.coalesce(F.when(to_left, a).otherwise(b), F.lit(-1.0))
        wide = s["n"] + F.length(F.get("_seg", F.when(to_left, left).otherwise(right) - 1)) + 1
        stop = s["done"] | (s["n"] >= most) | (value < 0) | ((s["n"] >= settled) & ((value <= 0) | (wide > most)))
        return F.when(stop, F.struct(s["l"].alias("l"), s["r"].alias("r"), s["n"].alias("n"), F.lit(True).alias("done"))).otherwise(
            F.struct(F.when(to_left, left).otherwise(s["l"]).alias("l"), F.when(to_left, s["r"]).otherwise(right).alias("r"), wide.alias("n"), F.lit(False).alias("done"))
        )

    start = F.struct(at.alias("l"), at.alias("r"), F.coalesce(F.length(F.get("_seg", at - 1)), F.lit(0)).alias("n"), F.lit(False).alias("done"))
    rows = rows.withColumn("_w", F.when(size > 1, F.aggregate(F.slice("_seg", F.lit(2), size), start, grow)).otherwise(start))
    window = F.array_join(F.slice("_seg", F.col("_w.l"), F.col("_w.r") - F.col("_w.l") + 1), mark)
    return rows.withColumn(out, F.when((at > 0) & (F.array_max("_sc") >= least), window).otherwise(F.col("_body"))).select(*keep, out)


JOINT_FIELDS = ("location_match", "channel_match", "event_match", "coverage_bonus", "same_group", "temporal_match")


def with_joint_features(candidates: DataFrame, profile: str = "joint", group: str | None = None) -> DataFrame:
    """Adds what a candidate shares with the places, channels, events and domains of a question (a profile struct), and what
    it adds to a joint answer. Candidates have text, source_modality, and may have title, source, location, event_type,
    channel_names and temporal_bonus; group: with the two best groups of the query in place 1 and 2, by group_place."""
    get = lambda name: text(F.col(name)) if name in candidates.columns else F.lit("")
    p, body, c = F.col(profile), F.lower(text("text")), F.col
    near = lambda *names: F.lower(F.concat_ws(" ", *[strip(get(n)) for n in names]))
    channels = F.transform(F.coalesce(c("channel_names"), literal_array(())), lambda x: F.lower(strip(x))) if "channel_names" in candidates.columns else literal_array(())

    def share(terms: Column, field: Column) -> Column:
        found = F.size(F.filter(terms, lambda t: F.contains(field, F.lower(t)) | F.contains(body, F.lower(t))))
        return F.when(F.size(terms) > 0, found / F.size(terms)).otherwise(0.0)

    own_channels = F.size(F.filter(p["channels"], lambda t: F.array_contains(channels, F.lower(t)) | F.contains(body, F.lower(t))))
    place = F.when(F.exists(p["locations"], lambda t: F.contains(near("location", "title", "source"), F.lower(t)) | F.contains(body, F.lower(t))), 1.0).otherwise(0.0)
    rows = candidates.withColumns(
        {
            "location_match": F.when(F.size(p["locations"]) > 0, place).otherwise(0.0),
            "channel_match": F.when(F.size(p["channels"]) > 0, own_channels / F.size(p["channels"])).otherwise(0.0),
            "event_match": share(p["events"], near("event_type", "title", "source")),
            "domain_match": share(p["domains"], near("event_type", "title", "source", "location")),
            "same_group": F.coalesce((c("group_place") <= 2).cast("double"), F.lit(0.0)) if group else F.lit(0.0),
            "temporal_match": F.greatest(F.lit(0.0), c("temporal_bonus")) if "temporal_bonus" in candidates.columns else F.lit(0.0),
        }
    )
    series, plain = c("source_modality") == "timeseries", c("source_modality") == "text"
    one = lambda rule, points: F.when(rule, points).otherwise(0.0)
    miss = lambda name, terms, series_only: (c(name) <= 0) & (F.size(p[terms]) > 0) & (series if series_only else F.lit(True))
    bonus = (
        one(series & p["series"], 0.07) + one(plain & p["background"], 0.06) + one(p["window"], 0.015) + one(p["guard"] & series, 0.05)
        + one(c("location_match") > 0, 0.04) - one(miss("location_match", "locations", False), F.when(series, 0.05).otherwise(0.03))
        + one(c("domain_match") > 0, 0.04) - one(miss("domain_match", "domains", False), F.when(series, 0.05).otherwise(0.03))
        + one(c("event_match") > 0, 0.02) - one(miss("event_match", "events", True), 0.03)
        + one(c("channel_match") > 0, 0.02) - one(miss("channel_match", "channels", True), 0.02)
        - one(p["guard"] & series & ((c("location_match") <= 0) | (c("domain_match") <= 0)) & ((F.size(p["locations"]) > 0) | (F.size(p["domains"]) > 0)), 0.04)
    )
    return rows.withColumn("coverage_bonus", F.when(p["joint"], bonus).otherwise(0.0))


def joint_boost(score: Column, profile: Column, modality: Column) -> Column:
    """A little for the two kinds of text that a joint question needs."""
    fits = ((modality == "timeseries") & profile["series"]) | ((modality == "text") & profile["background"])
    return score + F.when(profile["joint"] & fits, 0.015).otherwise(0.0)


def select_joint(ranked: DataFrame, k: int, rank: str = "rank", joint: str = "is_joint", modality: str = "source_modality") -> DataFrame:
    """Of a joint question with both kinds of rows, the best text and the best series first, then the others by rank."""
    own = F.row_number().over(Window.partitionBy("query_id", modality).orderBy(rank))
    every = Window.partitionBy("query_id")
    both = (F.max((F.col(modality) == "text").cast("int")).over(every) + F.max((F.col(modality) == "timeseries").cast("int")).over(every)) == 2
    rows = ranked.withColumn("_p", F.when(F.col(joint) & both & F.col(modality).isin("text", "timeseries") & (own == 1), 0).otherwise(1))
    return rows.withColumn("place", F.row_number().over(every.orderBy("_p", rank))).where(F.col("place") <= k).drop("_p")


def full_rerank(candidates: DataFrame, query: str = "query", body: str = "text", search: str | None = None, enabled: bool = True) -> DataFrame:
    """Adds rerank_score, relevance and answer_focus to fused candidates, from all features that they have: shares of terms in
    the search text, the text and the part that answers, phrases, source, support, bonuses by modality and time, joint
    features. Columns that are used where they are there: title, source, sentence, modality_bonus, temporal_bonus, JOINT_FIELDS."""
    get = lambda name, other: F.coalesce(F.col(name), other) if name in candidates.columns else other
    zero, low = F.lit(0.0), F.lower(strip(text(query)))
    keep = candidates.columns
    rows = candidates.withColumns({"_q": low, "_wanted": F.array_distinct(match_terms(F.col(query))), "_search": text(search or body), "_text": text(body)})
    rows = with_window(rows, "_window", F.col("_q"), F.col("_text"), F.col("_wanted"), 320, 160, 0.08)
    hint = strip(text("sentence")) if "sentence" in candidates.columns else F.lit("")
    focused = F.when(seeks_answer(F.col("_q")), F.col("_window")).otherwise(strip(F.col("_text")))
    parted = F.concat_ws("\n", hint, F.when((focused != "") & (focused != F.col("_text")), focused))
    rows = rows.withColumn("_answer", F.when(hint != "", parted).otherwise(focused))
    c, share = F.col, lambda name: F.col(name) / highest(name, "query_id")
    source = F.lower(F.concat_ws(" ", get("title", F.lit("")), get("source", F.lit(""))))
    normal = normalize_search(F.col(query))
    rows = rows.withColumns(
        {
            "_o": overlap_ratio(match_terms(c("_search")), c("_wanted")),
            "_b": overlap_ratio(match_terms(c("_text")), c("_wanted")),
            "_a": F.when((c("_answer") != "") & (c("_answer") != c("_text")), overlap_ratio(match_terms(c("_answer")), c("_wanted"))).otherwise(0.0),
            "_p": F.when((c("_q") != "") & F.contains(F.lower("_search"), c("_q")), 1.0).otherwise(0.0),
            "_n": F.when((normal != "") & F.contains(normalize_search(c("_search")), normal), 1.0).otherwise(0.0),
            "_s": F.when(F.exists("_wanted", lambda t: (F.length(t) >= 2) & F.contains(source, t)), 0.4).otherwise(0.0),
            "_u": answer_support(c("_q"), c("_answer")),
            "_f": share("fused_score"),
            "_d": share("dense_relevance"),
            "_l": share("lexical_score"),
        }
    )
    temporal = get("temporal_bonus", zero)
    joint = {name: get(name, zero) for name in JOINT_FIELDS}
    if enabled:
        score = 0.35 * c("_f") + 0.25 * c("_d") + 0.20 * c("_l") + 0.10 * c("_o") + 0.06 * c("_b") + 0.05 * c("_a") + 0.06 * c("_p") + 0.10 * c("_n") + 0.04 * c("_s")
        matches = 0.05 * joint["temporal_match"] + 0.04 * (joint["event_match"] + joint["location_match"] + joint["channel_match"]) + 0.03 * joint["same_group"]
    else:
        score = 0.55 * c("_f") + 0.30 * c("_d") + 0.15 * c("_l") + 0.04 * c("_b") + 0.04 * c("_a")
        matches = 0.03 * joint["temporal_match"] + 0.02 * (joint["event_match"] + joint["location_match"] + joint["channel_match"])
    score = score + c("_u") + get("modality_bonus", zero) + temporal + matches + joint["coverage_bonus"]
    relevance = c("dense_relevance") + 0.22 * c("_l") + 0.18 * c("_o") + 0.08 * c("_b") + 0.08 * c("_a") + 0.10 * c("_p") + 0.15 * c("_n") + 0.05 * c("_s") + 0.50 * c("_u")
    relevance = F.greatest(F.lit(-0.25), F.least(F.lit(1.0), F.least(F.lit(1.0), relevance) + temporal))
    focus = F.least(F.lit(1.0), 0.35 * c("_b") + 0.45 * c("_a") + 1.80 * c("_u") + F.when(hint != "", 0.10).otherwise(0.0))
    return rows.select(*keep, score.alias("rerank_score"), relevance.alias("relevance"), focus.alias("answer_focus"))


# fixed values: names of kinds of content and modalities in a model's input
CONTENT_NAMES = {
    "document_text": "文档正文", "image_evidence": "图像证据", "image_region_evidence": "图像区域证据", "instruction_text_evidence": "操作说明文本",
    "instruction_parts_evidence": "零件清单", "instruction_figure_evidence": "图示说明", "instruction_arrow_evidence": "图示标注", "web_search_result": "网络结果",
}
MODALITY_NAMES = {"text": "文本证据", "ocr": "OCR 文本", "vision": "视觉描述", "image": "图像内容", "ocr+vision": "图文联合证据"}


def with_model_text(rows: DataFrame, out: str = "model_text", query: str = "query", body: str = "text") -> DataFrame:
    """Adds what a reranking model reads: title, kind, section, date, summary, hit sentence and the best part of the text, each
    on a line with its label."""
    get = lambda name, n: rerank_text(F.col(name), n) if name in rows.columns else F.lit("")
    keep, wanted = rows.columns, F.array_distinct(match_terms(F.col(query)))
    asked = F.lower(strip(text(query)))
    made = rows.withColumn("_asked", asked).withColumn("_wanted", wanted)
    made = with_window(made, "_near", F.col("_asked"), F.col(body), F.col("_wanted"), 280, 180, 1e-12, 0.8, " ")
    made = with_window(made, "_best", F.col("_asked"), F.col(body), F.col("_wanted"), 320, 160, 0.08)
    title, section = get("title", 80), get("section_title", 80)
    shown_title = F.coalesce(F.nullif(title, F.lit("")), section)
    long_title, path, long_section = get("title", 120), get("section_path", 120), get("section_title", 120)
    other = lambda x: F.when((x != "") & (x != long_title), x)
    kind, modality = F.lower(get("content_type", 48)), F.lower(get("source_modality", 24))
    named = lambda names, value: F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value)
    doc_type = F.coalesce(named(CONTENT_NAMES, kind), named(MODALITY_NAMES, modality), F.nullif(kind, F.lit("")), F.nullif(modality, F.lit("")), F.lit("文本片段"))
    summary = get("evidence_summary", 120)
    shown_summary = F.when((summary != "") & (summary != long_title) & (summary != long_section), summary).otherwise(rerank_text(F.col(body), 120))
    sentence = get("sentence", 120)
    focused = F.when(seeks_answer(F.col("_asked")) & (F.col("_best") != text(body)), F.col("_best"))
    part = F.coalesce(F.nullif(focused, F.lit("")), rerank_text(F.col("_near"), 280))
    shown = F.when((sentence != "") & ~F.contains(part, sentence), rerank_text(F.concat_ws(" ", sentence, part), 280)).otherwise(part)
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"[{label}] "), value))
    lines = F.concat_ws(
        "\n", line("标题", shown_title), line("类型", doc_type), line("章节", F.coalesce(other(path), other(long_section))), line("日期", get("date", 32)), line("摘要", shown_summary),
        F.when(sentence != shown, line("命中句", sentence)), line("正文", shown),
    )
    return made.withColumn(out, lines).select(*keep, out)


def group_stats(ranked: DataFrame, group: str, score: str = "score", keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Of each group: the sum of its three best scores (negative ones as 0), its best one and its size."""
    best = Window.partitionBy(*keys, group).orderBy(F.desc(score), "id")
    clipped = F.greatest(F.col(score), F.lit(0.0))
    rows = ranked.where(F.col(group).isNotNull()).withColumn("_n", F.row_number().over(best))
    return rows.groupBy(*keys, group).agg(F.sum(F.when(F.col("_n") <= TOP_OF_GROUP, clipped)).alias("total"), F.max(clipped).alias("best"), F.count(F.lit(1)).alias("members"))


def group_order(stats: DataFrame, group: str, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """stats with place, and dominance: how far the first group's total is above the second's."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("total", 6)), F.desc("members"), F.desc("best"), group)
    every = Window.partitionBy(*keys)
    placed = stats.withColumn("place", F.row_number().over(order))
    first = F.max(F.when(F.col("place") == 1, F.col("total"))).over(every)
    second = F.max(F.when(F.col("place") == 2, F.col("total"))).over(every)
    lead = F.max(F.when(F.col("place") == 1, F.col("members"))).over(every)
    return placed.withColumns({"dominance": F.coalesce((first - second) / F.greatest(first, F.lit(1e-6)), F.lit(0.0)), "lead": lead, "share": F.col("total") / F.greatest(first, F.lit(1e-6))})


def boost_groups(ranked: DataFrame, group: str, score: str = "score") -> DataFrame:
    """Raises rows of the dominant group and lowers the others, by their group's share of its total."""
    stats = group_order(group_stats(ranked, group, score), group)
    rows = ranked.join(stats.select("query_id", group, "place", "dominance", "lead", "share", "members"), ["query_id", group], "left")
    active = (F.col("lead") >= 2) & (F.col("dominance") > 0) & F.col("place").isNotNull()
    up = 0.06 + 0.08 * F.col("share") + 0.02 * F.least(F.col("members") - 1, F.lit(2)) + 0.10 * F.col("dominance")
    down = 0.04 + 0.08 * (1 - F.col("share")) + 0.12 * F.col("dominance")
    moved = F.when(active & (F.col("place") == 1), F.col(score) + up).when(active, F.col(score) - down).otherwise(F.col(score))
    return rows.withColumn(score, moved).select(*ranked.columns)


def trim_groups(ranked: DataFrame, group: str, score: str = "score") -> DataFrame:
    """Only the dominant group's rows, where it has three or more and leads by enough; else all."""
    stats = group_order(group_stats(ranked, group, score), group)
    rows = ranked.join(stats.select("query_id", group, "place", "dominance", "lead"), ["query_id", group], "left")
    every = Window.partitionBy("query_id")
    trim = F.coalesce((F.max("lead").over(every) >= TRIM_COUNT) & (F.max("dominance").over(every) >= TRIM_DOMINANCE), F.lit(False))
    return rows.withColumn("_trim", trim).where(~F.col("_trim") | (F.col("place") == 1)).select(*ranked.columns)


def cover_modalities(ranked: DataFrame, modality: str, required: list[str], k: int, rank: str = "rank") -> DataFrame:
    """The best row of each required modality first, in their order; then the others by rank."""
    own = Window.partitionBy("query_id", modality).orderBy(rank)
    first = F.array_position(F.array(*map(F.lit, required)), F.col(modality)) if required else F.lit(0)
    prior = F.when((F.row_number().over(own) == 1) & (first > 0), first).otherwise(F.lit(len(required) + 1))
    rows = ranked.withColumn("_p", prior)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("_p", rank))).where(F.col("place") <= k).drop("_p")


def diversify(ranked: DataFrame, group: str, k: int, rank: str = "rank") -> DataFrame:
    """The first row of each group by rank, then the repeats; rows without a group are repeats."""
    own = Window.partitionBy("query_id", group).orderBy(rank)
    repeat = F.when(F.coalesce(F.col(group).cast("string"), F.lit("")) == "", 1).when(F.row_number().over(own) > 1, 1).otherwise(0)
    rows = ranked.withColumn("_r", repeat)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("_r", rank))).where(F.col("place") <= k).drop("_r")


def diversify_families(ranked: DataFrame, doc: str, family: str, k: int, rank: str = "rank", modality: str | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """Greedy over two keys: first the best row of each required modality, then rows whose document and family are new; of
    those that wait, documents not taken fill up. A null key is no key. A query's rows are few, as ranked tables are cut before."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(rank, kind="stable").reset_index(drop=True)
        chosen: list[int] = []
        docs: set = set()
        families: set = set()

        def take(i: int) -> None:
            chosen.append(i)
            docs.add(rows.at[i, doc])
            families.add(rows.at[i, family])

        known = lambda value, seen: pd.notna(value) and value in seen
        for m in required if modality else ():
            first = next((i for i in rows.index[rows[modality] == m] if i not in chosen), None)
            if first is not None and len(chosen) < k:
                take(first)
        for fresh in (True, False):
            for i in rows.index:
                if len(chosen) >= k:
                    break
                if i not in chosen and not known(rows.at[i, doc], docs) and not (fresh and known(rows.at[i, family], families)):
                    take(i)
        out = rows.iloc[chosen].copy()
        out["place"] = range(1, len(out) + 1)
        return out

    return ranked.groupBy("query_id").applyInPandas(pick, ranked.select("*", F.lit(1).alias("place")).schema)


def blend_model(heuristic: Column, fused: Column, relevance: Column, raw: Column, threshold: float, keys: tuple[str, ...] = ("query_id",)) -> tuple[Column, Column]:
    """rerank and relevance from a model's raw score: its logistic, clipped, with some of the others."""
    m = 1 / (1 + F.exp(-F.greatest(F.lit(-18.0), F.least(F.lit(18.0), raw))))
    top = F.greatest(F.max(heuristic).over(Window.partitionBy(*keys)), F.lit(1e-6))
    return m + 0.03 * heuristic / top + 0.02 * fused, F.when(m < threshold, F.least(relevance, m)).otherwise(F.least(F.lit(1.0), 0.85 * m + 0.15 * relevance))
