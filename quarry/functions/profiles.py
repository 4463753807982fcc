"""What a question asks for, as Column expressions over its bundle: an array of the question and its variants.

Kinds, gates and constraints are words found in the text, so a profile is a projection without any shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W
from .text import date_ordinals, distinct_strings, strip, text, years

MARKS = " ，,。；;？?"


def let(value: Column, body) -> Column:
    """body(value), with value in the plan once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def has_any(value: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(value, F.lit(w)) for w in words])


def hits(value: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(value, F.lit(w)).cast("int") for w in words])


def found(value: Column, words: tuple[str, ...]) -> Column:
    """The words that value holds, in their order, each once."""
    return F.filter(F.array(*[F.lit(w) for w in dict.fromkeys(words)]), lambda w: F.contains(value, w))


def occurrences(value: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [((F.length(value) - F.length(F.replace(value, F.lit(w), F.lit("")))) / len(w)).cast("int") for w in words])


def parts_of(bundle: Column) -> Column:
    return F.filter(F.transform(bundle, lambda x: strip(text(x))), lambda x: x != "")


def combined(bundle: Column) -> Column:
    return F.array_join(parts_of(bundle), " ")


def primary(bundle: Column) -> Column:
    """The first that isn't blank, in lower case."""
    return F.lower(F.coalesce(F.try_element_at(parts_of(bundle), F.lit(1)), F.lit("")))


def extracted(value: Column, pattern: str, limit: int) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(value, F.lit(pattern), F.lit(0))), 1, limit)


def timeseries(bundle: Column) -> Column:
    """struct of related, keywords, window, guard, locations and domains."""
    raw = combined(bundle)
    low = F.lower(raw)
    locations, domains = extracted(raw, W.LOCATION, 4), found(low, W.SERIES_DOMAIN)
    keywords = found(low, W.SERIES + W.SERIES_CHANNEL + W.SERIES_DOMAIN)
    placed = (F.size(locations) > 0) | (F.size(domains) > 0)
    window, guard = has_any(low, W.SERIES_WINDOW), has_any(low, W.SERIES_GUARD)
    asks = has_any(low, W.SERIES_CAUSAL + W.SERIES_COMPARISON + W.SERIES_GUARD)
    related = (low != "") & ((F.size(keywords) > 0) | window | (asks & placed))
    return F.struct(related.alias("related"), keywords.alias("keywords"), window.alias("window"), guard.alias("guard"), locations.alias("locations"), domains.alias("domains"))


def joint(bundle: Column) -> Column:
    """struct of joint, series, background, window, guard, locations, channels, events and domains."""
    raw, ts = combined(bundle), timeseries(bundle)
    locations = F.when(F.size(ts["locations"]) > 0, ts["locations"]).otherwise(extracted(raw, W.LOCATION_ELSE, 4))
    events, channels = F.slice(found(raw, W.EVENTS), 1, 5), extracted(F.lower(raw), W.CHANNEL, 6)
    series, background = ts["related"] | has_any(raw, W.TREND), has_any(raw, W.BACKGROUND)
    known = (F.size(locations) > 0) | (F.size(ts["domains"]) > 0) | (F.size(events) > 0)
    both = (series & background) | (ts["guard"] & (series | background)) | (series & known & has_any(raw, W.JOINT_WHY))
    return F.struct(
        both.alias("joint"), series.alias("series"), background.alias("background"), ts["window"].alias("window"), ts["guard"].alias("guard"),
        locations.alias("locations"), channels.alias("channels"), events.alias("events"), ts["domains"].alias("domains"),
    )


def multimodal(value: Column) -> Column:
    return has_any(value, W.JOINT_IMAGE) & (has_any(value, W.JOINT_BOTH) | has_any(value, W.JOINT_TEXT))


def kind(bundle: Column, series: bool = True) -> Column:
    """none (a blank question), timeseries_related (unless series is off), multimodal_joint, image_related or text_related."""
    low = F.lower(combined(bundle))
    found_kind = F.when(low == "", "none")
    if series:
        found_kind = found_kind.when(timeseries(bundle)["related"], "timeseries_related")
    return found_kind.when(multimodal(primary(bundle)), "multimodal_joint").when(hits(low, W.IMAGE) > hits(low, W.TEXT), "image_related").otherwise("text_related")


def by_kind(of: Column, table: dict[str, object], value) -> Column:
    """value(entry) of the kind's entry of a table; null for other kinds."""
    every = None
    for name, entry in table.items():
        every = F.when(of == name, value(entry)) if every is None else every.when(of == name, value(entry))
    return every


def literal_map(entries: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def literal_array(entries) -> Column:
    return F.array(*map(F.lit, entries)) if entries else F.array().cast("array<string>")


def preferred_modalities(of: Column) -> Column:
    return by_kind(of, W.PREFERRED, literal_array)


def required_modalities(of: Column) -> Column:
    return F.coalesce(by_kind(of, W.REQUIRED, literal_array), literal_array(()))


def modality_bonus(of: Column, modality: Column) -> Column:
    return F.coalesce(by_kind(of, W.MODALITY_BONUS, lambda m: F.try_element_at(literal_map(m), modality)), F.lit(0.0))


def extension_bonus(of: Column, extension: Column) -> Column:
    return F.coalesce(by_kind(of, W.EXTENSION_BONUS, lambda m: F.try_element_at(literal_map(m), F.lower(extension))), F.lit(0.0))


def path_hints(bundle: Column, of: Column) -> Column:
    own = F.flatten(F.transform(parts_of(bundle), lambda x: F.regexp_extract_all(x, F.lit("[一-鿿]{2,}"), F.lit(0))))
    fixed = by_kind(of, W.PATH_HINTS, literal_array)
    return F.when(of == "none", literal_array(())).otherwise(F.coalesce(fixed, F.slice(F.array_distinct(own), 1, 8)))


def query_bundle(bundle: Column, of: Column) -> Column:
    """The distinct questions, and for ones about images the first two with words for what images hold."""
    base = distinct_strings(bundle)

    def more(x: Column) -> Column:
        suffixes = F.array(*[F.concat(x, F.lit(" " + s)) for s in W.IMAGE_SUFFIXES[:3]])
        both = F.when(of == "multimodal_joint", F.array(F.concat(x, F.lit(" 文档内容")), F.concat(x, F.lit(" 图片内容")))).otherwise(literal_array(()))
        return F.when(has_any(F.lower(x), W.IMAGE_SUFFIXES), literal_array(())).otherwise(F.concat(suffixes, both))

    wide = F.flatten(F.transform(F.slice(base, 1, 2), more))
    return F.array_distinct(F.concat(base, F.when(of.isin("image_related", "multimodal_joint"), wide).otherwise(literal_array(()))))


def diverse(bundle: Column) -> Column:
    low = F.lower(combined(bundle))
    return has_any(low, W.MULTI_DOC) & has_any(low, W.CONNECTORS)


def temporal(bundle: Column) -> Column:
    """struct of temporal, recent, years and days (ordinals), both sorted."""
    low = F.lower(combined(bundle))
    ys, days, recent = F.array_sort(F.array_distinct(years(low))), F.array_sort(F.array_distinct(date_ordinals(low))), has_any(low, W.RECENT)
    month_day = low.rlike(r"(?<!\d)\d{1,2}\s*月\s*\d{1,2}\s*(?:日|号)(?!\d)")
    is_temporal = recent | (F.size(ys) > 0) | (F.size(days) > 0) | month_day | has_any(low, W.TEMPORAL)
    return F.struct(is_temporal.alias("temporal"), recent.alias("recent"), ys.alias("years"), days.alias("days"))


def seeks_answer(value: Column) -> Column:
    return (value != "") & has_any(value, W.SEEKING)


def uses_sentences(bundle: Column) -> Column:
    """Whether the sentence index helps: one fact is asked for, without times or comparisons."""
    p = primary(bundle)
    plain = ~has_any(p, W.TEMPORAL + W.RECENT) & ~has_any(p, W.MULTI_DOC) & (occurrences(p, W.CONNECTORS) < 2)
    return seeks_answer(p) & plain & has_any(p, W.LABELS + ("语言",) + W.EXTRACTIVE)


def model_route(bundle: Column, of: Column, models: tuple[str, ...] = ("temporal", "multi_doc", "answer_focused")) -> Column:
    """Which of the configured models reranks; the kind of question where none of them does."""
    of = F.when(of == "none", "text_related").otherwise(of)
    rules = {"temporal": temporal(bundle)["temporal"], "multi_doc": diverse(bundle), "answer_focused": seeks_answer(primary(bundle))}
    chosen = [F.when(rules[name], name) for name in ("temporal", "multi_doc", "answer_focused") if name in models]
    return F.coalesce(*chosen, of)


def rerank_cutoff(of: Column, k: Column, least: int = 10) -> Column:
    base = F.greatest(F.lit(least), k, F.lit(1))
    return F.when(of == "multimodal_joint", F.greatest(base, k * 4, F.lit(12))).when(of == "image_related", F.greatest(base, k * 3, F.lit(10))).otherwise(base)


# rewriting
def trim_marks(value: Column) -> Column:
    return F.regexp_replace(value, f"^[{MARKS}]+|[{MARKS}]+$", "")


def sanitised_rewrite(value: Column) -> Column:
    """A model's rewritten question: its first line, without list marks and known labels."""
    clean = strip(F.regexp_replace(strip(text(value)), "^`+|`+$", ""))
    line = strip(F.regexp_extract(clean, r"^([^\n\r]*)", 1))
    line = strip(F.regexp_replace(line, r"^(?:[-*]\s*|\d+[.)]\s*|[一二三四五六七八九十]+[、.]\s*)", ""))
    line = strip(F.regexp_replace(line, "^(?:" + "|".join(W.QUERY_PREFIXES) + ")", ""))
    return strip(F.regexp_replace(line, "^[。 ]+|[。 ]+$", ""))


def hypothetical(value: Column) -> Column:
    one = strip(F.regexp_replace(F.regexp_replace(strip(text(value)), "^`+|`+$", ""), r"(?U)\s+", " "))
    return F.when(F.length(one) > 480, F.rtrim(F.substring(one, 1, 480))).otherwise(one)


def keep_times(candidate: Column, original: Column) -> Column:
    """candidate with the time words of original that it lacks, two at most; empty where it lacks a year."""
    candidate, original = strip(text(candidate)), strip(text(original))
    asked_years = F.array_distinct(F.regexp_extract_all(original, F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1)))
    slots, recent, kept = found(original, W.SLOTS), found(original, W.RECENT), found(original, W.KEPT)

    def lacking(some: Column) -> Column:
        """The first of some, if candidate has none of them."""
        return F.when((F.size(some) > 0) & ~F.exists(some, lambda w: F.contains(candidate, w)), F.slice(some, 1, 1)).otherwise(literal_array(()))

    first = F.concat(lacking(slots), lacking(recent))
    missing = F.filter(kept, lambda w: ~F.contains(candidate, w))
    # after the two kinds above, words of the third are added until there are two, one at least
    added = F.concat(first, F.slice(missing, F.lit(1), F.greatest(F.lit(1), 2 - F.size(first))))
    merged = F.array_join(F.array_distinct(F.filter(F.split(F.concat_ws(" ", candidate, F.array_join(added, " ")), r"\s+"), lambda x: x != "")), " ")
    lost = F.exists(asked_years, lambda y: ~F.contains(candidate, y))
    return F.when((candidate == "") | (original == ""), candidate).when(lost, "").when(F.size(added) > 0, merged).otherwise(candidate)


def compared_entities(original: Column) -> Column:
    """The two professions that a comparing question names; none otherwise."""
    original = strip(text(original))
    prefix = F.regexp_extract(original, "^(?s)(.*?)专业", 1)
    left = trim_marks(F.regexp_extract(prefix, "^(?s)(.*?)(?:与|和|及|以及)", 1))
    right = trim_marks(F.regexp_extract(prefix, "^(?s).*?(?:与|和|及|以及)(.*)$", 1))
    pair = F.array_distinct(F.array(F.concat(left, F.lit("专业")), F.concat(right, F.lit("专业"))))
    named = F.slice(F.array_distinct(F.regexp_extract_all(original, F.lit("[一-鿿A-Za-z0-9]+?专业"), F.lit(0))), 1, 2)
    some = F.when((left != "") & (right != ""), pair).otherwise(named)
    compares = has_any(original, W.COMPARING) & has_any(original, W.RELATING) & F.contains(original, F.lit("专业"))
    return F.when(compares & (F.size(some) >= 2), some).otherwise(literal_array(()))


def keep_entities(candidate: Column, original: Column) -> Column:
    """candidate, or empty where it lacks something that original compares."""
    candidate = strip(text(candidate))
    return F.when(F.exists(compared_entities(original), lambda e: ~F.contains(candidate, e)) & (candidate != ""), "").otherwise(candidate)


def accepted_rewrite(value: Column, original: Column) -> Column:
    """A rewritten question that keeps times and compared things and isn't too long; empty otherwise."""
    kept = keep_entities(keep_times(sanitised_rewrite(value), original), original)
    return F.when(F.length(kept) > F.greatest(F.lit(96), 2 * F.length(original)), "").otherwise(kept)


def accepted_rewrites(value: Column, original: Column, limit: int) -> Column:
    """The distinct accepted questions of a model's answer, which has one to a line, or one line with semicolons."""
    lines = parts_of(F.split(strip(F.regexp_replace(strip(text(value)), "^`+|`+$", "")), r"[\r\n]+"))
    lines = F.when(F.size(lines) == 1, parts_of(F.split(lines[0], "[；;]"))).otherwise(lines)
    good = F.slice(F.filter(F.transform(lines, lambda x: accepted_rewrite(x, original)), lambda x: x != ""), 1, limit)
    again = F.transform(good, lambda x: accepted_rewrite(x, original))
    own = F.coalesce(F.nullif(accepted_rewrite(original, original), F.lit("")), strip(original))
    return F.array_except(F.array_distinct(F.filter(again, lambda x: x != "")), F.array(own))


# answers
def last_question(value: Column) -> Column:
    """What follows the last mark of a question; all where nothing does."""

    def of(whole: Column) -> Column:
        at = F.greatest(*[F.when(F.contains(whole, F.lit(m)), F.length(whole) - F.locate(m[::-1], F.reverse(whole)) + 2).otherwise(0) for m in W.QUESTION_MARKS])
        return F.coalesce(F.nullif(strip(F.substring(whole, at, F.length(whole))), F.lit("")), whole)

    return let(strip(text(value)), of)


def requirement_parts(value: Column) -> Column:
    """Parts of a request: sentences, and after each what stands between its words that join clauses."""
    sentences = F.filter(F.transform(F.split(strip(text(value)), "[；;。\n]"), trim_marks), lambda x: x != "")

    def pieces(x: Column) -> Column:
        of = [F.when(F.contains(x, F.lit(j)), F.transform(F.split(x, j), trim_marks)).otherwise(literal_array(())) for j in W.REQUIREMENT_JOINS]
        return F.concat(F.array(x), *of)

    return F.array_distinct(F.filter(F.flatten(F.transform(sentences, pieces)), lambda x: x != ""))


def answer_policy(value: Column) -> Column:
    """struct of requirements (a count), direct, comparative, procedural, numeric and symbols."""

    def of(q: Column) -> Column:
        there, upper = q != "", F.upper(q)
        return F.struct(
            F.size(requirement_parts(value)).alias("requirements"),
            (there & (F.size(requirement_parts(q)) <= 1) & has_any(q, W.DIRECT)).alias("direct"),
            (there & has_any(q, W.ANSWER_RELATING) & has_any(q, W.ANSWER_COMPARING) & has_any(q, W.ENTITIES)).alias("comparative"),
            (there & has_any(q, W.PROCEDURAL)).alias("procedural"),
            (there & has_any(q, W.NUMERIC)).alias("numeric"),
            (there & (has_any(q, W.MEANING) | (hits(upper, W.SYMBOLS) >= 2))).alias("symbols"),
        )

    return let(last_question(value), of)


def snippet_limit(group: Column, policy: Column) -> Column:
    """How many characters of a reference an answer of this policy shows."""
    return (
        F.when(group == "timeseries", 260).when(group.isin("ocr", "vision"), 220).when(policy["procedural"], 320).when(policy["symbols"], 360).when(policy["numeric"], 220)
        .when(policy["comparative"], 260).when(policy["direct"], 120).when(policy["requirements"] > 1, 220).otherwise(160)
    )


def reference_limit(query: Column, n: Column) -> Column:
    """How many references a prompt shows."""
    q = F.lower(strip(text(query)))
    many = F.when(n >= 5, 5).otherwise(3)
    return F.when(q == "", many).when(has_any(q, W.MULTI_PART), 5).when(has_any(q, W.SINGLE_FACT), 3).otherwise(many)


def answer_support(query: Column, body: Column) -> Column:
    """How well a text looks like the answer to a question: labels, amounts, dates, grades, roles, languages, lists; 0.14 at most."""
    q, body = F.lower(strip(text(query))), text(body)
    low = F.lower(body)
    label = F.try_element_at(found(q, W.LABELS), F.lit(1))
    labelled = F.coalesce(F.exists(F.array(*map(F.lit, ("：", ":", "是", "为"))), lambda m: F.contains(low, F.concat(label, m))), F.lit(False))
    graded = F.contains(q, F.lit("等级")) & body.rlike(W.GRADE)
    one = lambda rule, points: F.when(rule, points).otherwise(0.0)
    total = (
        one(labelled, 0.06)
        + one(has_any(q, W.HOW_MANY) & body.rlike(W.AMOUNT), 0.05)
        + one(has_any(q, W.WHEN) & ((F.size(years(body)) > 0) | (F.size(date_ordinals(body)) > 0)), 0.05)
        + one(graded, 0.05)
        + one(graded & has_any(low, W.RATED), 0.03)
        + one(has_any(q, W.WHO) & has_any(body, W.ROLES), 0.05)
        + one(F.contains(q, F.lit("语言")) & (hits(body, W.LANGUAGES) >= 2), 0.06)
        + one(has_any(q, W.LISTING) & has_any(body, W.LIST_MARKS), 0.03)
    )
    return F.when(seeks_answer(q), F.least(F.lit(0.14), total)).otherwise(0.0)
