"""Retrieval and answer measures over tables of hits: query_id, positive, rank."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .sizes import small


def holders(docs: DataFrame, items: DataFrame, text: str = "text", passage: str = "passage") -> DataFrame:
    """Documents joined with the items whose passage their text holds. A passage's longest word between two of its spaces stands
    between spaces in a text that holds it, so that a text is searched for the passages of its own words alone; passages of
    fewer than three words are looked for in every text."""
    words = F.split(F.col(passage), " ", -1)
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.aggregate(inner, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    asked = small(items.where(F.col(passage).isNotNull()).withColumn("_word", longest))
    held = docs.where(F.col(text).isNotNull()).join(asked.where("_word = ''"), F.contains(text, passage))
    met = docs.withColumn("_word", F.explode(F.array_distinct(F.split(F.col(text), " ", -1)))).join(asked.where("_word <> ''"), "_word")
    return met.where(F.contains(text, passage)).select(*held.columns).unionByName(held).drop("_word")


def first_ranks(run: DataFrame, positives: DataFrame) -> DataFrame:
    """query_id, positive and the best rank of a run (query_id, id, rank) that it was found at, or null."""
    hits = positives.join(run, (positives["query_id"] == run["query_id"]) & (positives["positive"] == run["id"]), "left")
    return hits.groupBy(positives["query_id"], "positive").agg(F.min("rank").alias("rank"))


def measures(ranks: DataFrame, k: int) -> DataFrame:
    """For each query recall, mrr, ndcg and hits at 1, 3, 5 and 10. Positives first found at one rank count
    once in the gain, while the ideal counts them all."""
    within = F.when(F.col("rank") <= k, F.col("rank"))
    found = ranks.groupBy("query_id").agg(F.collect_set(within).alias("r"), F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"), F.count(within).alias("m"))
    gain = lambda ranks_: F.aggregate(F.transform(F.array_sort(ranks_), lambda r: 1 / F.log2(r + 1.0)), F.lit(0.0), lambda a, x: a + x)
    ideal = gain(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")))
    return found.select(
        "query_id",
        (F.col("m") / F.col("n")).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        (gain(F.col("r")) / ideal).alias("ndcg"),
        *[F.coalesce(F.col("first") <= n, F.lit(False)).cast("int").alias(f"hit_{n}") for n in (1, 3, 5, 10)],
        (F.col("m") == F.col("n")).cast("int").alias("all_covered"),
    )


def bucket(first: Column, covered: Column, noise: Column) -> Column:
    """Why a case is bad: missed, spread over passages, ranked low, found but noisy; else passed."""
    return F.when(first.isNull(), "missed_recall").when(~covered, "cross_passage").when(first > 3, "low_rank").when(noise, "chunk_noise").otherwise("passed")


def char_f1(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """F1 of the characters, with repeats, of two texts without white space."""
    chars = lambda c: F.explode(F.split(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)\s+", ""), ""))
    one, two = (pairs.select(key, chars(c).alias("ch")).where("ch <> ''").groupBy(key, "ch").agg(F.count(F.lit(1)).alias(f"n_{c}")) for c in (a, b))
    both = one.join(two, [key, "ch"], "full_outer").fillna(0, [f"n_{a}", f"n_{b}"])
    sums = both.groupBy(key).agg(F.sum(F.least(f"n_{a}", f"n_{b}")).alias("s"), F.sum(f"n_{a}").alias("x"), F.sum(f"n_{b}").alias("y"))
    return sums.select(key, F.when(F.col("x") + F.col("y") > 0, 2 * F.col("s") / (F.col("x") + F.col("y"))).otherwise(0.0).alias("f1"))


@F.pandas_udf(DoubleType())
def rouge_l(a: pd.Series, b: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of characters, white space left out."""

    def one(x: str | None, y: str | None) -> float:
        x, y = "".join((x or "").split()), "".join((y or "").split())
        if not x or not y:
            return 0.0
        row = [0] * (len(y) + 1)
        for c in x:
            last = 0
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], last + 1 if c == d else max(row[j], row[j - 1])
        return 2 * row[-1] / (len(x) + len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


# fixed values: how files and texts name documents and passages
DOC_ID, PASSAGE_ID = "(?:文档ID：|doc-)(\\d+)", "(?:段落ID：|psg-)([\\w-]+)"
IN_PATH = "(?i)__doc-(\\d+)(?:__psg-(\\d+)\\.txt$)?"


def plain(value: Column) -> Column:
    """Without white space and with straight quotes, as texts are compared."""
    return F.translate(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", ""), "“”‘’", "\"\"''")


def named_in(pattern: str, *texts: Column) -> Column:
    """The first group of a pattern in the first of the texts that has it; null in none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(t, F.lit("")), pattern, 1), F.lit("")) for t in texts])


def _squeezed(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", " "))


def _keys(**named: Column) -> Column:
    every = [F.when(v != "", F.concat(F.lit(f"{k}:"), v)) for k, v in named.items()]
    return F.filter(F.array(*every), lambda x: x.isNotNull())


def sample_keys(path: Column, title: Column, source: Column) -> Column:
    """What tells a reference of a sample corpus: its sample, title and source."""
    from quarry.functions.text import sample_id

    return _keys(sample=F.coalesce(sample_id(path), F.lit("")), title=F.lower(_squeezed(title)), source=F.lower(_squeezed(source)))


def passage_keys(doc: Column, passage: Column, url: Column, title: Column) -> Column:
    doc, passage = _squeezed(doc), _squeezed(passage)
    both = F.when((doc != "") & (passage != ""), F.concat_ws(":", doc, passage)).otherwise("")
    return _keys(doc_psg=both, doc=doc, url=F.lower(_squeezed(url)), title=F.lower(_squeezed(title)))


def retrieved_passage_keys(path: Column, source: Column, title: Column) -> Column:
    """passage_keys() of a retrieved reference: ids from its path, a url where the source is one."""
    at = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    url = F.lower(_squeezed(source))
    return passage_keys(F.regexp_extract(at, IN_PATH, 1), F.regexp_extract(at, IN_PATH, 2), F.when(F.startswith(url, F.lit("http")), url).otherwise(""), title)


def key_hits(retrieved: DataFrame, expected: DataFrame, limit: int = 5) -> DataFrame:
    """query_id, expected_id and rank: the best rank up to limit at which an expected reference shares a key with a retrieved
    one, or null. retrieved: query_id, rank, keys; expected: query_id, expected_id, keys. Joined on keys, not on pairs."""
    r = retrieved.where(F.col("rank") <= limit).select("query_id", "rank", F.explode("keys").alias("key"))
    e = expected.select("query_id", "expected_id", F.explode("keys").alias("key"))
    best = e.join(r, ["query_id", "key"]).groupBy("query_id", "expected_id").agg(F.min("rank").alias("rank"))
    return expected.select("query_id", "expected_id").join(best, ["query_id", "expected_id"], "left")


def expected_hits(hits: DataFrame) -> DataFrame:
    """For each query whether the first 1, 3 and 5 hold an expected reference, how many they hold, and whether all."""
    first = F.min("rank")
    found = [F.coalesce(first <= n, F.lit(False)).alias(f"hit_top{n}") for n in (1, 3, 5)]
    return hits.groupBy("query_id").agg(*found, F.count("rank").alias("matched"), (F.count("rank") >= F.count(F.lit(1))).alias("all_covered"))


def matches_positive(content: Column, source: Column, chunk: Column, title: Column, gold_title: Column, gold_id: Column, gold_url: Column, gold_passage: Column, gold_text: Column) -> Column:
    """Whether a retrieved reference is a positive one by any of: title, document's id, url in its text, passage's id, or text."""
    there = lambda c: F.coalesce(F.trim(c), F.lit(""))
    yes = lambda rule: F.coalesce(rule, F.lit(False))
    return (
        yes((there(gold_title) != "") & (title == there(gold_title)))
        | yes((there(gold_id) != "") & (named_in(DOC_ID, content, source, chunk) == there(gold_id)))
        | yes((there(gold_url) != "") & F.contains(F.coalesce(content, F.lit("")), there(gold_url)))
        | yes((there(gold_passage) != "") & (named_in(PASSAGE_ID, content, source, chunk) == there(gold_passage)))
        | yes((plain(gold_text) != "") & F.contains(plain(content), plain(gold_text)))
    )


def matches_gold_passage(path: Column, content: Column, source: Column, chunk: Column, gold_path: Column, gold_id: Column, gold_passage: Column, gold_text: Column) -> Column:
    """Whether a retrieved reference holds a gold passage: its text, or in the gold file or document the passage's id or nothing else."""
    there = lambda c: F.coalesce(F.trim(c), F.lit(""))
    yes = lambda rule: F.coalesce(rule, F.lit(False))
    holds = (plain(gold_text) != "") & F.contains(plain(content), plain(gold_text))
    same_file = yes((there(gold_path) != "") & (path == there(gold_path)))
    same_doc = yes((there(gold_id) != "") & (named_in(DOC_ID, content, source, chunk) == there(gold_id)))
    by_id = yes((there(gold_passage) != "") & (named_in(PASSAGE_ID, content, source, chunk) == there(gold_passage)))
    return holds | (same_file & by_id) | (same_doc & (plain(gold_text) == ""))


def proxy_measures(references: DataFrame, answers: DataFrame) -> DataFrame:
    """How far retrieved texts hold a gold answer: found whole, F1 of characters, longest common subsequence, references.
    references: query_id, rank, content; answers: query_id, answer."""
    lines = F.array_sort(F.collect_list(F.struct("rank", _squeezed(F.col("content")).alias("t"))))
    texts = references.groupBy("query_id").agg(F.array_join(F.filter(F.transform(lines, lambda x: x["t"]), lambda t: t != ""), "\n").alias("shown"), F.count(F.lit(1)).alias("references"))
    rows = answers.join(texts, "query_id", "left").select("query_id", _squeezed(F.col("answer")).alias("gold"), F.coalesce("shown", F.lit("")).alias("shown"), F.coalesce("references", F.lit(0)).alias("references"))
    held = (F.col("gold") != "") & F.contains(_squeezed(F.col("shown")), F.col("gold"))
    return rows.join(char_f1(rows, "query_id", "shown", "gold"), "query_id", "left").select("query_id", held.alias("answer_held"), F.coalesce("f1", F.lit(0.0)).alias("char_f1"), rouge_l("shown", "gold").alias("rouge_l"), "references")


def case_query(direct: Column, event: Column, question: Column) -> Column:
    """A case's question: as given, else its event and its question on two lines, else what there is of them."""
    d, e, q = _squeezed(direct), _squeezed(event), _squeezed(question)
    return F.when(d != "", d).when((e != "") & (q != ""), F.concat_ws("\n", e, q)).otherwise(F.when(q != "", q).otherwise(e))


def task_query(task: Column, question: Column, date: Column, history: Column) -> Column:
    """A question of a task: with its year in front, after the questions before it (an array), or alone."""
    year = F.trim(F.coalesce(date, F.lit("")))
    timed = F.concat(F.when(year != "", F.concat(year, F.lit("年 "))).otherwise(""), F.coalesce(question, F.lit("")))
    asked = F.filter(F.transform(F.coalesce(history, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    talk = F.concat_ws(" ", F.array_join(asked, " "), F.trim(F.coalesce(question, F.lit(""))))
    return _squeezed(F.when(task == "time", timed).when(task == "conversation", talk).otherwise(question))


def seeded_sample(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows without replacement, the same for a seed, by a hash of their key."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def regression_verdict(cases: DataFrame) -> DataFrame:
    """cases with passed, missing and cause. Columns: required, found and sequence (arrays of modalities), answer, groups (arrays of
    keywords, of each group one must be there), needs_joint, needs_times, joint_shown, joint_traced, times_traced, series_traced, series_answered."""
    c = F.col
    missing = F.array_sort(F.array_except(F.coalesce("required", F.array().cast("array<string>")), F.coalesce("found", F.array().cast("array<string>"))))
    keywords = F.forall(F.coalesce("groups", F.array().cast("array<array<string>>")), lambda g: F.exists(g, lambda w: F.contains(F.coalesce("answer", F.lit("")), w)))
    series = F.array_contains("required", "timeseries")
    rows = cases.withColumns({"missing": missing, "keywords": keywords, "_s": F.coalesce(series, F.lit(False))})
    fine = (F.size("missing") == 0) & c("keywords") & (~c("needs_joint") | c("joint_shown")) & (~c("needs_times") | c("times_traced")) & (~c("_s") | (c("series_traced") & c("series_answered")))
    top = F.slice("sequence", 1, 2)
    ranked = F.array_contains(top, "timeseries") & F.array_contains(top, "text")
    recall = (F.size("missing") > 0) | (c("needs_joint") & ~c("joint_shown")) | (c("_s") & ~c("series_traced"))
    cause = F.when(fine, "passed").when(recall, "recall_failure").when(c("needs_joint") & c("joint_traced") & ~ranked, "ranking_failure").otherwise("generation_failure")
    return rows.withColumn("passed", fine).withColumn("cause", cause).drop("_s")
