"""Passages of documents as the unit of retrieval: scan, text form, terms of single words and characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexical import B, EPSILON, K1, MAX_QUERY_TERMS, asked_postings, unique
from .sizes import small


def scan_passages(docs: DataFrame) -> DataFrame:
    """A row for each passage: doc_key, title, url, date, contents and psg_id from 0. docs: id, url, title, date, passages (array)."""
    one = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s{2,}|[\s&&[^ ]]", " "))
    url = F.trim(F.coalesce("url", F.lit("")))
    rows = docs.select(F.concat_ws("\t", F.coalesce(F.col("id").cast("string"), F.lit("")), url).alias("doc_key"), one(F.col("title")).alias("title"), url.alias("url"), one(F.col("date").cast("string")).alias("date"), F.posexplode("passages").alias("psg_id", "p"))
    return rows.select("doc_key", "title", "url", "date", one(F.col("p")).alias("contents"), "psg_id")


def passage_text() -> Column:
    return F.concat(F.col("title"), F.lit("。"), F.col("contents"))


def unigrams(value: Column) -> Column:
    """Words of ASCII letters, digits and underscores, and single CJK characters; a mark where there are none."""
    found = F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(r"[A-Za-z0-9_]+|[\x{4e00}-\x{9fff}]"), F.lit(0))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("__empty__")))


def passage_bm25(passages: DataFrame, queries: DataFrame, text: Column, id_col: str = "id") -> DataFrame:
    """query_id, id and okapi score over unigrams; terms that a query repeats count each time. queries: query_id, query."""
    tok = passages.select(F.col(id_col).alias("id"), unigrams(text).alias("terms"))
    asked = queries.select("query_id", F.explode(unigrams(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    long = asked_postings(tok.select("id", F.size("terms").alias("dl"), "terms"), asked)
    # counts of all terms are for the mean alone: each task adds up its own before they are shuffled, with a row without a term
    # for the lengths, so that the passages are read once for all figures
    length = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.size("terms").cast("long").alias("dl")))
    each = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.lit(0).cast("long").alias("dl")))
    rows = tok.select("id", F.explode(F.concat(each, length)).alias("x")).select("id", "x.term", "x.dl")
    if not unique(tok):
        rows = rows.where("term is null").unionByName(rows.where("term is not null").distinct())
    counts = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("total"))
    figures = counts.where("term is null").select(F.col("df").alias("n"), (F.col("total") / F.col("df")).alias("avgdl"))
    f, n = F.col("df").cast("double"), F.col("n")
    raw = F.log(n - f + 0.5) - F.log(f + 0.5)
    df = counts.where("term is not null").select("term", "df").join(F.broadcast(figures), how="cross")
    mean = df.agg(F.avg(raw).alias("mean"))
    idf = df.join(small(asked.select("term").distinct(), MAX_QUERY_TERMS), "term", "left_semi").join(F.broadcast(mean), how="cross").select("term", "avgdl", F.when(raw < 0, EPSILON * F.col("mean")).otherwise(raw).alias("idf"))
    tf = F.col("tf")
    part = F.col("times") * F.col("idf") * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))
    return long.join(asked, "term").join(idf, "term").groupBy("query_id", "id").agg(F.sum(part).alias("score"))
