"""Line dedup by frequency within a site.

Pages are grouped by host. A line's ratio is the number of the host's pages that contain it over the
number of the host's pages; lines whose ratio exceeds `max_ratio` on a host with enough pages, and which
at least `min_pages` of its pages contain, are boilerplate there and are dropped from every page of it.

Lines are told apart by two 64-bit hashes of their trimmed text, so a page sends a few bytes for each of
its distinct lines; counts are combined before the shuffle, so a host with a third of all rows, or a
line on every page, is no hot task. The ratio is low, as licence lines and footers stand on 0.7 to 1.8 %
of a host's pages: up to MIN_PAGES / MAX_RATIO pages only MIN_PAGES decides. A line on fewer pages of each of
its hosts is kept, on however many hosts it stands. Blank lines are never boilerplate. Defined results: null text stays
null; a null host is a host; a page is a row, so repeated rows count as pages; long texts
are read whole; an empty table gives none; columns of docs keep their names and values, but for the text and for one
named as the count, which these replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, free, keep

MAX_RATIO = 0.001
MIN_PAGES = 8
BROADCAST_LINES = 200_000


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, f"^{SPACE}|{SPACE}$", "")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate(docs: DataFrame, host: str, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """_host and _keys, the array of its boilerplate lines' hashes."""
    keys = F.array_distinct(F.transform(F.filter(F.transform(_lines(F.col(text)), _trimmed), lambda x: x != ""), _key))
    pages = docs.groupBy(F.col(host).alias("_h")).agg(F.count(F.lit(1)).alias("_pages"))
    lines = docs.select(F.col(host).alias("_host"), F.explode(keys).alias("_k"))
    seen = lines.groupBy("_host", "_k").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_pages)
    bad = seen.join(pages, F.col("_host").eqNullSafe(F.col("_h"))).where(F.col("_n") > max_ratio * F.col("_pages"))
    # fewer than 1 / max_ratio times the lines of a mean page, for each host
    return bad.groupBy("_host").agg(F.sort_array(F.collect_list("_k")).alias("_keys"))


def dedup_lines(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, dropped: str = "n_lines_dropped") -> DataFrame:
    """docs, with text without its host's boilerplate lines, and how many were dropped."""
    bad = keep(boilerplate(docs, host, text, max_ratio, min_pages))
    found = bad.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_keys")), F.lit(0))).first()
    few = found[0] + found[1] <= BROADCAST_LINES
    _host, _keys, _kept = free(docs, "host", "keys", "kept")
    bad = bad.select(F.col("_host").alias(_host), F.col("_keys").alias(_keys))
    bad = F.broadcast(bad) if few else bad  # 16 bytes a line; beyond that, a join that splits a hot host
    rows = docs.join(bad, F.col(host).eqNullSafe(F.col(_host)), "left")
    lines = _lines(F.col(text))
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(_keys), _key(_trimmed(x))))
    rows = rows.withColumn(_kept, F.when(F.col(_keys).isNull(), lines).otherwise(kept))
    count = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.coalesce(F.size(lines) - F.size(_kept), F.lit(0))).cast("long")
    others = [F.col(f"`{c}`") if c != text else F.array_join(_kept, "\n").alias(text) for c in docs.columns if c != dropped]
    return rows.select(*others, count.alias(dropped))


def op1_line_dedup(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "source", "text")).select("doc_id", "n_lines_dropped", "text")


SQL = rf"""
with l as (select doc_id, source, row_number() over () as r, string_split(text, chr(10)) as lines from documents),
e as (select r, source, unnest(lines) as line, generate_subscripts(lines, 1) as i from l),
t as (select *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as k from e),
p as (select source, count(*) as pages from documents group by source),
b as (select t.source, k from t join p on t.source is not distinct from p.source where k <> ''
      group by t.source, k, pages having count(distinct r) > {MAX_RATIO} * pages and count(distinct r) >= {MIN_PAGES}),
k as (select t.r, count(b.k) as dropped, string_agg(line, chr(10) order by i) filter (where b.k is null) as text
      from t left join b on t.source is not distinct from b.source and t.k = b.k group by t.r)
select l.doc_id, coalesce(k.dropped, 0) as n_lines_dropped,
       case when l.lines is null then null else coalesce(k.text, '') end as text
from l left join k on l.r = k.r
"""
