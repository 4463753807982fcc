"""Nulls, empty and long texts, ties, repeated rows, empty tables, and columns whose names clash."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import ann, bpe, exact_dedup, html_extract, line_dedup, mixing, near_dup, quality, sharding, toxicity

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ROWS = [
    (1, "a plain text of some words here\nshared line", "en", "s1", 10),
    (2, "a plain text of some words here\nshared line", "en", "s1", 10),
    (2, "a plain text of some words here\nshared line", "en", "s1", 10),
    (3, None, None, None, None),
    (4, "", "en", None, 0),
    (5, " \t\n ", "de", "s2", 4),
    (6, LONG, "en", "s2", len(LONG)),
    (7, "one", "en", "s2", 3),
    (8, "two words", "en", "s3", 9),
    (None, "a text without an id", "en", "s1", 5),
    (None, None, None, None, None),
    (9, "a  plain\ttext of some words here\nshared line", "en", "s1", 10),
    (10, "éà ü 中文 字 😀 don't 12345 <|endoftext|>", "fr", "s3", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["id", "n", "key", "digest", "component", "score", "bands", "ids", "shard", "slot", "size", "block", "_key", "_h", "_host", "mark", "word"]


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame(ROWS, SCHEMA)
    return made.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, int(i % 3 == 0)) for i in range(1, 11)] + [(None, 1, 1), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


OPERATORS = {
    "op1": line_dedup.op1_line_dedup,
    "op2": exact_dedup.op2_exact_dedup,
    "op3": sharding.op3_sharding,
    "op5": near_dup.op5_near_dup,
    "op6": bpe.op6_bpe,
    "op8": mixing.op8_mixing,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_comes_back(docs, none, name):
    rows = OPERATORS[name](docs).collect()
    ids = sorted(str(r["doc_id"]) for r in rows)
    assert ids == sorted(str(r[0]) for r in ROWS)
    assert OPERATORS[name](none).collect() == []


@pytest.mark.parametrize("operator", [quality.op4_quality, toxicity.op9_toxicity])
def test_classifiers(spark, docs, none, labels, operator):
    rows = operator(docs, labels).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert len(operator(docs, labels.limit(0)).collect()) == len(ROWS)
    assert operator(none, labels).collect() == []


def test_exact_dedup_groups(docs):
    rows = exact_dedup.op2_exact_dedup(docs).collect()
    own = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, *_ in ROWS:
        groups.setdefault(own(t), []).append(i)
    for r in rows:
        group = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        assert r["group_size"] == len(group)
        assert r["keep_id"] == min((i for i in group if i is not None), default=None)


def test_history_from_elsewhere(spark, docs):
    old = exact_dedup.recurring(exact_dedup.digests(docs))
    new = spark.createDataFrame([(77, "one"), (78, "fresh"), (79, "fresh"), (80, ROWS[0][1])], "doc_id long, text string")
    rows = {r["id"]: r for r in exact_dedup.exact_dedup(new, history=old).collect()}
    assert rows[80]["member"] and rows[80]["winner"] == 1
    assert not rows[77]["member"] and rows[79]["winner"] == 78 and rows[79]["size"] == 2


def test_line_dedup_keeps_null_and_drops_lines(spark):
    rows = [(i, f"own line {i}\n  menu\nend {i}", "h") for i in range(20)] + [(99, None, "h"), (98, "menu", None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert found[3] == "own line 3\nend 3" and found[99] is None and found[98] == "menu"


def test_pages(spark):
    page = "<html><head><title>t</title></head><body><nav><a>x</a></nav><article><h1>Head &amp; tail</h1><p>A <b>bold</b>\n text &lt;1<p>Second</article><div class='comments'><p>Reader says this is a long comment of the page</p></div><footer>f</footer>"
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p>cut <a href='x"), (5, "u", "<script>if (a<b) {}</script>")]
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.op10_html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[1][0] == "Head & tail\nA bold text <1\nSecond"
    assert found[2] == ("", 0) and found[3] == ("", 0) and found[5] == ("", 0)


def test_vectors(spark):
    rows = [(50, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (3, [0.0, 1.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [None, 1.0], 1), (None, [1.0, 1.0], 1), (8, [-1.0, 0.0], 1), (8, [-1.0, 0.0], 1)]
    schema = "vec_id long, embedding array<float>, label int"
    found = ann.op7_ann(spark.createDataFrame(rows, schema)).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in found] == [(0, 1, 50), (0, 2, 3), (0, 3, 8), (50, 1, 0), (50, 2, 3), (50, 3, 8)]
    assert ann.op7_ann(spark.createDataFrame([], schema)).collect() == []
