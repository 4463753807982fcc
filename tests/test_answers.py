"""Answers, gates, arithmetic, web results, cases and corpora."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import answers as A
from quarry.operators import passages
from quarry.sources import cases, web


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'boolean' if isinstance(v, bool) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_answers_are_cleaned(spark):
    assert one(spark, A.cleaned_answer(F.col("t")), t="结论，具体如下：。。\n\n\n\n完  \n。") == "结论。\n\n完\n。"
    assert one(spark, A.cleaned_answer(F.col("t")), t=None) == ""


def test_requirements_and_gates(spark):
    q = {"q": "如何更换？以及为什么波动", "c": ["1. 拧开\n2、取下"], "s": True, "t": True}
    cover = one(spark, A.coverage_requirements(F.col("q"), F.col("s"), F.col("t"), F.col("c")), **q)
    assert cover.startswith("【回答覆盖要求】\n- 如何更换？以及为什么波动\n- 如何更换\n- 为什么波动\n- 时间范围") and "完整覆盖" in cover and cover.endswith("\n\n")
    form = one(spark, A.answer_requirements(F.col("q"), F.col("s"), F.col("t"), F.col("c")), **q)
    assert form.count("\n- ") == 4 and "趋势观察与事件背景" in form
    assert one(spark, A.coverage_requirements(F.col("q"), F.lit(False), F.lit(True), F.col("c")), q="", c=[]) == ""
    gate = lambda query, groups, draft: tuple(one(spark, A.reviews(F.col("q"), F.col("g"), F.col("d"), F.lit("")), q=query, g=groups, d=draft))
    assert gate("原因是什么", ["text", "timeseries"], "上升") == (True, True, True)
    assert gate("原因是什么", ["text", "timeseries"], "上升，由于冷空气") == (True, True, False)
    assert gate("这张图", ["ocr"], "x") == (False, False, False) and gate("谁", [], "x") == (False, False, False)
    assert one(spark, A.asks_time(F.col("q")), q="现在的校长是谁") and not one(spark, A.asks_time(F.col("q")), q="前任校长是谁")


def test_arithmetic(spark):
    assert one(spark, A.math_expression(F.col("q")), q="请算（3 + 4）× 2 等于") == "(3+4)*2"
    assert one(spark, A.math_expression(F.col("q")), q="no sums 12 here") == ""
    texts = ["qps: 40 then qps is 50", "else 7"]
    derive = lambda q: one(spark, A.derived_expression(F.col("q"), F.col("c")), q=q, c=texts)
    assert derive("qps 的平均") == "(40+50)/2" and derive("qps 相减") == "40-50" and derive("qps 一共") == "40+50"
    assert A.calculate("7 // 2 + 2 ** 3") == "7 // 2 + 2 ** 3 = 11" and A.calculate("6/3") == "6/3 = 2"
    for bad in ("", "1/0", "__import__('os')", "9**9**9", "a+1", "1" * 121, "(1"):
        assert A.calculate(bad) is None


def test_web_results(spark):
    page = (
        '<div class="result"><h2 class="result__title"><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fwww.a.org%2Fx">One &amp; all</a></h2><a class="result__snippet" href="#">of  it</a></div>'
        '<div class="result"><a href="ftp://b.org">no</a></div><p><a href="https://c.org/y">Three</a> - more of it<br></p><a href="https://c.org/z">Next</a>'
    )
    assert web.parse_results(page, 5) == [(1, "One & all", "https://www.a.org/x", "of it", "a.org"), (2, "Three", "https://c.org/y", "more of it", "c.org")]
    assert web.parse_results("", 5) == [] and len(web.parse_results(page, 1)) == 1
    rows = web.web_results(spark.createDataFrame([(7, page), (8, None)], "query_id long, html string"), 5).collect()
    assert [(r["query_id"], r["rank"]) for r in rows] == [(7, 1), (7, 2)]


def test_cases(spark, tmp_path):
    data = {"questanswer_2docs": [{"ID": 5, "questions": ["", "q?"], "answers": "a", "event": "e"}], "summary": [{"title": "t", "summary": "s"}, {"summary": "no event"}], "items": [{"ask": "x", "answer": "y"}]}
    (tmp_path / "d.json").write_text(json.dumps(data))
    found = {r["case_id"]: r for r in cases.read_cases(spark, str(tmp_path / "d.json")).collect()}
    assert found["5"]["retrieval_query"] == "e\nq?" and found["5"]["source_task"] == "questanswer_2docs"
    assert sorted(r["task"] for r in found.values()) == ["quest_answer", "quest_answer", "summary"]
    (tmp_path / "l.jsonl").write_text('{"question": "a", "answer": "b"}\n\n{"title": "t", "summary": "s", "type": "summary"}\n')
    assert [r["task"] for r in cases.read_cases(spark, str(tmp_path / "l.jsonl"), ("summary",)).collect()] == ["summary"]
    with pytest.raises(ValueError):
        cases.items_of('{"other": 1}')


def test_corpus(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"id": "12", "url": "http://u", "title": "A  title: x", "date": "2024", "passages": ["one　p", " ", "two"]}))
    docs = cases.read_corpus(spark, str(tmp_path))
    rows = cases.passage_files(docs).orderBy("relative_path").collect()
    assert [r["relative_path"] for r in rows] == ["A_title_x__doc-12/A_title_x__doc-12__psg-0.txt", "A_title_x__doc-12/A_title_x__doc-12__psg-2.txt"] or "__doc-12__psg-2.txt" in rows[1]["relative_path"]
    assert rows[0]["text"].endswith("文档ID：12\n段落ID：0\n\none p\n") and rows[0]["meta"]["psg_id"] == "0"
    scan = passages.scan_passages(docs).orderBy("psg_id").collect()
    assert [(r["psg_id"], r["contents"]) for r in scan] == [(0, "one p"), (1, ""), (2, "two")] and scan[0]["doc_key"] == "12\thttp://u"
    assert cases.safe_name("../a b.txt", ("txt",)) == "a_b.txt"
    with pytest.raises(ValueError):
        cases.safe_name("x.exe", ("txt",))
