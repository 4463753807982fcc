"""Text functions, filters, splitters, selection and measures on small cases."""

import datetime
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.functions import profiles as P
from quarry.functions import text as T
from quarry.operators import dense, evaluate, fusion, index, memory, references, rerank, split, timeseries
from quarry.operators.filters import Condition, compile_filter
from quarry.plans.search import build_index, search
from quarry.sources import files
from quarry.streaming import jobs


@pytest.fixture
def one(spark):
    def value(expression, **columns):
        names, values = zip(*columns.items(), strict=True) if columns else (("x",), (0,))
        schema = ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'string' if isinstance(v, str) or v is None else 'double'}" for n, v in zip(names, values, strict=True))
        return spark.createDataFrame([values], schema).select(expression.alias("v")).first()["v"]

    return value


@pytest.mark.parametrize(
    "text,terms",
    [
        ("A-1 b.c/d x", ["a-1", "b.c/d", "bcd", "x"]),
        ("数据库 v2.0", ["v2.0", "v20", "数据", "据库"]),
        ("字", ["字"]),
        (None, []),
    ],
)
def test_match_terms(one, text, terms):
    assert one(T.match_terms(F.col("t")), t=text) == terms


def test_normal_forms(one):
    assert one(T.normalize_search(F.col("t")), t="A-b 中。c") == "ab中c"
    assert one(T.collapse(F.col("t")), t="　a \t b　") == "a b"
    assert one(T.distinct_strings(F.col("t")), t=[" a", "b", "", "a ", None]) == ["a", "b"]
    assert one(T.rerank_text(F.col("t"), 6), t=" - a  bcdefgh") == "a bcd…"
    assert one(T.clip(F.col("t"), 30), t="x" * 26 + "，" + "y" * 20) == "x" * 26
    assert one(T.clip(F.col("t"), 10), t="a，" + "y" * 20) == "a，" + "y" * 8
    assert one(T.fingerprint(F.col("t"), 5), t="É-a 中_9 b") == "éa中_9"
    assert one(T.slug(F.col("t")), t=" A b! ") == "a-b"
    assert one(P.requirement_parts(F.col("t")), t="查一；查二以及查三") == ["查一", "查二以及查三", "查二", "查三"]


def test_dates(one):
    assert one(T.years(F.col("t")), t="in 1999, 20245 or 2024年") == [1999, 2024]
    days = one(T.date_ordinals(F.col("t")), t="2024-02-30, 2024-02-29 and 2023年1月2日")
    assert days == [datetime.date(2024, 2, 29).toordinal(), datetime.date(2023, 1, 2).toordinal()]
    assert one(T.sample_id(F.col("t")), t="a/0123456789abcdef01234567/b") == "0123456789abcdef01234567"
    assert one(fusion.temporal_anchor(F.col("t")), t="in 2020 and 2019") == datetime.date(2020, 12, 31).toordinal()


def test_json_and_urls(one):
    assert one(T.json_object(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(T.json_object(F.col("t")), t="{no") is None
    assert one(T.normal_url(F.col("t")), t="https://x.y/l/?uddg=https%3A%2F%2Fa.b%2Fc&x=1") == "https://a.b/c"
    assert one(T.web_host_valid(F.col("t")), t="ftp://a") is False


def test_filters(spark):
    rows = spark.createDataFrame([("a", 5), ("b", None), (None, 1)], "k string, n int")
    count = lambda c, m="and": rows.where(compile_filter(c, m)).count()
    assert count([]) == 3
    assert count([Condition("k", "!=", "a")]) == 1
    assert count([Condition("k", ">", 1)]) == 0
    assert count([Condition("n", ">", "1"), Condition("k", "exists", "no")], "or") == 2
    assert count([Condition("k", "in", "a")]) == 0 and count([Condition("k", "nin", "a")]) == 2
    with pytest.raises(ValueError):
        compile_filter([Condition("k", "~", 1)])


def test_recursive_chunks():
    text = "一二三。四五六。七八九。"
    assert split.recursive_chunks(text, 5, 0) == ["一二三", "。四五六", "。七八九。"]
    assert split.recursive_chunks("abcdefghij", 4, 2) == ["abcd", "cdef", "efgh", "ghij"]
    assert split.recursive_chunks("", 4, 2) == []
    assert all(len(c) <= 20 for c in split.recursive_chunks("some words here. " * 30, 20, 5))


def test_sentences_and_sections():
    assert split.sentence_units("短。这是一个足够长的句子吗？好", 5, 30) == ["短。这是一个足够长的句子吗？ 好"]
    assert split.sentence_units("", 5, 30) == []
    page = "# A\ntext a\n---\n## B\n```\n# no\n```\nend"
    assert split.markdown_sections(page) == [("A", "text a"), ("A / B", "```\n# no\n```\nend")]
    assert split.markdown_sections(page, 10)[0] == ("A / B", "A\ntext a\n\n```\n# no\n```\nend")


def test_families(spark):
    rows = [(1, i, d, f, i) for i, (d, f) in enumerate([("a", "x"), ("a", "y"), ("b", "x"), ("c", "z")])]
    found = rerank.diversify_families(spark.createDataFrame(rows, "query_id int, id int, doc string, family string, rank int"), "doc", "family", 3)
    assert [r["id"] for r in found.orderBy("place").collect()] == [0, 3, 2]


def test_dense_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "id long, v array<double>")
    asked = rows.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    want = sorted(map(tuple, dense.dense_topk(asked, rows, 4).collect()))
    monkeypatch.setattr(dense, "BROADCAST_NUMBERS", 0)
    monkeypatch.setattr(dense, "BLOCK", 2)
    assert sorted(map(tuple, dense.dense_topk(asked, rows, 4).collect())) == want


def test_index(spark):
    schema = "relative_path string, size long, mtime double, sha256 string"
    old = spark.createDataFrame([("a", 1, 1.0, "x"), ("b", 1, 1.0, "y"), ("c", 1, 1.0, "z")], schema)
    new = spark.createDataFrame([("a", 1, 1.0, "?"), ("b", 1, 2.0, "y"), ("d", 1, 1.0, "n")], schema)
    kinds = {r["relative_path"]: r["kind"] for r in index.rebuild_plan(old, new).collect()}
    assert kinds == {"a": "reuse", "b": "reuse", "c": "deleted", "d": "new"}
    assert index.index_mode(index.rebuild_plan(old, old)).first()["mode"] == "reuse"
    assert index.index_mode(index.rebuild_plan(old.limit(0), new)).first()["mode"] == "append"


def test_measures(spark):
    ranks = spark.createDataFrame([(1, 10, 1), (1, 11, 3), (2, 12, None)], "query_id int, positive int, rank int")
    m = {r["query_id"]: r for r in evaluate.measures(ranks, 5).collect()}
    assert m[1]["recall"] == 1 and m[1]["mrr"] == 1 and abs(m[1]["ndcg"] - 1.5 / 1.6309297535714575) < 1e-9
    assert m[2]["mrr"] == 0 and m[2]["all_covered"] == 0
    pair = spark.createDataFrame([(1, "甲乙 丙", "乙丙丁")], "k int, a string, b string")
    assert abs(pair.select(evaluate.rouge_l("a", "b").alias("r")).first()["r"] - 2 / 3) < 1e-9


def test_grades(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.7), (2, 0.6), (3, 0.1)], "query_id int, relevance double")
    assert {r["query_id"]: r["grade"] for r in references.grade(rows).collect()} == {1: "relevant", 2: "partial", 3: "insufficient"}


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"plain \xff text")
    (tmp_path / "sub/b.MD").write_text("# T\nbody")
    (tmp_path / "c.html").write_text("<title>Page</title><script>x</script><p>Hello <b>you</b></p>")
    (tmp_path / "skip.bin").write_bytes(b"x")
    (tmp_path / "t.json").write_text('{"samples": [{"series_id": "s", "points": [{"timestamp": "t1", "values": {"a": 1, "b": 2.5}}]}]}')
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:p ><w:pStyle w:val="Heading1"/><w:t>Head</w:t></w:p><w:p ><w:t>Body</w:t></w:p>')
    (tmp_path / ".rag_file_metadata.json").write_text('{"files": {"a.txt": {"date": "2024-01-01", "source": "no"}}}')
    docs = files.load_documents(spark, str(tmp_path))
    found = {r["relative_path"]: (r["title"], r["text"]) for r in docs.collect()}
    assert found["a.txt"] == ("a", "plain  text") and found["sub/b.MD"] == ("b", "# T\nbody")
    assert found["c.html"][1].splitlines()[-1] == "Hello you" and found["d.docx"] == ("Head", "Head\nBody")
    assert "skip.bin" not in found
    meta = {r["relative_path"]: r["meta"] for r in files.with_sidecar(docs, str(tmp_path / ".rag_file_metadata.json")).collect()}
    assert meta["a.txt"] == {"date": "2024-01-01"} and meta["sub/b.MD"] is None
    points = files.timeseries_points(docs.where("extension = 'json'")).orderBy("channel").collect()
    assert [tuple(p) for p in points] == [("s", "t1", "a", 1.0), ("s", "t1", "b", 2.5)]


def test_timeseries(spark):
    rows = [("s", "a", i, v) for i, v in enumerate([1.0, 5.0, 5.0, 2.0])] + [("s", "b", 0, 1.0)]
    stats = timeseries.channel_stats(spark.createDataFrame(rows, "s string, c string, t int, v double"), "s", "c", "t", "v").collect()
    assert len(stats) == 1 and stats[0]["high_at"] == 1 and stats[0]["delta"] == 1.0


def test_search(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Red apples grow on trees.", "s"), (2, "Blue whales swim in the sea.", "s"), (3, "Green apples are sour.", "t")], "doc_id long, text string, source string")
    chunks = build_index(docs, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "apples"), (2, "whales sea")], "query_id int, query string")
    first = {r["query_id"]: r["doc_id"] for r in search(chunks, asked).where("place = 1").collect()}
    assert first[1] in (1, 3) and first[2] == 2
    only = search(chunks, asked, conditions=[Condition("source", "==", "t")]).collect()
    assert {r["doc_id"] for r in only} == {3}


def test_streaming(spark, tmp_path):
    rows = spark.createDataFrame([(i % 2, i) for i in range(20)], "conv_id long, turn int")
    rows.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("conv_id long, turn int").json(str(tmp_path / "in"))
    done = jobs.closed_episodes(stream).writeStream.format("memory").queryName("episodes").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    done.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("episodes").collect()) == [(0, 0, 8), (1, 0, 8)]
    batch = memory.episodes(memory.number_turns(rows.withColumn("role", F.lit("user")).withColumn("text", F.lit("x"))))
    assert batch.where("closed").count() == 2
    log = jobs.append_log(stream, str(tmp_path / "log"), str(tmp_path / "c2"))
    log.awaitTermination(120)
    assert files.read_jsonl(spark, str(tmp_path / "log"), "conv_id long, turn int").count() == 20
