"""A base over a folder of files: what is read again, what counts, what is found."""

import os

from quarry.operators.dense import dense_topk
from quarry.plans import build
from quarry.plans.config import EngineConfig
from quarry.plans.search import embed, hash_embedding, search


def test_rebuild_step_by_step(spark, tmp_path):
    files, base = tmp_path / "files", str(tmp_path / "bases" / "one")
    files.mkdir()
    (files / "a.md").write_text("# Fruit\n" + "apples and pears are fruit. " * 20 + "\n## More\nplums are fruit too\n")
    (files / "b.txt").write_text("stones are not fruit. " * 30)
    made = build.rebuild(spark, str(files), base)
    assert (made.build, made.mode, made.files) == (0, "full", {"reuse": 0, "new": 2, "modified": 0, "deleted": 0})
    n = build.chunks(spark, base).count()
    assert n == sum(r["n_chunks"] for r in build.manifest(spark, base).collect()) and build.damaged(spark, base).isEmpty()
    assert build.rebuild(spark, str(files), base).mode == "reuse"
    os.utime(files / "b.txt", (1, 1))  # touched, with the same content
    assert build.rebuild(spark, str(files), base).mode == "reuse"
    (files / "c.txt").write_text("rivers run to the sea")
    made = build.rebuild(spark, str(files), base)
    assert (made.mode, made.files["new"], made.files["reuse"]) == ("append", 1, 2)
    (files / "b.txt").write_text("sand is not fruit either")
    (files / "a.md").unlink()
    made = build.rebuild(spark, str(files), base)
    assert made.mode == "full" and made.files == {"reuse": 1, "new": 0, "modified": 1, "deleted": 1}
    texts = {r["chunk_text"] for r in build.chunks(spark, base).collect()}
    assert texts == {"rivers run to the sea", "sand is not fruit either"}
    made = build.rebuild(spark, str(files), base, EngineConfig(chunk_size=10, chunk_overlap=2))
    assert made.files["modified"] == 2 and build.chunks(spark, base).count() > 2
    before = build.chunks(spark, base).count()
    build.compact(spark, base)
    assert build.chunks(spark, base).count() == before == spark.read.parquet(f"{base}/chunks").count()
    row = build.catalog(spark, str(tmp_path / "bases")).first()
    assert (row["name"], row["files"], row["chunks"]) == ("one", 2, before)


def test_search_over_a_base(spark, tmp_path):
    files, base = tmp_path / "files", str(tmp_path / "base")
    files.mkdir()
    for name, text in (("x.txt", "the sea is wide and blue. ships sail"), ("y.txt", "a garden of apples. rain falls"), ("z.txt", "apples are sold at the market!")):
        (files / name).write_text(text)
    build.rebuild(spark, str(files), base)
    asked = embed(spark.createDataFrame([(1, "apples garden")], "query_id int, query string"), "query", "v", hash_embedding())
    hits = dense_topk(asked.select("query_id", "v"), build.sentence_index(spark, base).selectExpr("xxhash64(sentence_id) as id", "v"), 3)
    names = build.sentence_index(spark, base).selectExpr("xxhash64(sentence_id) as id", "parent", "sentence")
    sentences = hits.join(names, "id").select("query_id", "parent", "sentence", "distance")
    found = search(build.chunks(spark, base), asked, index=build.lexical_index(spark, base), sentences=sentences).orderBy("place").collect()
    assert found[0]["text"].startswith("a garden of apples") and len(found) == 3
    more = spark.createDataFrame([(1, "ships"), (1, "apples sea")], "query_id int, query string")
    wide = search(build.chunks(spark, base), asked, index=build.lexical_index(spark, base), variants=more).orderBy("place").collect()
    plain = search(build.chunks(spark, base), asked, variants=more).orderBy("place").collect()  # postings made on the way
    assert [(r["id"], r["rerank_score"]) for r in wide] == [(r["id"], r["rerank_score"]) for r in plain] and len(wide) == 3
