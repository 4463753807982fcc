"""Queries against their SQL in DuckDB, on tables that show what only larger or odd ones do."""

import datetime
import time

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from quarry import queries as Q
from quarry.operators import dense, evaluate, lexical, split


@pytest.fixture
def same(spark, tmp_path):
    """Writes tables (rows, schema), and compares a query with its SQL over them."""

    def run(name, **tables):
        db = duckdb.connect()
        db.execute("set TimeZone = 'UTC'")
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
            db.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
        Q.QUERIES[name](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out-{name}")
        db.execute(f"create table o as {Q.SQL[name]}")
        db.execute(f"create table s as select * from '{tmp_path}/out-{name}/*.parquet'")
        columns = sorted(r[0] for r in db.execute("describe o").fetchall())
        assert columns == sorted(r[0] for r in db.execute("describe s").fetchall())
        some = ", ".join(f'"{c}"' for c in columns)
        for a, b in (("o", "s"), ("s", "o")):
            assert db.execute(f"select {some} from {a} except all select {some} from {b} limit 3").fetchall() == []
        return db.execute("select count(*) from s").fetchone()[0]

    return run


EVENTS = "event_id long, user_id long, ts timestamp_ntz"


def test_gaps_near_the_limit(same):
    """Gaps of 7,200 seconds and fractions, which whole seconds decide, and times that are null."""
    at, rows = datetime.datetime(2024, 1, 1), []
    for user, (a, b) in enumerate([(0.4, 7200.6), (0.6, 7200.7), (0.6, 7201.4), (0.5, 7201.5), (1.5, 7201.5), (0.499999, 7200.5), (0.2, 7201.1)]):
        rows += [(len(rows), user, at + datetime.timedelta(seconds=a)), (len(rows) + 1, user, at + datetime.timedelta(seconds=b))]
    rows += [(100, 3, None), (101, 3, None), (102, 50, None), (103, None, at), (104, None, at)]
    assert same("ttl_expiry", events=(rows, EVENTS)) > 8


def test_more_than_9999_chunks(same):
    rows = [(i, "x", "en", "s", 1) for i in range(10_012)] + [(20_000, "x", "en", None, 1), (20_001, "x", "en", "t", 1)]
    assert same("chunk_numbering", documents=(rows, "doc_id long, text string, lang string, source string, n_chars long")) == len(rows)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pieces_of_a_long_text_take_one_pass(spark):
    """A substring at each position takes time by the square of the length: minutes for this text."""
    text = "añ🙂\n" * 500_000
    rows = split.char_pieces(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string"))
    began = time.perf_counter()
    found = [r["piece"] for r in rows.orderBy("pos").collect()]
    assert "".join(found) == text and {len(x) for x in found} == {16}
    assert time.perf_counter() - began < 60


def test_many_vectors_meet_in_tiles(monkeypatch):
    """No matrix of distances is larger than a tile, and ties at a tile's end stay in order."""
    seen, whole = [], dense._distances
    monkeypatch.setattr(dense, "_distances", lambda q, x, metric: seen.append(len(q) * len(x)) or whole(q, x, metric))
    rng = np.random.default_rng(3)
    q, x, ids = rng.integers(0, 3, (1500, 4)).astype(float), rng.integers(0, 3, (5000, 4)).astype(float), rng.permutation(5000)
    got = pa.Table.from_batches(list(dense._best(np.arange(1500), q, ids, x, 7, "l2sq")))
    assert max(seen) <= dense.TILE**2
    for i in (0, 700, 1499):
        d = ((x - q[i]) ** 2).sum(axis=1)
        want = ids[np.lexsort((ids, d))[:7]].tolist()
        assert got.filter(pc.equal(got["query_id"], i))["id"].to_pylist() == want


def texts(spark):
    words = [f"w{i % 7}.{i % 11} x{i % 5}" for i in range(60)]
    rows = [(i, " ".join(words[i % 50 : i % 50 + 1 + i % 9]), "en", "s", 1) for i in range(1200)]
    return spark.createDataFrame([*rows, (5000, "", "en", "s", 0), (5001, None, "en", "s", 0)], DOCUMENTS)


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_postings_stay_where_they_are(spark):
    tok = lexical.tokens(texts(spark))
    assert "Exchange" not in plan(lexical.postings(tok))
    plain = tok.select("id", F.explode("terms").alias("term")).groupBy("id", "term").count()
    assert sorted(lexical.postings(tok).collect()) == sorted(plain.collect())
    assert sorted(lexical.term_df(tok).collect()) == sorted(plain.groupBy("term").count().collect())


def test_repeated_ids(same):
    rows = [(1, "a b a c.d", "en", "s", 1), (1, "a e", "en", "s", 1), (2, "a", "en", "s", 1), (None, "a b", "en", "s", 1), (None, "b", "en", "s", 1)]
    assert same("term_df", documents=(rows, DOCUMENTS)) > 3


def test_best_of_many_queries(spark, tmp_path, monkeypatch):
    docs = texts(spark)
    index = lexical.write_index(docs, str(tmp_path))
    queries = spark.createDataFrame([(i, f"w{i}.{i} x{i % 5} none") for i in range(7)], "query_id long, query string")
    want = lexical.top(lexical.bm25_indexed(index, queries), 20, "query_id").select("query_id", "id", "rank").collect()
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 32)
    # postings of all terms of all queries were joined before
    assert "Join" not in plan(lexical.bm25_top(index, queries, 20))
    assert sorted(lexical.bm25_top(index, queries, 20).select("query_id", "id", "rank").collect()) == sorted(want)


def test_holders(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "xone two threes"), (3, "two"), (4, ""), (5, None), (6, "a  b\nc d"), (7, "two two")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "ne two three"), (2, "two"), (3, "a  b\nc"), (4, "one  three"), (5, "three four"), (6, " two three ")], "item_id long, passage string")
    want = docs.join(items, F.contains("text", "passage")).select("item_id", "doc_id")
    found = evaluate.holders(docs, items)
    assert sorted(found.select("item_id", "doc_id").collect()) == sorted(want.collect())
