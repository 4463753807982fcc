"""Each stage over edge cases, and the whole."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm.common import tidy

from .test_edges import ROWS, SCHEMA


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i == 7)) for i in range(1, 11)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage(spark, folder, name, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.lit(1) for c in ("id", "n", "component", "score", "_h")})
    made = stage(spark, docs, folder)
    assert made.columns[: len(docs.columns)] == docs.columns
    assert name == "bpe" or made.columns == docs.columns
    made.collect()
    assert stage(spark, docs.limit(0), folder).collect() == []


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and all(r["round_trip"] for r in rows)
    ids = {r["doc_id"] for r in rows}
    assert 2 not in ids  # a copy of 1


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_keeps_clashing_columns(spark, folder, name, stage):
    """Columns named as those that stages work with keep their values."""
    names = "_host _keys _kept _dropped _gone _s _c _b _key _size _block _copies _shards _word _places _steps _fresh _toxicity _back row source_size component".split()
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.lit(c + "!") for c in names})
    made = stage(spark, docs, folder)
    for r in made.select(*names).collect():
        assert all(r[c] == c + "!" for c in names)


def test_memory_is_given_back(spark, folder):
    """Executors collect their garbage too, and the driver doesn't keep the literal map in descriptions of plans."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    tidy(spark)
    assert full() >= before + 2  # by tasks, and by the driver
    store = spark._jsparkSession.sharedState().statusStore()
    n = store.executionsList().size()
    corpus_pipeline.encode(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()
    made = store.executionsList()
    assert made.size() > n and all(len(made.apply(i).physicalPlanDescription()) <= 100_000 for i in range(n, made.size()))


def test_memory_outside_the_heap_is_given_back(spark):
    """What the driver's JVM has freed outside its heap goes back to the system, though memory in use lies above it."""
    jvm = spark.sparkContext._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")
    if not status.exists():
        pytest.skip("reads /proc")
    anon = lambda: int(status.read_text().split("RssAnon:")[1].split()[0]) // 1024
    tidy(spark)
    tidy(spark)
    before = anon()
    made = [jvm.java.util.zip.Deflater() for _ in range(1000)]
    data = spark.sparkContext._gateway.new_array(jvm.byte, 1 << 16)
    for x in made:
        x.setInput(data)
        x.deflate(data)
    held = anon()
    for x in made[:-1]:
        x.end()
    tidy(spark)
    assert held > before + 100
    assert anon() < before + (held - before) / 2
