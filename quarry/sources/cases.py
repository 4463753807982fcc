"""Sets of cases and corpora for evaluation: items in several envelopes, cases of two tasks, passages as files."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: tasks, names for them, and the fields that may hold a case's parts
TASKS = ("quest_answer", "summary")
ALIASES = {"questanswer_1doc": "quest_answer", "questanswer_2docs": "quest_answer", "questanswer_3docs": "quest_answer"}
FIELDS = {
    "case_id": ("case_id", "id", "ID", "uid", "sample_id"),
    "event": ("event", "title", "context", "instruction"),
    "question": ("question", "questions", "query_question", "ask"),
    "answer": ("answer", "answers", "gold_answer", "target_answer"),
    "summary": ("summary", "gold_summary", "target_summary"),
}
TASK_FIELDS = ("task", "task_name", "type", "category")
CASE = "case_id string, task string, source_task string, event string, question string, gold_answer string, retrieval_query string, generation_query string"


def items_of(payload: str) -> list[dict]:
    """The items of a JSON list, of data or items of a mapping, or of its lists by task; of JSON lines otherwise."""
    try:
        data = json.loads(payload.lstrip("﻿"))
    except ValueError:
        data = [json.loads(x) for x in payload.lstrip("﻿").splitlines() if x.strip()]
    if isinstance(data, list):
        return [x for x in data if isinstance(x, dict)]
    if not isinstance(data, dict):
        raise ValueError("items come as a list, as JSON lines or as a mapping")
    found = [x for k in ("data", "items") if isinstance(data.get(k), list) for x in data[k] if isinstance(x, dict)]
    for name in (*TASKS, *ALIASES):
        for x in data[name] if isinstance(data.get(name), list) else []:
            if isinstance(x, dict):
                found.append({"task": ALIASES.get(name, name), "source_task": name} | x)
    if not found and not ({"series_id", *TASK_FIELDS, "question"} & data.keys()):
        raise ValueError("no items found")
    return found or [data]


def _first(item: dict, part: str) -> str:
    values = (v for k in FIELDS[part] for v in (item[k] if isinstance(item.get(k), list) else [item.get(k)]))
    return next((s for v in values if v is not None and (s := str(v).strip())), "")


def task_of(item: dict) -> str | None:
    named = (str(item.get(k, "")).strip().lower() for k in TASK_FIELDS)
    known = next((t for n in named if (t := ALIASES.get(n, n)) in TASKS), None)
    if known:
        return known
    if _first(item, "question") and _first(item, "answer"):
        return "quest_answer"
    return "summary" if _first(item, "summary") and _first(item, "event") else None


def case_of(item: dict, number: int, tasks: tuple[str, ...] = TASKS) -> tuple | None:
    """An item as a case; none of another task, or without what its task needs."""
    task, event = task_of(item), _first(item, "event")
    question, gold = ("", _first(item, "summary")) if task == "summary" else (_first(item, "question"), _first(item, "answer"))
    asked = event if task == "summary" else question
    if task not in tasks or not gold or not asked:
        return None
    if task == "summary":
        search, make = event, f"请基于知识库检索内容，对以下事件写一段简洁摘要：\n{event}"
    else:
        search = f"{event}\n{question}" if event else question
        make = f"事件背景：{event}\n\n问题：{question}" if event else question
    return (_first(item, "case_id") or f"{task}-{number:06d}", task, str(item.get("source_task", item.get("task", ""))).strip(), event, question, gold, search, make)


def read_cases(spark: SparkSession, path: str, tasks: tuple[str, ...] = TASKS) -> DataFrame:
    """The cases of files of items, each file read whole."""
    files = spark.read.option("wholetext", "true").text(path)

    def run(batches):
        for frame in batches:
            rows = [c for payload in frame["value"] for i, x in enumerate(items_of(payload), 1) if (c := case_of(x, i, tasks))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CASE.split(", ")])

    return files.mapInPandas(run, CASE)


CORPUS = "id string, url string, title string, date string, passages array<string>"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a corpus, a JSON file for each; passages.scan_passages() makes rows of them."""
    return spark.read.schema(CORPUS).option("multiLine", "true").json(path)


def _file_part(value: Column, most: int) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.trim(value), r"(?U)\s+", "_"), r'[\\/:*?"<>|\x00]+', "_")
    clean = F.regexp_replace(clean, r"^[._]+|[._]+$", "")
    return F.substring(F.when(clean == "", "untitled").otherwise(clean), 1, most)


def passage_files(docs: DataFrame) -> DataFrame:
    """The passages of a corpus as files: relative_path, text, and meta for the sidecar; blank passages are left out."""
    one = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    doc_id = F.trim(F.coalesce("id", F.lit("")))
    title = F.coalesce(F.nullif(one(F.col("title")), F.lit("")), doc_id)
    rows = docs.select(doc_id.alias("doc_id"), title.alias("title"), one(F.col("url")).alias("url"), one(F.col("date")).alias("date"), F.posexplode("passages").alias("psg_id", "p")).withColumn("body", one(F.col("p"))).where("body <> ''")
    folder = _file_part(F.concat("title", F.lit("__doc-"), "doc_id"), 120)
    name = F.concat(_file_part(F.col("title"), 80), F.lit("__doc-"), "doc_id", F.lit("__psg-"), F.col("psg_id").cast("string"), F.lit(".txt"))
    lines = [F.concat(F.lit(label), F.col(c).cast("string")) for label, c in (("标题：", "title"), ("URL：", "url"), ("日期：", "date"), ("文档ID：", "doc_id"), ("段落ID：", "psg_id"))]
    meta = F.create_map(*[x for c in ("title", "url", "date", "doc_id") for x in (F.lit(c), F.col(c))], F.lit("psg_id"), F.col("psg_id").cast("string"), F.lit("content_type"), F.lit("document_text"), F.lit("source_modality"), F.lit("text"), F.lit("evidence_summary"), F.col("title"))
    return rows.select(F.concat_ws("/", folder, name).alias("relative_path"), F.concat(F.concat_ws("\n", *lines, F.lit(""), "body"), F.lit("\n")).alias("text"), meta.alias("meta"))


def safe_name(name: str, allowed: tuple[str, ...]) -> str:
    """An uploaded file's name without folders and odd characters; an error for kinds that aren't allowed."""
    base = re.split(r"[\\/]+", name.strip())[-1]
    clean = re.sub(r"[^\w.\-一-鿿]+", "_", base).strip("._")
    if not clean or clean.rpartition(".")[2].lower() not in allowed:
        raise ValueError(f"not an allowed file: {name!r}")
    return clean
