"""Readers of collections of files as documents: relative_path, title, extension, text; and of records."""

from __future__ import annotations

import html as entities
import json
import re
import zipfile
from html.parser import HTMLParser
from io import BytesIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT = ("txt", "md", "markdown", "html", "htm", "json", "docx", "epub")
# fixed value: the name of the file with metadata of its folder's files
SIDECAR = ".rag_file_metadata.json"
BLOCKED = ("source", "source_path", "relative_path", "extension")


class _Text(HTMLParser):
    """Visible text of a page, a block to a line."""

    SKIP = {"script", "style", "nav", "noscript", "template"}
    BREAK = {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "section", "article", "table", "ul", "ol", "body"}

    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.title = ""
        self.depth = 0
        self.heading = False

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.SKIP
        self.heading = tag in ("h1", "h2", "h3", "title") and not self.title
        if tag in self.BREAK:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.depth = max(0, self.depth - (tag in self.SKIP))
        self.heading = False
        if tag in self.BREAK:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.heading and data.strip():
            self.title = data.strip()
        if not self.depth:
            self.parts.append(data)


def html_text(page: str) -> tuple[str, str]:
    """Title and text."""
    parser = _Text()
    parser.feed(page)
    lines = (" ".join(x.split()) for x in "".join(parser.parts).split("\n"))
    return parser.title, "\n".join(x for x in lines if x)


def _docx(data: bytes) -> list[tuple[str, str]]:
    """Path of headings and text of each section, which begins with its heading."""
    with zipfile.ZipFile(BytesIO(data)) as z:
        xml = z.read("word/document.xml").decode("utf-8", "ignore")
    above: dict[int, str] = {}
    sections: list[tuple[str, list[str]]] = [("", [])]
    for p in re.findall(r"(?s)<w:p[ >].*?</w:p>", xml):
        words = " ".join(entities.unescape("".join(re.findall(r"(?s)<w:t(?: [^>]*)?>(.*?)</w:t>", p))).split())
        style = re.search(r'<w:pStyle w:val="(?:Heading|标题)\s*([1-3])"', p)
        if style and words:
            level = int(style[1])
            above = {n: t for n, t in above.items() if n < level} | {level: words}
            sections.append((" > ".join(above[n] for n in sorted(above)), [words]))
        elif words:
            sections[-1][1].append(words)
    return [(t, "\n".join(x)) for t, x in sections if x]


def _epub(data: bytes) -> list[tuple[str, str]]:
    with zipfile.ZipFile(BytesIO(data)) as z:
        names = z.namelist()
        opf = next((n for n in names if n.endswith(".opf")), None)
        order: list[str] = []
        if opf:
            xml = z.read(opf).decode("utf-8", "ignore")
            items = {m[1]: m[2] for m in re.finditer(r'<item\b(?=[^>]*\bid="([^"]+)")(?=[^>]*\bhref="([^"]+)")[^>]*>', xml)}
            folder = opf.rpartition("/")[0]
            order = [f"{folder}/{items[i]}".lstrip("/") for i in re.findall(r'<itemref\b[^>]*idref="([^"]+)"', xml) if i in items]
        pages = [n for n in order if n in names] + [n for n in names if re.search(r"\.x?html?$", n) and n not in order]
        found = [html_text(z.read(n).decode("utf-8", "ignore")) for n in pages]
    return [(t, x) for t, x in found if x]


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Supported files below a folder, without the sidecar: relative_path, extension, size, mtime, content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace("path", "^.*?" + re.escape(folder.rstrip("/").split(":")[-1]) + "/", "")
    rows = found.select(path.alias("relative_path"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), "content")
    return rows.where(F.col("extension").isin(*TEXT) & ~F.col("relative_path").endswith(SIDECAR))


def load_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each file, or for each section of a file that has sections. Bytes that aren't UTF-8 are left out."""

    def run(batches):
        for b in batches:
            at, pos, titles, texts = [], [], [], []
            for i, (name, ext, data) in enumerate(zip(*(b.column(c).to_pylist() for c in ("relative_path", "extension", "content")), strict=True)):
                stem = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                if ext in ("docx", "epub"):
                    parts = _docx(data) if ext == "docx" else _epub(data)
                else:
                    text = data.decode("utf-8", "ignore")
                    parts = [html_text(text)] if ext in ("html", "htm") else [("", text)]
                for j, (title, text) in enumerate(parts):
                    at.append(i)
                    pos.append(j)
                    titles.append(title or stem)
                    texts.append(text)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("relative_path", "extension")), pa.array(pos, pa.int32()), pa.array(titles, pa.string()), pa.array(texts, pa.string())], ["relative_path", "extension", "pos", "title", "text"])

    docs = list_files(spark, folder).mapInArrow(run, "relative_path string, extension string, pos int, title string, text string")
    return docs.withColumn("source", F.regexp_extract("relative_path", r"([^/]+)$", 1))


def _read_text(spark: SparkSession, path: str) -> str:
    """A small file by Hadoop's file systems; Spark's readers pass over names that begin with a dot."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(conf).open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def with_sidecar(docs: DataFrame, sidecar: str) -> DataFrame:
    """docs with meta, a map of what the sidecar's JSON says of their files; some keys are never taken."""
    spark = docs.sparkSession
    raw = spark.createDataFrame([(_read_text(spark, sidecar),)], "value string").select(F.from_json("value", "files map<string, map<string, string>>").alias("j"))
    files = raw.select(F.explode("j.files").alias("_path", "_meta"))
    meta = F.map_filter("_meta", lambda k, v: ~k.isin(*BLOCKED) & v.isNotNull())
    return docs.join(files.select("_path", meta.alias("meta")), F.col("relative_path") == F.col("_path"), "left").drop("_path")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines; blank and broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def timeseries_units(text: str) -> list[dict]:
    """Units of a payload that is a list of units, has samples, or is one unit; nothing of anything else."""
    try:
        data = json.loads(text)
    except ValueError:
        return []
    if isinstance(data, list):
        return data if all(isinstance(x, dict) and "series_id" in x for x in data) else []
    if isinstance(data, dict) and isinstance(data.get("samples"), list):
        return data["samples"]
    return [data] if isinstance(data, dict) and {"series_id", "start_time", "end_time"} <= data.keys() else []


def timeseries_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with kind: timeseries where the payload has units; else text, one document as it is."""

    @F.pandas_udf("boolean")
    def known(values: pd.Series) -> pd.Series:
        return pd.Series([bool(timeseries_units(x or "")) for x in values], dtype=bool)

    return docs.withColumn("kind", F.when(known(F.col(text)), "timeseries").otherwise("text"))


def timeseries_points(docs: DataFrame, text: str = "text") -> DataFrame:
    """series_id, timestamp, channel and value of each point in documents of time series."""

    def run(batches):
        for b in batches:
            rows = [
                (str(u["series_id"]), str(p.get("timestamp", "")), str(c).strip(), float(v))
                for t in b.column(text).to_pylist()
                for u in timeseries_units(t or "")
                for p in u.get("points") or []
                for c, v in (p.get("values") or {}).items()
                if v is not None
            ]
            s, t, c, v = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.string()), pa.array(t, pa.string()), pa.array(c, pa.string()), pa.array(v, pa.float64())], ["series_id", "timestamp", "channel", "value"])

    return docs.select(text).mapInArrow(run, "series_id string, timestamp string, channel string, value double")
