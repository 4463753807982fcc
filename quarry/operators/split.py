"""Splitters: sentences, recursive character chunks, Markdown sections. Sequential by nature, so Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import deque
from itertools import accumulate, takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: separators in the order in which they are tried
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", "：", "，", " ", "")
SENTENCE_END = re.compile(r"(?<=[。！？!?；;])|\n+")
CLAUSE_END = re.compile(r"(?<=[，,、：:])")
HEADER = re.compile(r"^(#{1,3})\s+(.*\S)\s*$")
RULES = {"---", "***", "___"}


def recursive_chunks(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most size characters where separators allow it, each beginning with up to overlap
    characters of the one before. A separator stays at the beginning of what follows it."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, rest = separators[at], separators[at + 1 :]
    if mark:
        first, *others = text.split(mark)
        pieces = [p for p in (first, *(mark + o for o in others)) if p]
    else:
        pieces = list(text)
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        out.extend(_windows(held, size, overlap))
        held.clear()

    for piece in pieces:
        if len(piece) < size:
            held.append(piece)
            continue
        flush()
        out.extend(recursive_chunks(piece, size, overlap, rest) if rest else [piece])
    flush()
    return out


def _windows(pieces: list[str], size: int, overlap: int) -> list[str]:
    out, window, total = [], [], 0
    for piece in pieces:
        if window and total + len(piece) > size:
            out.append("".join(window).strip())
            while window and (total > overlap or total + len(piece) > size):
                total -= len(window.pop(0))
        window.append(piece)
        total += len(piece)
    out.append("".join(window).strip())
    return [x for x in out if x]


def _runs(sizes: list[int], enough: int) -> list[slice]:
    """Ranges of neighbours, each just long enough in total; the last one may fall short."""
    upto = [0, *accumulate(sizes)]
    runs, at = [], 0
    while at < len(sizes):
        end = min(len(sizes), max(at + 1, bisect_left(upto, upto[at] + enough)))
        runs.append(slice(at, end))
        at = end
    return runs


def _clauses(sentence: str, most: int) -> list[str]:
    """A sentence in as few runs of whole clauses as a limit of characters allows."""
    clauses = [c for c in map(str.strip, CLAUSE_END.split(sentence)) if c]
    upto = [0, *accumulate(map(len, clauses))]
    out, at = [], 0
    while at < len(clauses):
        end = max(at + 1, bisect_right(upto, upto[at] + most) - 1)
        out.append("".join(clauses[at:end]))
        at = end
    return out


def sentence_units(text: str, least: int, most: int) -> list[str]:
    """Sentences of least to most characters. A longer sentence becomes runs of clauses; parts below least join those that
    follow until they reach it, unless that is too long, in which case the last part stands alone and what is short goes.
    What is short at the end joins the last unit after a space."""
    sentences = [s for s in map(str.strip, SENTENCE_END.split(text.strip())) if s]
    parts = [p for s in sentences for p in ([s] if len(s) <= most else _clauses(s, most))]
    units: list[str] = []
    for run in _runs([len(p) for p in parts], least):
        own = parts[run]
        whole = "".join(own)
        if len(whole) < least:  # only the last run
            units[-1:] = [f"{units[-1]} {whole}"] if units else []
        elif len(whole) > most and len(own) > 1:
            units.append(own[-1])
        else:
            units.append(whole)
    return [u for u in units if len(u) >= least]


def markdown_sections(text: str, least: int = 0) -> list[tuple[str, str]]:
    """Header path and content of each section; headers and rules inside code fences are content. A section shorter than
    least joins the neighbour that shares more of its headers, the longer one if both share as much, with its title."""
    path: list[str] = ["", "", ""]
    found: list[tuple[tuple[str, ...], str]] = []
    lines: list[str] = []
    fenced = False

    def close() -> None:
        content = "\n".join(lines).strip()
        if content:
            found.append((tuple(filter(None, path)), content))
        lines.clear()

    for line in text.split("\n"):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        header = None if fenced else HEADER.match(line)
        if header:
            close()
            level = len(header[1])
            path[level - 1 :] = [header[2]] + [""] * (3 - level)
        elif fenced or line.strip().replace(" ", "") not in RULES:
            lines.append(line)
    close()
    return [(" / ".join(where), content) for where, content in joined_sections(found, least, _nearer)]


def _titled(where: tuple[str, ...], content: str) -> str:
    title = where[-1] if where else ""
    return content if content.startswith(title) else f"{title}\n{content}"


def _nearer(own: tuple, before: tuple, after: tuple) -> bool:
    """Whether a short section belongs to the one after it."""
    shared = lambda other: sum(1 for _ in takewhile(lambda p: p[0] == p[1], zip(own[0], other[0], strict=False)))
    return (shared(after), len(after[1])) >= (shared(before), len(before[1]))


def joined_sections(found: list[tuple], least: int, forward, short=None) -> list[tuple]:
    """Sections (where, content), short ones joined to a neighbour: forward(own, before, after) says to which where there are both.
    short: which sections are, by default those of fewer than least characters."""
    short = short or (lambda s: len(s[1]) < least)
    todo, done = deque(found), []
    while todo:
        own = todo.popleft()
        alone = not todo and not done
        if alone or not short(own):
            done.append(own)
        elif todo and (not done or forward(own, done[-1], todo[0])):
            todo[0] = (todo[0][0], f"{_titled(*own)}\n\n{todo[0][1]}")
        else:
            done[-1] = (done[-1][0], f"{done[-1][1]}\n\n{_titled(*own)}")
    return done


# fixed value: lines of at most 80 characters that begin a section of a text without markup
HEADING = re.compile(r"(?:[一二三四五六七八九十]+、.+|\d+\.\d+(?:\.\d+)?\s*.+|[（(]\s*\d+\s*[)）].+|(?:拆卸|安装|检查|测量|调整).+)$")
HEADING_CHARS, HEADING_ONLY = 80, 40


def _is_heading(line: str) -> bool:
    plain = " ".join(line.split())
    return 0 < len(plain) <= HEADING_CHARS and HEADING.match(plain) is not None


def structure_sections(text: str, least: int = 0) -> list[tuple[str, str]]:
    """Title and content of each section of a text whose headings are numbered lines. Sections shorter than least, or of little
    but their heading, join the next one, the last one the one before."""
    groups: list[list[str]] = [[]]
    for line in map(str.strip, text.splitlines()):
        if _is_heading(line):
            groups.append([])
        if line:
            groups[-1].append(line)
    found = [((g[0],), "\n".join(g)) for g in groups if g]

    def short(section: tuple) -> bool:
        (title,), content = section
        lines = [x for x in content.splitlines() if x]
        return len(content) < least or content == title or len(lines) <= 2 and lines[0] == title and len(content) < HEADING_ONLY

    return [(where[0], content) for where, content in joined_sections(found, least, lambda *_: True, short)]


def _explode(docs: DataFrame, id_col: str, text_col: str, cut, kind: str) -> DataFrame:
    def run(batches):
        for b in batches:
            pos, texts, at = [], [], []
            for i, text in enumerate(b.column(text_col).to_pylist()):
                parts = cut(text or "")
                at += [i] * len(parts)
                pos += range(len(parts))
                texts += parts
            yield pa.RecordBatch.from_arrays([b.column(id_col).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(texts, pa.string())], [id_col, "pos", kind])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, pos int, {kind} string")


def chunk_documents(docs: DataFrame, size: int, overlap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _explode(docs, id_col, text_col, lambda x: recursive_chunks(x, size, overlap), "chunk")


def split_sentences(docs: DataFrame, least: int, most: int, limit: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _explode(docs, id_col, text_col, lambda x: sentence_units(x, least, most)[:limit], "sentence")


def chunk_markdown(docs: DataFrame, size: int, overlap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    least = max(120, min(360, overlap + 120))

    def cut(text: str) -> list[str]:
        return [c for _, s in markdown_sections(text, least) for c in recursive_chunks(s, size, overlap)] or recursive_chunks(text, size, overlap)

    return _explode(docs, id_col, text_col, cut, "chunk")


def chunk_structured(docs: DataFrame, size: int, overlap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    least = max(100, min(320, overlap + 100))

    def cut(text: str) -> list[str]:
        return [c for _, s in structure_sections(text, least) for c in recursive_chunks(s, size, overlap)] or recursive_chunks(text, size, overlap)

    return _explode(docs, id_col, text_col, cut, "chunk")


SPLITTERS = {"md": chunk_markdown, "pdf": chunk_structured}


def chunk_by_kind(docs: DataFrame, size: int, overlap: int, id_col: str = "doc_id", text_col: str = "text", kind_col: str = "extension") -> DataFrame:
    """Chunks of each document by the splitter for its extension, the recursive one for all others."""
    kind = F.coalesce(F.lower(F.regexp_replace(kind_col, r"^\.", "")), F.lit(""))
    parts = [cut(docs.where(kind == name), size, overlap, id_col, text_col) for name, cut in SPLITTERS.items()]
    every = chunk_documents(docs.where(~kind.isin(*SPLITTERS)), size, overlap, id_col, text_col)
    for p in parts:
        every = every.unionByName(p)
    return every


def sentence_entries(chunks: DataFrame, least: int, most: int, limit: int, id_col: str = "chunk_id", text_col: str = "text", modality_col: str = "source_modality") -> DataFrame:
    """Entries of the sentence index: sentence_id, parent and sentence, limit at most of each chunk; none of images."""
    kept = chunks.where(~F.coalesce(F.lower(F.trim(modality_col)), F.lit("text")).isin("vision", "image"))
    rows = split_sentences(kept, least, most, limit, id_col, text_col)
    return rows.select(F.concat(F.col(id_col).cast("string"), F.lit("::sent-"), F.lpad((F.col("pos") + 1).cast("string"), 3, "0")).alias("sentence_id"), F.col(id_col).alias("parent"), "sentence")


def answer_segments(text):
    """Column form: parts between sentence ends, of two characters or more."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[\n。！？!?；;]+"), lambda x: F.trim(x)), lambda x: F.length(x) >= 2)


def char_pieces(docs: DataFrame, size: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of size characters of each text, the last one shorter, with its position from 0; none of an empty one."""
    # one pass over a text: a substring at a position would count its characters from the beginning, for each piece
    return docs.select(id_col, F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{int(size)}}}"), F.lit(0))).alias("pos", "piece"))
