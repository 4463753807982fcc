"""Byte-level BPE encoding and decoding.

Texts are cut by the vocabulary's pattern into words. Spark's higher-order functions fold ranked merges over the
byte arrays of distinct words: the state is an array with an element for each piece, which has the rank of the
pair that it begins, its place and its id; a step merges the first pair of least rank and looks up the pairs on
both sides in a literal map from pair to rank (cut into buckets, as Spark scans maps). What remains is the word's ids.

Words that are met often are folded once for all tasks: those of the first SEEN_ROWS documents of the first
SEEN_TASKS partitions, the most frequent ones up to about MAX_KNOWN, are counted by a shuffle, folded in parallel and
broadcast with their ids. This saves work and decides nothing else: each task hands on the distinct words of its own
documents that are not among them once, to be folded, and then the documents as places among all words. The task
then puts its documents' ids together; decoding concatenates the binary pieces of the ids. A word of more than
LONG bytes, for which a step over the whole array would take too long, is merged with a heap instead.

A task forgets its words at MAX_WORDS, and documents wait for theirs to no more than BLOCK_BYTES of text, so
memory is bounded but for one very long document. No text is shuffled, and nothing broadcast but the
vocabulary, which is literal, and the frequent words. Defined results: null counts as empty; an empty text has no
ids; long texts and words are encoded whole; texts of special tokens are ordinary text; rows are independent, so
repeated rows and ids are kept; an empty table gives none; columns of docs keep their names and values, but for
the text and for ones named as those that are added, which these replace.
"""

from __future__ import annotations

import base64
import heapq
from collections import Counter, defaultdict
from functools import cached_property, lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, keep, releasing, short_plans, small_batches, tidy

BLOCK_BYTES = 4 << 20
MAX_WORDS = 600_000
ROWS = 10_000
PART_WORDS = 200_000
SEEN_ROWS, SEEN_TASKS, MAX_KNOWN = 512, 64, 300_000
LONG = 512


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Rank by bytes; a line of the file has a token in base 64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


@lru_cache(maxsize=4)
def merges(path: str) -> dict[int, int]:
    """The rank map by pair: left id * 65536 + right id, for each way to cut a token in two tokens."""
    known = ranks(path)
    if max(known.values()) >= 1 << 16:
        raise ValueError("a vocabulary of at most 65,536 tokens is supported")
    return {known[a] << 16 | known[b]: r for x, r in known.items() for i in range(1, len(x)) if (a := x[:i]) in known and (b := x[i:]) in known}


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


#: An element of the fold's array: the rank of the pair that it begins, its place (array_position would find
#: it too, but takes microseconds, as it leaves its loop by an exception) and its id.
PLACE, RANK = 16, 43
NONE = (1 << 17) - 1


def rank_map(path: str) -> tuple[Column, int]:
    """The literal rank map: buckets of entries pair << 17 | rank, and how many buckets."""
    table: dict[int, list[int]] = {}
    n = 1 << (len(merges(path))).bit_length()
    for k, r in merges(path).items():
        table.setdefault((k ^ k >> 11) & n - 1, []).append(k << 17 | r)
    text = "[" + ",".join("[" + ",".join(map(str, table.get(b, []))) + "]" for b in range(n)) + "]"
    return F.from_json(F.lit(text), "array<array<long>>"), n


def fold_merges(word: Column, steps: Column, path: str) -> Column:
    """The ids of a word. word: an element for each byte, and how many merges it may take, as byte_elements() makes them."""
    known, n = rank_map(path)
    ID, TAIL, AT = F.lit((1 << PLACE) - 1), F.lit((1 << RANK) - 1), F.lit((1 << RANK) - (1 << PLACE))

    def rank(k: Column) -> Column:
        bucket = known[k.bitwiseXOR(F.shiftright(k, 11)).bitwiseAND(F.lit(n - 1)).cast("int")]
        return F.aggregate(bucket, F.lit(NONE).cast("long"), lambda r, x: F.when(F.shiftright(x, 17) == k, x.bitwiseAND(F.lit(NONE))).otherwise(r))

    def merge(s: Column, least: Column, p: Column) -> Column:
        new = F.shiftright(least, RANK)
        no_pair = F.lit(-1).cast("long")
        left = F.when(p > 1, F.shiftleft(s[p - 2].bitwiseAND(ID), PLACE) + new).otherwise(no_pair)
        right = F.when(p + 1 < F.size(s), F.shiftleft(new, PLACE) + s[p + 1].bitwiseAND(ID)).otherwise(no_pair)

        def put(r: Column) -> Column:
            own = F.shiftleft(r[1], RANK) + least.bitwiseAND(AT) + new
            before = F.array(F.shiftleft(r[0], RANK) + s[p - 2].bitwiseAND(TAIL), own)
            after = F.transform(F.slice(s, p + 2, F.size(s)), lambda x: x - F.lit(1 << PLACE))
            # flatten, as concat takes longer here
            return F.when(p > 1, F.flatten(F.array(F.slice(s, F.lit(1), p - 2), before, after))).otherwise(F.flatten(F.array(F.array(own), after)))

        # the map stands in the plan once
        return _let(F.transform(F.array(left, right), lambda k: F.when(k < 0, F.lit(NONE).cast("long")).otherwise(rank(k))), put)

    def step(s: Column, _: Column) -> Column:
        return _let(F.array_min(s), lambda m: F.when(m >= NONE << RANK, s).otherwise(_let((F.shiftright(m.bitwiseAND(TAIL), PLACE) + 1).cast("int"), lambda p: merge(s, m, p))))

    done = F.aggregate(F.slice(word, F.lit(1), steps), word, step)
    return F.transform(done, lambda x: x.bitwiseAND(ID).cast("int"))


def heap_merges(word: bytes, whole: dict[bytes, int]) -> list[int]:
    """The ids of a word by the same merges, in about the time of a sort."""
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def push(i: int) -> None:
        if i >= 0 and end[i] < n:
            rank = whole.get(word[i : end[end[i]]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[i], end[end[i]]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, middle, last = heapq.heappop(heap)
        if alive[i] and end[i] == middle and alive[middle] and end[middle] == last:
            end[i], alive[middle] = last, False
            if last < n:
                before[last] = i
            push(before[i])
            push(i)
    return [whole[word[i : end[i]]] for i in range(n) if alive[i]]


def byte_elements(words: list[str], known: np.ndarray, pair: np.ndarray, whole: dict[bytes, int]) -> tuple[pa.Array, pa.Array]:
    """For each word the array that the fold begins with, an element for each byte, and the fold's steps; for a word
    that is a token itself, as the library has it, and for a long one, its ids and no steps. known, pair: as
    byte_tables() gives them; whole: rank by bytes."""
    raw = [x.encode() for x in words]
    ready = {i: [t] if (t := whole.get(x)) is not None else heap_merges(x, whole) for i, x in enumerate(raw) if len(x) > LONG or x in whole}
    size = np.fromiter((len(ready[i]) if i in ready else len(x) for i, x in enumerate(raw)), np.int64, len(raw))
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    fold = np.ones(len(raw), bool)
    fold[list(ready)] = False
    inner = np.repeat(fold, size)
    data = np.zeros(total, np.uint8)
    data[inner] = np.frombuffer(b"".join(x for i, x in enumerate(raw) if i not in ready), np.uint8)
    rank = np.full(total, NONE, np.int64)
    if total:
        rank[:-1] = pair[data[:-1], data[1:]]
        rank[end[size > 0] - 1] = NONE
        rank[~inner] = NONE
    ids = known[data]
    ids[~inner] = [t for i in sorted(ready) for t in ready[i]]
    place = np.arange(total) - np.repeat(end - size, size)
    arrays = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]), pa.int32()), pa.array(rank << RANK | place << PLACE | ids))
    return arrays, pa.array(np.where(fold, np.maximum(size - 1, 0), 0), pa.int32())


@lru_cache(maxsize=4)
def byte_tables(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The id of each byte, and the rank of each pair of bytes."""
    known = np.array([ranks(path)[bytes([i])] for i in range(256)], np.int64)
    of = merges(path)
    return known, np.array([[of.get(int(a) << 16 | int(b), NONE) for b in known] for a in known], np.int64)


def _gather(flat: np.ndarray, at: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """The runs flat[at[i]:at[i + 1]] for i in pick, one after another."""
    size = at[pick + 1] - at[pick]
    end = np.cumsum(size)
    return flat[np.arange(end[-1] if len(end) else 0) + np.repeat(at[pick] - end + size, size)]


def _binary(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


class Known:
    """Words with places from 0, and their ids. A worker makes the look-up table when it first needs it."""

    def __init__(self, words: pa.Array, flat: np.ndarray, at: np.ndarray):
        self.words, self.flat, self.at = words, flat, at

    @cached_property
    def place(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.words.to_pylist())}


def frequent_words(docs: DataFrame, path: str, cutter: str, text_col: str) -> Known:
    """The words of some documents, the most frequent ones, with their ids."""
    from pyspark import TaskContext

    tables = (*byte_tables(path), ranks(path))

    def seen(batches):
        found: Counter[str] = Counter()
        if TaskContext.get().partitionId() < SEEN_TASKS:
            find, left = regex.compile(cutter).findall, SEEN_ROWS
            for batch in batches:
                for text in batch.column(0).slice(0, left):
                    found.update(find(text.as_py() or ""))
                left -= batch.num_rows
                if left <= 0:
                    break
        words = [w for w in found if len(w) <= LONG // 4]
        for lo in range(0, len(words), ROWS):
            part = words[lo : lo + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([found[w] for w in part], pa.int64())], ["word", "n"])

    def elements(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *byte_elements(batch.column(0).to_pylist(), *tables)], ["word", "e", "steps"])

    counts = docs.select(text_col).mapInArrow(releasing(seen), "word string, n long")
    counts = keep(counts.groupBy("word").agg(F.sum("n").alias("n")))
    least, total = 1, 0
    for r in counts.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).collect():  # at most 10,000 rows
        total += r["words"]
        if total > MAX_KNOWN:
            least = r["n"] + 1
            break
    parts = 4 * docs.sparkSession.sparkContext.defaultParallelism
    # kept, so that the plan that holds the literal map has no exchange and is optimised once
    wanted = keep(counts.where(F.col("n") >= least).select("word").repartition(parts, "word"))
    made = wanted.mapInArrow(elements, "word string, e array<long>, steps int").select("word", fold_merges(F.col("e"), F.col("steps"), path).alias("ids")).toArrow()
    ids = made.column("ids").combine_chunks()
    size = np.diff(ids.offsets.to_numpy()) if len(ids) else np.zeros(0, np.int64)
    words = pa.array(made.column("word").combine_chunks())
    return Known(words, ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.concatenate([[0], np.cumsum(size, dtype=np.int64)]))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", as_array: bool = True, decoded: str | None = None, carry_text: bool = False) -> DataFrame:
    """docs with ids: an array, or without as_array their little-endian unsigned 32-bit bytes.

    decoded: a column for what the ids decode to, as binary. pattern: as the vocabulary's library has it.
    The text itself is not carried along unless asked for.
    """
    small_batches(docs.sparkSession)
    short_plans(docs.sparkSession)
    columns = [f for f in docs.schema.fields if f.name not in ("ids", decoded) and (carry_text or f.name != text_col)]
    kept = [f.name for f in columns]
    _word, _steps, _places, _fresh, _ids = free(docs, "word", "steps", "places", "fresh", "ids")
    # white space as the library's engine has it
    tables = (*byte_tables(path), ranks(path))  # sent to the tasks, which don't read the vocabulary's file
    own = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    tidy(docs.sparkSession)
    often = docs.sparkSession.sparkContext.broadcast(frequent_words(docs, path, own, text_col))
    tidy(docs.sparkSession)

    def cut(batches):
        find = regex.compile(own).findall
        start = len(often.value.words)
        places: dict[str, int] = defaultdict(count(start).__next__, often.value.place)
        sent, waiting, size = start, [], 0

        def flush():
            nonlocal places, sent, waiting, size
            words = list(islice(places, sent, None))
            for lo in range(0, len(words), ROWS):
                part = words[lo : lo + ROWS]
                n = len(part)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(n, t) for t in types), *byte_elements(part, *tables), pa.nulls(n, pa.binary()), pa.array([False] * n)], names)
            sent = len(places)
            fresh = sent - start > MAX_WORDS
            for i, (batch, found) in enumerate(waiting):
                last = [False] * (len(found) - 1) + [fresh and i == len(waiting) - 1]
                n = len(found)
                yield pa.RecordBatch.from_arrays([*batch, pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int32()), pa.array(found, pa.binary()), pa.array(last)], names)
            waiting, size = [], 0
            if fresh:
                places = defaultdict(count(start).__next__, often.value.place)
                sent = start

        for batch in batches:
            own_columns = [batch.column(x) for x in kept]
            types = [x.type for x in own_columns]
            found, lo = [], 0
            for i, text in enumerate(batch.column(text_col)):
                text = text.as_py() or ""
                found.append(np.fromiter(map(places.__getitem__, find(text)), np.int32).tobytes())
                size += len(text)
                if size >= BLOCK_BYTES or i == batch.num_rows - 1:
                    waiting.append(([x.slice(lo, i + 1 - lo) for x in own_columns], found))
                    found, lo = [], i + 1
                if size >= BLOCK_BYTES:
                    yield from flush()
        if waiting:
            yield from flush()

    names = [*kept, _word, _steps, _places, _fresh]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in columns)
    lines = docs.select(*kept, *[text_col] * (not carry_text)).mapInArrow(releasing(cut), f"{fields}`{_word}` array<long>, `{_steps}` int, `{_places}` binary, `{_fresh}` boolean")
    folded = lines.select(*kept, F.when(F.col(_word).isNotNull(), fold_merges(F.col(_word), F.col(_steps), path)).alias(_ids), _places, _fresh)

    pieces = sorted(ranks(path).items(), key=lambda x: x[1])
    length = np.zeros(pieces[-1][1] + 1, np.int64)
    length[[r for _, r in pieces]] = [len(x) for x, _ in pieces]
    piece_at, piece_data = np.concatenate([[0], np.cumsum(length)]), np.frombuffer(b"".join(x for x, _ in pieces), np.uint8)
    del pieces, length

    def join(batches):
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        flat, at = often.value.flat, often.value.at

        for batch in batches:
            place = batch.column(_places)
            is_doc = np.asarray(place.is_valid())
            # runs of words and runs of documents
            edges = np.flatnonzero(np.diff(is_doc)) + 1
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                if not is_doc[lo]:
                    ids = batch.column(_ids).slice(lo, hi - lo)
                    parts.append(ids.flatten().to_numpy(zero_copy_only=False))
                    sizes.append(np.diff(ids.offsets.to_numpy()))
                    continue
                if parts:
                    flat = np.concatenate([flat, *parts])
                    at = np.concatenate([at, at[-1] + np.cumsum(np.concatenate(sizes))])
                    parts, sizes = [], []
                # documents in parts of about PART_WORDS words, all of a part's at once
                start = np.frombuffer(place.buffers()[1], np.int32)[place.offset + lo : place.offset + hi + 1].astype(np.int64)
                cuts = [0, *(np.flatnonzero(np.diff(start[:-1] // (4 * PART_WORDS))) + 1), hi - lo]
                for i, j in zip(cuts, cuts[1:], strict=False):
                    words = np.frombuffer(place.buffers()[2], np.uint8)[start[i] : start[j]].view(np.int32) if start[j] > start[i] else np.zeros(0, np.int32)
                    ids = _gather(flat, at, words)
                    count = np.concatenate([[0], np.cumsum(at[words + 1] - at[words])])
                    edges_ = count[(start[i : j + 1] - start[i]) // 4]
                    if as_array:
                        made = pa.ListArray.from_arrays(pa.array(edges_, pa.int32()), pa.array(ids, pa.int32()))
                    else:
                        made = _binary(ids.astype("<u4").view(np.uint8), 4 * edges_)
                    out = [*(batch.column(c).slice(lo + i, j - i) for c in kept), made]
                    if decoded:
                        length = np.concatenate([[0], np.cumsum(piece_at[ids + 1] - piece_at[ids])])
                        out.append(_binary(_gather(piece_data, piece_at, ids), length[edges_]))
                    yield pa.RecordBatch.from_arrays(out, [*kept, "ids", *[decoded] * bool(decoded)])
                if batch.column(_fresh)[hi - 1].as_py():
                    flat, at = often.value.flat, often.value.at

    return folded.mapInArrow(releasing(join), f"{fields}ids {'array<int>' if as_array else 'binary'}" + f", `{decoded}` binary" * bool(decoded))


def decode(ids: list[int], path: str) -> bytes:
    """The bytes of ids."""
    of = {r: x for x, r in ranks(path).items()}
    return b"".join(of[i] for i in ids)


def op6_bpe(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    import public_tokenizers

    path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    done = encode(docs.select("doc_id", "text"), path, pattern, as_array=False, decoded="decoded")
    return done.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
