"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Terms are words (runs of letters, lower case) and their first PREFIX bytes, so that inflected forms of a stem
meet; a beginning that a text has twice or three times is a term more for each. The vocabulary is every term of
the examples. A text's vector has (1 + ln tf) * idf * (1 + g) for each of its terms, where g is the
log-likelihood ratio of the term's counts in the two labels: about 1 for a term that they share, hundreds for
one that tells them apart. Every example is indexed under all its terms. Near copies among the examples count
once: those that share the least hash of three words, and COPY of the SKETCH least ones, with the first example
of their label that has it. At most MAX_EXAMPLES labelled rows are examples, chosen by a hash, so the index has
a bounded number of rows.

The index lays examples that are alike side by side, in blocks of BLOCK. A term's inverted list has the examples
that hold it; the COMMON terms of most examples have, beside it, their greatest weight in each block. A query
adds up its rare terms' lists. What a block can reach is then its greatest sum so far and what its maxima of the
common terms allow; blocks that can't reach the K-th best of the most promising ones are left out, the others
are added up whole. So the K nearest are exact. Their votes weigh 1 / (0.1 + 1 - cosine); the score is the
weighted share of label 1, with the labels' base rate as PRIOR votes more, and the neighbours are the evidence.

Defined results: a text that shares no term with an example (null and empty texts too) has the base rate;
without labelled examples every score is 0; long texts are scored whole; ties go to the smaller doc_id of the
examples; rows that repeat an id or a text are scored each; an empty table gives none; columns of docs keep
their names and values, but for one named as the score or the evidence, which these replace.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M1, M2, blocks, fold_case, hash_words, held_out, keep, labelled, mix, releasing, small_batches, tidy, utf8

FOLDS, HELD = 3, 1
MAX_EXAMPLES = 3_000
SKETCH, COPY = 128, 0.8
PREFIX = 6
K, QUERIES, PRIOR = 15, 32, 1.0
COMMON, BLOCK, FIRST, SLACK = 512, 64, 2, 1e-4
REJECT = 0.7

LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def _repeated(found: np.ndarray) -> np.ndarray:
    """Terms for the second and the third time that a value is found."""
    found = np.sort(found)
    twice = found[1:][found[1:] == found[:-1]]  # a value once less often than it is found
    thrice = twice[1:][twice[1:] == twice[:-1]]
    once = lambda x: x[np.append(True, x[1:] != x[:-1])] if len(x) else x
    return np.concatenate([mix(once(twice) + np.uint64(2)), mix(once(thrice) + np.uint64(3))])


def terms_of(texts: pa.Array, least: bool = False):
    """For each row the terms of its text, repeats too, as unsigned 64-bit hashes; with least, its
    SKETCH least hashes of three words instead."""
    data, at = utf8(texts)
    for lo, hi in blocks(at):
        part = fold_case(data[at[lo] : at[hi]])
        words, row, (begins,) = hash_words(part, at[lo : hi + 1], LETTERS, (PREFIX,))
        for i in range(hi - lo):
            own = slice(row[i], row[i + 1])
            if least:
                w = words[own]
                yield np.unique(mix(w[:-2] + M1 * mix(w[1:-1] + M2 * w[2:])))[:SKETCH] if len(w) > 2 else w.sum(dtype=np.uint64, keepdims=True)
                continue
            mine = begins[own]
            mine = mine[mine != 0]
            found = np.concatenate([words[own], mine, _repeated(mine)])
            yield found[found != 0]


def _alike(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sets from their least hashes; exact for sets of up to SKETCH."""
    both = np.union1d(a, b)[:SKETCH]
    return float(np.isin(both, np.intersect1d(a, b)).mean())


def _without_copies(marks: list[int], keys: list[bytes]) -> np.ndarray:
    """Which examples stay when near copies of the first of their label go."""
    first: dict[tuple, np.ndarray] = {}
    kept = []
    for i, (mark, key) in enumerate(zip(marks, keys, strict=True)):
        own = np.frombuffer(key, np.uint64)
        other = first.setdefault((int(own[0]), mark), own)
        if other is own or _alike(own, other) < COPY:
            kept.append(i)
    return np.array(kept, np.int64)


def _examples(batches):
    for batch in batches:
        texts = batch.column("text")
        made = [np.unique(x, return_counts=True) for x in terms_of(texts)]
        terms = pa.array([x.tobytes() for x, _ in made], pa.binary())
        counts = pa.array([c.astype(np.uint32).tobytes() for _, c in made], pa.binary())
        keys = pa.array([x.tobytes() for x in terms_of(texts, least=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), keys, terms, counts], ["doc_id", "mark", "key", "terms", "counts"])


def _g2(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Twice the log-likelihood ratio of a of n1 and b of n0 rows with a term."""
    share = (a + b) / (n1 + n0)

    def part(x, of):
        return np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum(of, 1e-300)), 0.0)

    return np.maximum(2 * (part(a, n1 * share) + part(n1 - a, n1 * (1 - share)) + part(b, n0 * share) + part(n0 - b, n0 * (1 - share))), 0)


class Index:
    """Unit vectors by their terms, which are numbered from those that most have."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, marks: np.ndarray):
        row, term = np.nonzero(vectors)
        self._build(row, term, vectors[row, term], vectors.shape[1], ids, marks)

    @classmethod
    def of(cls, row: np.ndarray, term: np.ndarray, value: np.ndarray, n_terms: int, ids: np.ndarray, marks: np.ndarray) -> Index:
        made = cls.__new__(cls)
        made._build(row, term, value, n_terms, ids, marks)
        return made

    def _build(self, row, term, value, n_terms, ids, marks) -> None:
        n, c = len(ids), min(COMMON, n_terms)
        self.ids, self.marks, self.c = ids, marks, c
        common = np.zeros((n, c), np.float32)
        often = term < c
        common[row[often], term[often]] = value[often]
        # examples of a label that lean on the same common term lie side by side, so that maxima are low
        lead = common.argmax(axis=1) if n and c else np.zeros(n, np.int64)
        self.row = np.lexsort((np.arange(n), lead, marks))
        place = np.empty(n, np.int64)
        place[self.row] = np.arange(n)
        self.starts = np.arange(0, n, BLOCK)
        self.common = np.ascontiguousarray(common[self.row])
        self.most = np.maximum.reduceat(self.common, self.starts, axis=0) if n else self.common
        order = np.flatnonzero(~often)
        order = order[np.lexsort((place[row[order]], term[order]))]
        self.rows, self.values = place[row[order]].astype(np.int32), value[order].astype(np.float32)
        self.at = np.concatenate([[0], np.cumsum(np.bincount(term[order] - c, minlength=max(0, n_terms - c)))]).astype(np.int64)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """Cosine and row of the k nearest with a cosine above 0, nearest first, ties by row."""
        return self.nearest_of([(terms, weights)], k)[0]

    def _rare(self, queries) -> np.ndarray:
        """For each query what the lists of its rare terms give each example."""
        total = np.zeros((len(queries), len(self.ids)))
        for i, (terms, weights) in enumerate(queries):
            own = terms >= self.c
            lists = terms[own] - self.c
            lo = self.at[lists]
            size = self.at[lists + 1] - lo
            end = np.cumsum(size)
            if len(end) and end[-1]:
                pick = np.repeat((lo - end + size).astype(np.int32), size)
                pick += np.arange(len(pick), dtype=np.int32)
                total[i] = np.bincount(self.rows[pick], self.values[pick] * np.repeat(weights[own].astype(np.float32), size), len(self.ids))
        return total

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        if not len(self.ids):
            return [[] for _ in queries]
        asked = np.zeros((len(queries), self.c), np.float32)
        for i, (terms, weights) in enumerate(queries):
            asked[i, terms[terms < self.c]] = weights[terms < self.c]
        total = self._rare(queries)
        bound = np.maximum.reduceat(total, self.starts, axis=1) + asked @ self.most.T + SLACK
        done = np.zeros(bound.shape, bool)
        first = max(1, min(len(self.starts), FIRST + k // BLOCK))
        promising = np.argpartition(-bound, first - 1, axis=1)[:, :first]
        done[np.arange(len(queries))[:, None], promising] = True
        self._add(total, asked, done)
        least = np.zeros(len(queries))
        for i in range(len(queries)):
            known = np.concatenate([total[i, b * BLOCK : (b + 1) * BLOCK] for b in promising[i]])
            least[i] = np.partition(known, len(known) - k)[len(known) - k] if len(known) >= k else 0.0
        rest = (bound >= least[:, None]) & ~done
        self._add(total, asked, rest)
        whole = np.repeat(done | rest, np.diff(np.append(self.starts, len(self.ids))), axis=1)
        found = []
        for i in range(len(queries)):
            some = np.flatnonzero(whole[i] & (total[i] >= least[i]) & (total[i] > 0))
            order = np.lexsort((self.row[some], -total[i, some]))[:k]
            found.append([(float(total[i, j]), int(self.row[j])) for j in some[order]])
        return found

    def _add(self, total: np.ndarray, asked: np.ndarray, wanted: np.ndarray) -> None:
        """Adds the common terms' part in the wanted blocks of each query."""
        for b in np.flatnonzero(wanted.any(axis=0)):
            own, who = slice(b * BLOCK, (b + 1) * BLOCK), np.flatnonzero(wanted[:, b])
            total[who, own] += asked[who] @ self.common[own].T


class Model:
    """terms: sorted; place: their numbers in the index; weight: by place."""

    def __init__(self, terms: np.ndarray, place: np.ndarray, weight: np.ndarray, rate: float, index: Index):
        self.terms, self.place, self.weight, self.rate, self.index = terms, place, weight, rate, index

    def vector(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(found) or not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0)
        found = np.sort(found)
        first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        count, found = np.diff(np.append(first, len(found))), found[first]
        at = np.minimum(np.searchsorted(self.terms, found), len(self.terms) - 1)
        known = self.terms[at] == found
        own = self.place[at[known]]
        weights = (1 + np.log(count[known])) * self.weight[own]
        return own, weights / max(np.linalg.norm(weights), 1e-300)

    def scores(self, rows):
        """The score and the evidence of each row of terms."""
        part = []
        for found in rows:
            part.append(self.vector(found))
            if len(part) == QUERIES:
                yield from self._scores(part)
                part = []
        yield from self._scores(part)

    def _scores(self, part):
        for near in self.index.nearest_of(part, K) if part else []:
            votes = [1 / (1.1 - min(c, 1.0)) for c, _ in near]
            yes = sum(v for v, (_, i) in zip(votes, near, strict=True) if self.index.marks[i])
            evidence = [{"doc_id": int(self.index.ids[i]), "label": int(self.index.marks[i]), "cosine": min(c, 1.0)} for c, i in near]
            yield (yes + PRIOR * self.rate) / (sum(votes) + PRIOR), evidence


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of at most MAX_EXAMPLES labelled rows, whose terms and counts the driver gets."""
    sample = keep(labelled(labels, "toxic", FOLDS, HELD, MAX_EXAMPLES))
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where("text is not null")
    rows = texts.mapInArrow(releasing(_examples), "doc_id long, mark int, key binary, terms binary, counts binary").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("key", "ascending"), ("terms", "ascending")])
    marks = rows.column("mark").to_numpy().astype(np.int64)
    kept = _without_copies(marks.tolist(), rows.column("key").to_pylist())
    marks, ids = marks[kept], rows.column("doc_id").to_numpy()[kept]
    n, n1 = len(marks), int(marks.sum())
    if n1 in (0, n):
        nothing = np.zeros(0, np.int64)
        return Model(np.zeros(0, np.uint64), nothing, np.zeros(0), float(n1 > 0), Index.of(nothing, nothing, np.zeros(0), 0, nothing, nothing))
    raw = lambda name, kind: [np.frombuffer(rows.column(name)[int(i)].as_buffer(), kind) for i in kept]
    terms, count = raw("terms", np.uint64), np.concatenate(raw("counts", np.uint32))
    row = np.repeat(np.arange(n), [len(x) for x in terms])
    known, term = np.unique(np.concatenate(terms), return_inverse=True)
    df = np.bincount(term, minlength=len(known))
    ones = np.bincount(term, marks[row], len(known))
    weight = np.log((n + 1) / (df + 0.5)) * (1 + _g2(ones, df - ones, n1, n - n1))
    by_size = np.lexsort((known, -df))
    place = np.empty(len(known), np.int64)
    place[by_size] = np.arange(len(known))
    value = (1 + np.log(count)) * weight[term]
    value /= np.maximum(np.sqrt(np.bincount(row, value * value, n)), 1e-300)[row]
    return Model(known, place, weight[by_size], n1 / n, Index.of(row, place[term], value, len(known), ids, marks))


def score_toxicity(docs: DataFrame, model: Model, score: str = "score", evidence: str | None = "evidence", text_col: str = "text") -> DataFrame:
    """docs with the score and its evidence; the model is sent once to each executor."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    tidy(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in (score, evidence)]
    near = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches):
        for batch in batches:
            made = list(sent.value.scores(terms_of(batch.column(text_col))))
            columns = [*(batch.column(f.name) for f in kept), pa.array([x for x, _ in made], pa.float64())]
            names = [*(f.name for f in kept), score]
            if evidence:
                columns, names = [*columns, pa.array([x for _, x in made], near)], [*names, evidence]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{score}` double"] + [f"`{evidence}` array<struct<doc_id: long, label: int, cosine: double>>"] * bool(evidence))
    return docs.mapInArrow(releasing(run), schema)


def op9_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_toxicity(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"), "evidence")
