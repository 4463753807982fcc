"""Quality scores by Bradley-Terry pairwise ranking.

Features are shares of kinds of bytes, words and lines of the whole text. Each labelled document of label 0
meets each one of label 1, and the mean logistic loss over all these pairs is minimised by Newton steps with a ridge:
a pass over the labelled documents sums their features by score on the nodes of a grid, with the weights of cubic
interpolation, and pairs of nodes stand for the pairs of documents, whose probabilities come out with an error below
2e-5. The weighted sum of a document's features is its score on that scale; the cut is the quantile of all labelled
documents' scores at the share of label 0, and scores are moved so that the cut has 0.7. No labelled document that
isn't held out is left away; the driver gets sums alone, whose size doesn't grow with the documents of a part.

Defined results: null and empty texts have features of 0 and the score that belongs to them, but never
more than half; without labels of both kinds every score is 0.5; long texts are read whole; equal texts have equal scores,
and rows that repeat an id are scored each; of labels that repeat an id, 1 holds; an empty table gives none; columns of docs
keep their names and values, but for one named as the score, which this replaces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, hash_words, held_out, keep, labelled, releasing, small_batches, utf8

FOLDS, HELD = 4, 2
RIDGE = 1e-3
CUT = 0.7
FAR = 6
STEP = 0.25
EDGES = 1 << 14
PART_ROWS, BLOCK_ROWS = 200_000, 10_000

FEATURES = "upper marks symbols digits pipes bangs other distinct repeated long_words short_words mean_word line_words distinct_lines log_words".split()
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
IN_LINE = np.ones(256, bool)
IN_LINE[10] = False


def _kinds() -> np.ndarray:
    found = np.zeros((256, 8))
    for i, some in enumerate([range(65, 91), range(97, 123), b".,;:?'\"()-", b"#$%&*@^~+=<>{}[]\\/_`", range(48, 58), b"|", b"!", range(128, 256)]):
        found[list(some), i] = 1
    return found


KINDS = _kinds()


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    data, at = utf8(texts)
    out = np.zeros((len(at) - 1, len(FEATURES)))
    for lo, hi in blocks(at):
        part, off = data[at[lo] : at[hi]], at[lo : hi + 1]
        n = hi - lo
        size = np.diff(off)
        row = np.repeat(np.arange(n), size)
        kinds = np.bincount(row * 256 + part, minlength=n * 256).reshape(n, 256) @ KINDS
        words, w = hash_words(part, off, ~SPACES)
        lines, ln = hash_words(part, off, IN_LINE)
        starts = np.diff(w)
        solid = np.maximum(1, size - np.array([SPACES[part[a:b]].sum() for a, b in zip(off[:-1] - off[0], off[1:] - off[0], strict=True)]))
        upper, lower, marks, symbols, digits, pipes, bangs, other = kinds.T
        for i in range(n):
            mine, own = words[w[i] : w[i + 1]], lines[ln[i] : ln[i + 1]]
            k = len(mine)
            if not k:
                continue
            out[lo + i, 7:9] = len(np.unique(mine)) / k, (mine[1:] == mine[:-1]).sum() / k
            out[lo + i, 13] = len(np.unique(own)) / max(1, len(own))
        count = np.maximum(1, starts)
        mean = solid / count
        out[lo:hi, :7] = np.stack([upper / np.maximum(1, upper + lower), marks / solid, symbols / solid, digits / solid, pipes / count, bangs / count, other / solid], axis=1)
        out[lo:hi, 9] = np.maximum(0, mean - 10)
        out[lo:hi, 10] = np.maximum(0, 3 - mean)
        out[lo:hi, 11] = np.minimum(mean, 20)
        out[lo:hi, 12] = np.log1p(starts / np.maximum(1, np.diff(ln)))
        out[lo:hi, 14] = np.log1p(starts)
        out[lo:hi][starts == 0] = 0
    return out


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, shift: float):
        self.mean, self.scale, self.weights, self.shift = mean, scale, weights, shift

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -FAR, FAR)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        s = 1 / (1 + np.exp(-np.clip(self.raw(x) + self.shift, -30, 30)))
        empty = x[:, FEATURES.index("log_words")] == 0
        return np.where(empty, np.minimum(s, 0.5), s)


def measure(docs: DataFrame, features_col: str = "x", text_col: str = "text") -> DataFrame:
    """docs with their features, an array, in place of the text."""
    small_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in (features_col, text_col)]

    def run(batches):
        for batch in batches:
            made = pa.array(list(features(batch.column(text_col))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), made], [*(f.name for f in kept), features_col])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{features_col}` array<double>"])
    return docs.select(*(f"`{f.name}`" for f in kept), f"`{text_col}`").mapInArrow(releasing(run), schema)


def matrix(column: pa.Array) -> np.ndarray:
    """A row for each array of features."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


def example_blocks(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """The features and marks of all labelled documents that aren't held out, some thousands in a row, in an order that
    doesn't depend on the session."""
    marks = keep(labelled(labels, "quality", FOLDS, HELD))
    parts = 1 + marks.count() // PART_ROWS
    rows = measured.select("doc_id", "x").join(marks, "doc_id").repartition(parts, "doc_id").sortWithinPartitions("doc_id", "x")

    def pack(batches):
        xs, ms, n = [], [], 0

        def packed():
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(xs).tobytes()], pa.binary()), pa.array([np.concatenate(ms).tobytes()], pa.binary())], ["x", "mark"])

        for batch in batches:
            xs.append(matrix(batch.column("x")))
            ms.append(batch.column("mark").to_numpy(zero_copy_only=False).astype(np.int8))
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield packed()
                xs, ms, n = [], [], 0
        if n:
            yield packed()

    return keep(rows.select("x", "mark").mapInArrow(releasing(pack), "x binary, mark binary"))


def total(examples: DataFrame, part, shape: tuple[int, int]) -> np.ndarray:
    """The sum of part(x, marks), a matrix of that shape, over all blocks of examples. Rows of zeros don't travel."""

    def run(batches):
        found = np.zeros(shape)
        for batch in batches:
            for x, mark in zip(batch.column(0), batch.column(1), strict=True):
                found += part(np.frombuffer(x.as_buffer()).reshape(-1, len(FEATURES)), np.frombuffer(mark.as_buffer(), np.int8))
        at = np.flatnonzero(found.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([r.tobytes() for r in found[at]], pa.binary())], ["at", "sums"])

    made = np.zeros(shape)
    for r in examples.mapInArrow(run, "at long, sums binary").collect():  # sums: a row for each node or edge and part
        made[r["at"]] += np.frombuffer(r["sums"])
    return made


def spread(s: np.ndarray, values: np.ndarray, first: float, nodes: int) -> np.ndarray:
    """Sums of the rows of values on a grid's nodes, each dealt to the four nodes around its place s by the weights of
    cubic interpolation. first: the place of the first node."""
    out = np.zeros((nodes, values.shape[1]))
    if not len(s):
        return out
    order = np.argsort(s, kind="stable")
    place = (s[order] - first) / STEP
    cell = np.floor(place).astype(np.int64)
    u, values = place - cell, values[order]
    begin = np.flatnonzero(np.diff(cell, prepend=-1))
    weights = -u * (u - 1) * (u - 2) / 6, (u + 1) * (u - 1) * (u - 2) / 2, -(u + 1) * u * (u - 2) / 2, (u + 1) * u * (u - 1) / 6
    for k, w in enumerate(weights):
        out[cell[begin] + k - 1] += np.add.reduceat(values * w[:, None], begin, axis=0)
    return out


def bradley_terry(examples: DataFrame, model: Model, ridge: float = RIDGE, steps: int = 30) -> np.ndarray:
    """Weights under which label 1 is preferred in each pair of a document of label 1 and one of label 0, by logistic
    loss over all pairs. model: has the scale of the features."""
    k = len(FEATURES)
    up = np.triu_indices(k)
    w = np.zeros(k)
    for _ in range(steps):
        half = int(np.ceil(FAR * np.abs(w).sum() / STEP)) + 3
        nodes = 2 * half + 1

        def sums(x, mark, w=w, half=half, nodes=nodes):
            z = model.scaled(x)
            values = np.concatenate([np.ones((len(z), 1)), z, z[:, up[0]] * z[:, up[1]]], axis=1)
            return np.concatenate([spread(z[mark == m] @ w, values[mark == m], -half * STEP, nodes) for m in (0, 1)])

        found = total(examples, sums, (2 * nodes, 1 + k + len(up[0])))
        at = [np.flatnonzero(part.any(axis=1)) for part in (found[:nodes], found[nodes:])]
        worse, better = found[:nodes][at[0]], found[nodes:][at[1]]
        pairs = worse[:, 0].sum() * better[:, 0].sum()
        p = 1 / (1 + np.exp(np.clip((at[1][:, None] - at[0]) * STEP, -30, 30)))
        q = p * (1 - p)
        gradient = (better[:, 1 : k + 1].T @ (p @ worse[:, 0]) - worse[:, 1 : k + 1].T @ (better[:, 0] @ p)) / pairs - ridge * w
        squares = np.zeros((k, k))
        squares[up] = better[:, k + 1 :].T @ (q @ worse[:, 0]) + worse[:, k + 1 :].T @ (better[:, 0] @ q)
        squares += np.triu(squares, 1).T
        cross = better[:, 1 : k + 1].T @ q @ worse[:, 1 : k + 1]
        step = np.linalg.solve((squares - cross - cross.T) / pairs + ridge * np.eye(k), gradient)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def ordered(examples: DataFrame, model: Model, places: np.ndarray) -> np.ndarray:
    """The scores at these places, from 0, in the order of all examples' scores: each pass counts the scores below some
    edges and keeps the interval that holds the place, until no number lies inside."""
    far = FAR * np.abs(model.weights).sum() + 1
    lo, hi = np.full(len(places), -far), np.full(len(places), far)
    while True:
        edges = np.linspace(lo, hi, EDGES + 1, axis=1)

        def below(x, mark, edges=edges):
            s = np.sort(model.raw(x))
            return np.stack([np.searchsorted(s, e) for e in edges])

        i = (total(examples, below, edges.shape) <= places[:, None]).sum(axis=1) - 1
        each = np.arange(len(places))
        if (edges[each, i] == lo).all() and (edges[each, i + 1] == hi).all():
            return lo
        lo, hi = edges[each, i], edges[each, i + 1]


def fit(docs: DataFrame, labels: DataFrame, features_col: str | None = None) -> Model:
    """The model of all labelled documents that aren't held out. features_col: a column that measure() made of the text,
    which is read in its place."""
    measured = docs.select("doc_id", F.col(features_col).alias("x")) if features_col else measure(docs.select("doc_id", "text"))
    examples = example_blocks(measured, labels)
    k = len(FEATURES)
    n, good, *sums = total(examples, lambda x, mark: np.concatenate([[len(x), mark.sum()], x.sum(axis=0)])[None], (1, k + 2))[0]
    if good in (0, n):
        return Model(np.zeros(k), np.ones(k), np.zeros(k), 0.0)
    mean = np.array(sums) / n
    squares = total(examples, lambda x, mark: ((x - mean) ** 2).sum(axis=0)[None], (1, k))[0]
    model = Model(mean, np.maximum(np.sqrt(squares / n), 1e-6), np.zeros(k), 0.0)
    model.weights = bradley_terry(examples, model)
    place = (n - good) / n * (n - 1)
    low, high = ordered(examples, model, np.array([np.floor(place), np.ceil(place)]))
    model.shift = float(np.log(CUT / (1 - CUT)) - (low + (place - np.floor(place)) * (high - low)))
    return model


def score_quality(docs: DataFrame, model: Model, score: str = "score", text_col: str = "text", features_col: str | None = None) -> DataFrame:
    """docs with scores. features_col: a column that measure() made of the text, which is read in its place."""
    small_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in (score, features_col)]

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(features_col)) if features_col else features(batch.column(text_col))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(model.score(x), pa.float64())], [*(f.name for f in kept), score])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{score}` double"])
    return docs.mapInArrow(releasing(run), schema)


def op4_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    measured = keep(measure(docs.select("doc_id", "text")))  # read once by the fit and once by the scores
    scored = score_quality(measured, fit(measured, labels, features_col="x"), features_col="x")
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
