"""Operators do the whole job: cases that a cut of rows, texts or terms would lose."""

import zlib

import numpy as np

from quarry.llm import line_dedup, toxicity
from quarry.llm.html_extract import extract


def test_line_dedup_finds_rare_boilerplate(spark):
    """A licence line on 1 % of a host's pages goes; a line on fewer than MIN_PAGES of them stays."""
    lines = lambda i: [f"own {i}", *["licence"] * (i % 100 == 0), *["now and then"] * (i < line_dedup.MIN_PAGES - 1)]
    docs = spark.createDataFrame([(i, "\n".join(lines(i)), "h") for i in range(3000)], "doc_id int, text string, source string")
    found = line_dedup.dedup_lines(docs).where("n_lines_dropped > 0 or doc_id < 7").collect()
    assert sorted(r["doc_id"] for r in found if r["n_lines_dropped"]) == list(range(0, 3000, 100))
    assert all(("now and then" in r["text"]) == (r["doc_id"] < 7) and "licence" not in r["text"] for r in found)


def test_toxicity_indexes_every_example(spark):
    """Examples without a word of one label are indexed, texts without one have evidence, and a shared passage is no copy."""
    ids = [i for i in range(1, 400) if not _held(i)]
    word = lambda i, j: "abcdefghij"[i % 10] + "klmnopqrst"[i // 10 % 10] + "uvwxyz"[i // 100] + "abcdefghij"[j]
    text = lambda i: f"the same words are here {' '.join(word(i, j) for j in range(9))} {'idiot' if i % 4 == 0 else ''}"
    docs = spark.createDataFrame([(i, text(i)) for i in ids] + [(1000, word(ids[1], 3))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in ids], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.index.ids.tolist() == ids
    last = toxicity.score_toxicity(docs, model).where("doc_id = 1000").first()
    assert [r["doc_id"] for r in last["evidence"]] == [ids[1]]


def test_toxicity_index_with_lists_is_exact():
    rng = np.random.default_rng(3)
    v = rng.random((300, 900)) * (rng.random((300, 900)) < 0.05)
    v = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    index = toxicity.Index(v, np.arange(300), np.zeros(300))
    for _ in range(20):
        terms = np.sort(rng.permutation(900)[:60])
        weights = rng.random(60)
        full = v[:, terms].astype(np.float64) @ weights
        got = index.nearest(terms, weights, 15)
        assert [i for _, i in got] == np.lexsort((np.arange(300), -full))[:15].tolist()
        assert np.allclose([c for c, _ in got], np.sort(full)[::-1][:15])


def _held(i):
    return zlib.crc32(str(i).encode()) % toxicity.FOLDS == toxicity.HELD


LONG = "This is the long text of the page, which has many words and it is for the reader to see that all is well."


def test_html_keeps_what_unclosed_elements_precede():
    assert extract(f"<html><head><title>x</title><body><p>{LONG}</p></body></html>") == LONG
    assert extract(f"<body><nav><a href=1>x</a><article><p>{LONG}</p></article></body>") == LONG
    assert extract(f"<body><div><nav><a href=1>x</a></div><p>{LONG}</p></body>") == LONG


def test_html_modifiers_drop_no_article():
    for name in ("content with-sidebar", "no-sidebar", "layout-sidebar"):
        assert extract(f"<body><div class='{name}'><p>{LONG}</p></div><div class='left-sidebar'><p>Of this and that it is</p></div></body>") == LONG


def test_html_other_languages():
    text = "\u4e2d\u6587\u7f51\u9875\u7684\u6b63\u6587" * 15
    assert extract(f"<body><div><p>{text}</p></div><ul><li><a href=1>{text}</a></li></ul></body>") == text


def test_bpe_of_long_words_and_clashing_columns(spark):
    """Words of 100,000 letters, and columns named as those that the operator works with."""
    import base64
    import random

    import public_tokenizers as P
    import tiktoken

    from quarry.llm import bpe

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    texts = ["".join(rng.choice("etaoinshr") for _ in range(100_000)), "a" * 3000, "the " * 5, "é" * 600 + " x", None]
    docs = spark.createDataFrame([(i, t, "w", i, "p") for i, t in enumerate(texts)], "doc_id long, text string, _word string, _steps int, __places string")
    rows = bpe.encode(docs, path, P.PATTERN, decoded="back", carry_text=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["ids"] == plain.encode_ordinary(r["text"] or "") and bytes(r["back"]).decode() == (r["text"] or "")
        assert (r["_word"], r["_steps"], r["__places"]) == ("w", r["doc_id"], "p")
