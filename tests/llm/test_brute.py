"""Operators against plain versions of themselves over a small table."""

import base64
import hashlib
import math
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import ann, bpe, exact_dedup, mixing, near_dup, quality, sharding, toxicity
from quarry.llm.components import components

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, "documents").select("doc_id", "text").collect()}


def roots(ids, links):
    at = {i: i for i in ids}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        at[b] = a
    return {i: root(i) for i in ids}


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_near_dup(spark, texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    pairs = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = roots(texts, links)
    for r in near_dup.op5_near_dup(table(spark, "documents")).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_near_dup_hot_groups(spark):
    """A large group of near copies, and many texts that share a long passage but aren't near copies."""
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(base[: i % 7 * 10] + [f"e{i}"] + base[i % 7 * 10 + 1 :])) for i in range(300)]
    passage = " ".join(f"p{i}" for i in range(150))
    rows += [(1000 + i, passage + " " + " ".join(f"u{i}x{j}" for j in range(22))) for i in range(200)]
    rows += [(2000 + i, f"{passage} " + " ".join(f"u{i}x{j}" for j in range(22)) + " tail") for i in range(0, 200, 20)]
    found = {r["doc_id"]: r["component_id"] for r in near_dup.op5_near_dup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for i, t in rows}
    ids = list(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert found == roots(ids, links)


def test_sketch_is_full_and_close():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 5000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: int(n * 0.8)], rng.integers(0, 2**63, n - int(n * 0.8)).astype(np.uint64)])
        s = near_dup.sketches([a, b], 180)
        assert (s != ~np.uint64(0)).all()
        alike = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - alike) < 0.15


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 103), (200, 200)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 103: 100, 105: 100}


def test_bpe(spark, texts):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(i, t) for i, t in texts.items()] + [(-1, "  \u0085  x\t\n\n a b"), (-2, "naïve 你好 🙂🙂 ''s 're don't 12345"), (-3, "")]
    for r in bpe.op6_bpe(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = dict(rows)[r["doc_id"]]
        ids = plain.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    path = P.path("byte_bpe_multi_50k.tiktoken")
    one = bpe.encode(spark.createDataFrame([("some text",)], "text string"), path, P.PATTERN).first()["ids"]
    assert bpe.decode(one, path) == b"some text"


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3000):
        keys = rng.integers(0, 256, (n, 32)).astype(np.uint8)
        levels, slot = exact_dedup.build_mph(keys)
        assert sorted(slot.tolist()) == list(range(n))
        assert (exact_dedup.find_slots(levels, keys) == slot).all()
        other = exact_dedup.find_slots(levels, rng.integers(0, 256, (100, 32)).astype(np.uint8))
        assert (other < max(1, n)).all()


def test_sharding(spark, texts):
    docs = table(spark, "documents")
    rows = sharding.op3_sharding(docs).collect()
    slots = defaultdict(list)
    for r in rows:
        text = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 16, zlib.crc32(text))
        assert r["grown_shard"] in (r["shard"], 40) and 0 <= r["shard"] < 40
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 0 < sum(r["grown_shard"] == 40 for r in rows) < len(rows) / 10
    for n in (1, 5, 6, 20, 21, 33):
        moved = sharding.shard_documents(docs, n).where(f"grown_shard <> shard and grown_shard <> {n}").count()
        assert moved == 0


def test_sharding_confines_moves(spark):
    """A change of weight in one rack moves rows only into it."""
    ids = spark.range(3000)
    weights = [1.0] * 40
    heavier = [3.0 if i in (22, 23) else w for i, w in enumerate(weights)]
    rows = ids.select(*[sharding.descend(sharding.draws(ids["id"], w), 40).alias(n) for n, w in (("old", weights), ("new", heavier))]).collect()
    assert all(r["new"] in (r["old"], 22, 23) for r in rows) and any(r["new"] != r["old"] for r in rows)


def water(sizes, weights, total, most=2.0):
    target, free = {}, set(sizes)
    while True:
        level = (total - sum(target.values())) / sum(weights[s] for s in free)
        over = [s for s in free if level * weights[s] > most * sizes[s]]
        if not over:
            return target | {s: level * weights[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            free.discard(s)


def test_mixing(spark, texts):
    docs = table(spark, "documents")
    rows = mixing.op8_mixing(docs).collect()
    again = mixing.op8_mixing(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]])) and r["taken"] in (0, r["size"], 2 * r["size"])
        assert len(r["shards"]) == r["copies"]
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    want = water(sizes, weights, 1.5 * sum(sizes.values()))
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], want[s])
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] for s in sizes)


def test_splitting_tree(spark):
    tickets = spark.createDataFrame([("a", 101), ("b", 40), (None, 3)], "source string, n long")
    quotas = mixing.split_quotas(tickets, 3, 0).collect()
    by = defaultdict(int)
    shard = defaultdict(int)
    for r in quotas:
        by[r["source"]] += r["quota"]
        shard[r["shard"]] += r["quota"]
    assert dict(by) == {"a": 101, "b": 40, None: 3} and set(shard.values()) == {18}


def test_ann_recall(spark):
    rows = table(spark, "embeddings").collect()
    x = np.array([r["embedding"] for r in rows], np.float64)
    ids = np.array([r["vec_id"] for r in rows])
    norm = np.sqrt((x * x).sum(axis=1))
    found = defaultdict(dict)
    for r in ann.op7_ann(table(spark, "embeddings")).collect():
        found[r["query_id"]][r["vec_id"]] = r["score"]
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        cosine = x @ x[q] / (norm * norm[q])
        cosine[q] = -2
        best = ids[np.argsort(-cosine)[:5]].tolist()
        hits += len(set(best) & set(found[ids[q]]))
        total += 5
        assert all(math.isclose(s, cosine[np.flatnonzero(ids == v)[0]], rel_tol=1e-12) for v, s in found[ids[q]].items())
    assert hits >= 0.9 * total


@pytest.mark.parametrize("operator,mark,least", [(quality.op4_quality, "quality", 0.95), (toxicity.op9_toxicity, "toxic", 0.9)])
def test_held_out(spark, operator, mark, least):
    scored = operator(table(spark, "documents"), table(spark, "labels")).where("held_out").join(table(spark, "labels"), "doc_id").collect()
    right = sum(r["predicted"] == r[mark] for r in scored)
    assert len(scored) > 50 and right >= least * len(scored)


def test_block_max_index_is_exact():
    rng = np.random.default_rng(2)
    v = rng.random((700, 40)) * (rng.random((700, 40)) < 0.15)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    v = v.astype(np.float32)
    index = toxicity.Index(v, np.arange(700), rng.integers(0, 2, 700))
    for _ in range(20):
        terms = np.sort(rng.permutation(40)[:6])
        weights = rng.random(6)
        got = index.nearest(terms, weights, 15)
        full = np.sort(v[:, terms].astype(np.float64) @ weights)[::-1]
        assert np.allclose([c for c, _ in got], full[: len(got)])


def test_sharding_places_by_weight():
    """Shares follow weights, alike over regions and racks, and a row's place is that of the earliest arrival."""
    keys = np.random.default_rng(8).integers(0, 2**63, 60_000).astype(np.uint64)
    weights = [1.0] * 40
    weights[7], weights[33], weights[12] = 4.0, 2.0, 0.0
    when, shard = sharding.first_arrivals(keys, weights)
    own = shard[np.arange(len(keys)), when.argmin(axis=1)]
    share = np.bincount(own, minlength=40) / len(keys)
    assert np.abs(share - np.array(weights) / sum(weights)).max() < 0.006 and share[12] == 0
    # an arrival by arrival version of one region
    for key in keys[:50]:
        h, t = sharding.mix(np.array([key]) + np.uint64(2) * sharding.GOLDEN), 0.0
        while True:
            h = sharding.mix(h + sharding.GOLDEN)
            u = [float(sharding._unit(sharding.mix(h ^ np.uint64(i)))[0]) for i in (1, 3)]
            t -= math.log(float(sharding._unit(h)[0])) / 80
            rack = int(u[0] * 4)
            leaf = 20 + 5 * rack + int(float(sharding._unit(sharding.mix(h ^ np.uint64(2)) + np.uint64(rack))[0]) * 5)
            if u[1] * 4 < weights[leaf]:
                break
        i = int(np.flatnonzero(keys == key)[0])
        assert shard[i, 1] == leaf and math.isclose(when[i, 1], t)


def test_slots_of_repeated_ids_agree(spark):
    rows = [(1, "a"), (1, "b"), (1, "b"), (None, "c"), (None, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [sorted(map(str, sharding.op3_sharding(d).collect())) for d in (docs, docs.repartition(3), docs.orderBy("text"))]
    assert found[0] == found[1] == found[2]


def test_near_dup_two_large_clusters(spark):
    """Two groups of near copies that share most of their text and buckets, but aren't near copies of each other; a third
    that is linked with the first by one document alone."""
    core = [f"c{i}" for i in range(200)]
    tails = {g: [f"{g}{i}" for i in range(34)] for g in "xyz"}

    def text(g, i, n):
        words = core + tails[g]
        words[5 + i % 180] = f"{g}e{i}"
        return " ".join(words) + (" " + " ".join(f"t{j}" for j in range(n)) if n else "")

    rows = [(i, text("x", i, 0)) for i in range(120)] + [(1000 + i, text("y", i, 0)) for i in range(120)]
    rows += [(2000 + i, " ".join(core[20:] + tails["x"] + tails["z"][: 6 + i % 3] + [f"z{i}"])) for i in range(40)]
    found = {r["doc_id"]: r["component_id"] for r in near_dup.op5_near_dup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for i, t in rows}
    ids = list(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert found == roots(ids, links)
    assert len({found[i] for i in range(120)}) == 1 and found[0] != found[1000]


def test_near_dup_frees_its_shuffle_files(spark):
    """What its many steps have shuffled is gone when it returns, without waiting for the driver's garbage: what is left is of its few counts."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: set(re.findall(r"shuffle_(\d+)_", manager.getAllBlocks().mkString(" ")))
    rows = [(i, " ".join(f"w{i // 5}x{j}" for j in range(60)) + f" e{i}") for i in range(100)]
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = held(), spark.conf.get(cleanup, None)
    near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    end = time.time() + 20
    while len(held() - before) > 8 and time.time() < end:  # they are taken away in the background
        time.sleep(0.2)
    assert len(held() - before) <= 8
    assert spark.conf.get(cleanup, None) == setting


def test_quality_counts_every_label(spark):
    """More labelled rows than a sample of 20,000 would hold: mean, scale and cut are those of all of them."""
    n, kinds = 32_000, ["a plain sentence of words.", "Buy! | now | 50%", "another 12 lines\nof text", "WORDS and words"]
    rows = [(i, kinds[i % 4] + " more" * (i % 17) + " odd!|" * (i // 31_000), int(i % 4 != 1)) for i in range(n)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    model = quality.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int"))
    own = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert len(own) > 20_000
    x = quality.features(pa.array([r[1] for r in own]))
    assert np.allclose(model.mean, x.mean(axis=0), rtol=1e-9) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-6), rtol=1e-6)
    cut = np.quantile(model.raw(x), 1 - np.mean([r[2] for r in own]))
    assert math.isclose(model.shift, math.log(0.7 / 0.3) - cut, abs_tol=1e-9)


def test_quality_weighs_every_pair(spark):
    """The weights are those of the loss over all pairs of a document of label 0 and one of label 1."""
    docs, labels = table(spark, "documents"), table(spark, "labels")
    model = quality.fit(docs, labels)
    rows = docs.join(labels, "doc_id").where("quality in (0, 1) and crc32(cast(doc_id as string)) % 4 != 2").select("text", "quality").collect()
    z, mark = model.scaled(quality.features(pa.array([r[0] for r in rows]))), np.array([r[1] for r in rows])
    d = (z[mark == 1][:, None] - z[mark == 0]).reshape(-1, z.shape[1])
    w = np.zeros(d.shape[1])
    for _ in range(20):
        p = 1 / (1 + np.exp(d @ w))
        w += np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + quality.RIDGE * np.eye(len(w)), d.T @ p / len(d) - quality.RIDGE * w)
    assert np.allclose(model.weights, w, atol=1e-3 * np.abs(w).max())
