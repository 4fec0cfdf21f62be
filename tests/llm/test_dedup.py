"""Repeated passages, near copies, toxicity, quality, neighbours and the pipeline against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import ann, neardup, quality, repeats, toxicity

SPLIT = re.compile(rb"[^\x20\x09-\x0d]+")


def corpus(seed=1):
    """Texts with exact copies, near copies, a common passage, periodic text, and odd rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 6))) for _ in range(300)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, base = make(90), make(150)
    texts = [" ".join(make(rng.randint(1, 120))) for _ in range(60)]
    texts += [" ".join(make(30) + passage + make(20)) for _ in range(25)]
    for _ in range(40):
        near = list(base)
        for _ in range(rng.randint(0, 6)):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        texts.append((" " if rng.random() < 0.5 else "\n").join(near).upper() if rng.random() < 0.2 else " ".join(near))
    texts += [texts[3]] * 6 + ["spam " * 700, "one two three four " * 200, "", None, "x", "a b c", "A b C", "   \n", "éé " * 50]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 3 else None, "s", 0, "clash") for k, t in enumerate(corpus())] + [(5, "another text", "en", "s", 0, "clash")] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string").repartition(5), rows


def removed(texts, length, words):
    units = [SPLIT.findall((t or "").encode()) if words else (t or "").encode() for t in texts]
    pack = (lambda u: b"\0".join(u)) if words else bytes
    seen = collections.Counter(pack(u[i : i + length]) for u in units for i in range(len(u) - length + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - length + 1):
            if seen[pack(u[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        kept = [x for x, g in zip(u, gone) if not g]
        out.append((len(u), sum(gone), hashlib.sha256(b" ".join(kept) if words else bytes(kept)).hexdigest()))
    return out


@pytest.mark.parametrize("kind", [repeats.WORDS, repeats.BYTES, ("words", 6, 3), ("bytes", 20, 7)])
def test_repeats_equal_brute_force(spark, docs, kind):
    df, rows = docs
    want = sorted((r[0], *x) for r, x in zip(rows, removed([r[1] for r in rows], kind[1], kind[0] == "words")))
    got = sorted((r["doc_id"], r["n"], r["n_removed"], r["kept_sha256"]) for r in repeats.dedup(df, kind).collect())
    assert got == want


@pytest.mark.parametrize("kind", [("words", 6, 3), ("bytes", 20, 7)])
def test_large_anchors_are_settled_by_their_windows(spark, docs, kind, monkeypatch):
    monkeypatch.setattr(repeats, "LARGEST", 0.00002)
    df, rows = docs
    want = sorted((r[0], *x) for r, x in zip(rows, removed([r[1] for r in rows], kind[1], kind[0] == "words")))
    got = sorted((r["doc_id"], r["n"], r["n_removed"], r["kept_sha256"]) for r in repeats.dedup(df, kind).collect())
    assert got == want


@given(st.lists(st.lists(st.integers(0, 2), max_size=25), min_size=1, max_size=6), st.integers(2, 5), st.booleans(), st.lists(st.integers(1, 3), min_size=6, max_size=6))
@settings(max_examples=200, deadline=None)
def test_indexes_find_every_window(texts, length, run_length, weights):
    values = np.array([x for t in texts for x in t], np.int64)
    if not len(values):
        return
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    seen = collections.Counter()
    for t, w in zip(texts, weights):
        for i in range(len(t) - length + 1):
            seen[tuple(t[i : i + length])] += w
    want = [i + length <= len(t) and seen[tuple(t[i : i + length])] > 1 for t in texts for i in range(len(t))]
    assert repeats.repeated_windows(values, bounds, np.array(weights[: len(texts)]), length, run_length).tolist() == want


def thue_morse(a, b, rounds=11):
    """Two different words that many sums modulo a power of two cannot tell apart."""
    for _ in range(rounds):
        a, b = a + b, b + a
    return a, b


def test_words_made_to_collide_stay_apart(spark):
    for a, b in (thue_morse("a", "b"), thue_morse("abcdefgh", "ijklmnop", 8)):
        rest = [f"w{k}" for k in range(34)]
        texts = [" ".join([a, *rest]), " ".join([b, *rest]), a, b]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert all(r["n_removed"] == 0 for r in repeats.dedup(docs, repeats.WORDS).collect())
        got = {r["doc_id"]: r["n_removed"] for r in repeats.dedup(docs, repeats.BYTES).collect()}
        assert [got[k] for k in range(4)] == [x[1] for x in removed(texts, 400, False)]
    # the two texts differ in one of 30 shingles and are near copies; the single words are not
    assert {r["doc_id"]: r["component_id"] for r in neardup.classes(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


def shingle_sets(texts):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    out = []
    for t in texts:
        w = [x.translate(lower) for x in SPLIT.findall((t or "").encode())]
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def test_near_copies_equal_brute_force(spark, docs):
    df, rows = docs
    sets, parent = shingle_sets([r[1] for r in rows]), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r[0]), r[0])
    want = sorted((r[0], len(s), least[root(i)] if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets)))
    got = neardup.classes(df).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(0, 60) if k % 10 != 9] + [(100, 3), (200, 201)]
    got = {r["node"]: r["label"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: k // 10 * 10 for k in range(60)} | {100: 0, 200: 200, 201: 200}


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**32, (4000, 96), dtype=np.uint32)
    b = np.where(rng.random((4000, 96)) < 0.75, a, a + np.uint32(1))
    at, _ = repeats_free(a, b)
    assert len(at) == 4000 and len(repeats_free(a, np.where(rng.random((4000, 96)) < 0.3, a, a + np.uint32(1)))[0]) < 40


def repeats_free(a, b):
    every = np.arange(len(a))
    return neardup.surviving(a, every, b, every)


def test_toxicity(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices(["ba", "lo", "mi", "tu", "re", "san"], k=rng.randint(1, 4))) for _ in range(400)]
    rows = []
    for k in range(900):
        text = [rng.choice(words) for _ in range(60)]
        if k % 5 == 0:
            for _ in range(4):
                text[rng.randrange(60)] = rng.choice(["gruntox", "vilemok", "gruntoxes"])
        rows.append((k, " ".join(text), int(k % 5 == 0)))
    hidden = {2000: "gru nt0x", 2001: "v1l3m0k v1lem0k gr0ntox", 2002: "g r u n t o x v i l e m o k", 2003: "gruuuntoxxx vileeemok", 2004: "balomi turesan", 2005: "", 2006: None}
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + list(hidden.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == len(rows) + len(hidden) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    held = [(got[k]["predicted"], y) for k, _, y in rows if got[k]["held_out"]]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert [got[k]["predicted"] for k in (2001, 2002, 2003, 2004, 2005, 2006)] == [1, 1, 1, 0, 0, 0]
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert {r["predicted"] for r in toxicity.score(docs, labels.limit(0)).collect()} == {0}


def slow_kneser_ney(texts, query):
    """The same model by dictionaries: log probability of each byte of query."""
    grams = [collections.Counter() for _ in range(6)]
    for t in texts:
        p = b"\xff" * 4 + t
        grams[5].update(p[i - 4 : i + 1] for i in range(4, len(p)))
    for n in (4, 3, 2):
        grams[n].update(g[1:] for g in grams[n + 1])
    seen = collections.Counter(g[1] for g in grams[2])
    total = sum(seen.values())
    levels = {}
    for n in (5, 4, 3, 2):
        cc = collections.Counter(grams[n].values())
        a, b, c, d = (float(cc.get(k, 0)) for k in (1, 2, 3, 4))
        y = a / (a + 2 * b) if a else 0.5
        ds = [1 - 2 * y * b / a if a and b else 0.5, 2 - 3 * y * c / b if b and c else 1.0, 3 - 4 * y * d / c if c and d else 1.5]
        ds = [min(max(v, 0.05), k + 0.95) for k, v in enumerate(ds)]
        sums, left = collections.Counter(), collections.Counter()
        for g, k in grams[n].items():
            sums[g[:-1]] += k
            left[g[:-1]] += ds[min(k, 3) - 1]
        levels[n] = (ds, sums, left)
    out = []
    p = b"\xff" * 4 + query
    for i in range(4, len(p)):
        q = (seen[p[i]] + 0.5) / (total + 128)
        for n in (2, 3, 4, 5):
            g, (ds, sums, left) = p[i - n + 1 : i + 1], levels[n]
            if g[:-1] in sums:
                k = grams[n].get(g, 0)
                q = ((k - ds[min(k, 3) - 1] if k else 0) + left[g[:-1]] * q) / sums[g[:-1]]
        out.append(np.log(q))
    return float(np.exp(-np.mean(out)))


def test_quality_equals_a_plain_model(spark):
    rng = random.Random(6)
    texts = {k: "".join(rng.choices(["the ", "cat ", "sat ", "é ", "mat. "], k=rng.randint(1, 40))) for k in range(80)}
    texts |= {100: "zzqx%%% ###", 101: "", 102: None}
    docs = spark.createDataFrame([(k, t, "en" if k % 2 else None, "clash") for k, t in texts.items()], "doc_id long, text string, lang string, perplexity string").repartition(3)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    import zlib

    trained = [texts[k].encode() for k in range(60) if zlib.crc32(str(k).encode()) % 4]
    for k in (0, 7, 70, 100):
        assert got[k]["perplexity"] == pytest.approx(slow_kneser_ney(trained, texts[k].encode()), rel=1e-4)
    assert got[101]["perplexity"] is None and not got[101]["kept"] and not got[102]["kept"] and not got[100]["kept"]
    for lang in ("en", None):  # of so few, the quantile is the largest
        aside = [got[k]["perplexity"] for k in range(60) if got[k]["lang"] == lang and zlib.crc32(str(k).encode()) % 4 == 0]
        assert all(r["threshold"] == max(aside) and r["kept"] == (r["perplexity"] is not None and r["perplexity"] <= max(aside)) for r in got.values() if r["lang"] == lang)
    assert quality.judge(docs.limit(0), labels).count() == 0
    assert all(r["kept"] == bool(texts[r["doc_id"]]) for r in quality.judge(docs, labels.limit(0)).collect())


def exact(vectors, k=10):
    ids, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors], float)
    out = {}
    for i in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == i][0]) ** 2).sum(1))
        d[ids == i] = np.inf
        out[int(i)] = [(int(ids[j]), d[j]) for j in np.lexsort((ids, d))[: min(k, len(ids) - 1)]]
    return out


@pytest.mark.parametrize("n,common", [(7, 0), (600, 200), (6000, 2000)])
def test_neighbours(spark, n, common):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 12))
    x = (centres[rng.integers(0, 20, n)] + 0.5 * rng.standard_normal((n, 12))).astype(np.float32)
    x[n - common :] = x[n - 1]
    good = [(k, x[k].tolist()) for k in range(n)]
    bad = [(100_000, None), (100_001, [0.0] * 12), (100_002, [float("nan")] * 12), (100_003, [1.0, None] + [0.0] * 10), (100_004, [float("inf")] * 12), (100_100, [1.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").repartition(3)
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = exact(good)
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert ann.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_few_parts_are_probed_where_the_vectors_cluster():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 48))[rng.integers(0, 200, 4000)] + 0.4 * rng.standard_normal((4000, 48))
    router, probes = ann.fit(x, 32)
    assert probes <= 4
    near, best = ann.neighbour_graph(x), np.argsort(-router(x), axis=1)
    hits = (best[:, None, :probes] == best[near, 0][:, :, None]).any(2)
    assert hits.mean() >= 0.9


def test_balanced_parts():
    x = np.random.default_rng(4).standard_normal((500, 8))
    sizes = np.bincount(ann.partition(ann.neighbour_graph(x), 8))
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 8


def test_pipeline_stages(spark, docs, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    df, rows = docs
    for name in ("row", "copy", "gone", "kept", "copies", "class", "odds"):
        df = df.withColumn(name, F.concat(F.lit(name), F.col("doc_id")))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(50)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = []
    for name, stage_ in pipeline.STAGES:
        after = stage_(spark, now, str(tmp_path))
        after.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        sizes.append(now.count())
        if name != "encode":
            assert now.columns == df.columns
            assert all(r[c] == f"{c}{r['doc_id']}" for r in now.collect() for c in ("row", "copy", "gone", "kept", "copies", "class", "odds"))
    classes = {r["component_id"] for r in neardup.classes(df).collect()}
    assert sizes[0] == len(rows) and len(classes) <= sizes[1] <= len(classes) + 2 and sizes[2] <= sizes[1]
    assert pipeline.run(spark, str(tmp_path)).count() == sizes[-1]
