"""Cases in which a stage once did less than the whole job."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from siltstone.llm import neardup, quality, toxicity


def passages(n, words, seed):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(words)) for _ in range(n)]


def test_one_row_of_each_class_reaches_the_end(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c, d, e, f = passages(6, 60, 1)
    near = " ".join(["other", *e.split()[1:]])
    rows = [(1, a), (1, a), (2, b), (2, c), (None, d), (None, d), (None, e), (9, near), (None, f), (4, ""), (4, ""), (None, None), (None, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = [(1, a), (2, b), (2, c), (None, d), (9, near), (None, f), (4, ""), (None, None), (None, "")]
    for stage in (pipeline.drop_near_copies, pipeline.drop_passages):
        now = stage(spark, now, str(tmp_path))
        assert sorted(map(str, ((r["doc_id"], r["text"]) for r in now.collect()))) == sorted(map(str, want))


def test_labelled_bad_rows_set_the_limit(spark):
    rng = random.Random(2)
    make = lambda parts: "".join(rng.choices(parts, k=40))
    good, junk = ["the ", "cat ", "sat ", "on ", "mat. "], ["teh ", "ctaa", "zzqx", "% #", "tam. "]
    odd = next(k for k in range(200) if zlib.crc32(str(k).encode()) % 4 == 0)
    rows = [(k, make(["#@%", "~^&", "QQJ"]) if k == odd else make(good), "en", 1) for k in range(200)] + [(k, make(junk), "en", 0) for k in range(200, 260)]
    rows += [(k, make(good), "fr", 1) for k in range(300, 308)] + [(308, make(junk), "fr", 0)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[3], 0) for r in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    assert not any(got[r[0]]["kept"] for r in rows if r[3] == 0) and not got[odd]["kept"]
    assert sum(got[r[0]]["kept"] for r in rows if r[3] == 1) >= 0.9 * sum(r[3] for r in rows)
    assert len({(r["lang"], r["threshold"]) for r in got.values()}) == 2


def test_gaps_join_or_part_words(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices(["ba", "lo", "mi", "tu", "re", "san"], k=rng.randint(1, 4))) for _ in range(400)]
    bad = ["gruntox", "such a loser", "idiot", "blödian", "dof"]
    rows = []
    for k in range(900):
        text = [rng.choice([*words, "such a"]) for _ in range(60)]
        if k % 5 == 0:
            for _ in range(4):
                text[rng.randrange(60)] = rng.choice(bad)
        rows.append((k, " ".join(text), int(k % 5 == 0)))
    hidden = ["gru nt0x gr unt0x", "such a l o s e r", "idio+", "l - o - s - e - r", "b l ö d i a n", "d o f", "gr u nt0x", "G R U N T O X"]
    clean = ["balomi turesan! such a tu, re 1 2 3", "m i t u such a", "a b c"]
    texts = dict(enumerate(hidden, 2000)) | dict(enumerate(clean, 3000))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, labels).collect()}
    assert {t: got[k] for k, t in texts.items()} == dict.fromkeys(hidden, 1) | dict.fromkeys(clean, 0)


def test_stages_equal_plain_versions(spark, tmp_path):
    """Each stage on its own input: which rows stay, and their texts."""
    import collections
    import re

    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(4)
    texts = passages(30, 50, 3)
    shared = passages(1, 60, 9)[0]
    texts += [f"{a} {shared} {b}" for a, b in zip(passages(6, 20, 5), passages(6, 15, 6))] + texts[:4]
    texts += [" ".join(w if k != 7 else "other" for k, w in enumerate(texts[5].split()))]
    rows = [(None if k % 11 == 5 else k, t, "en", f"s{rng.randrange(3)}" if k % 13 else None, len(t), "clash") for k, t in enumerate(texts)] + [(3, texts[8], "en", "s0", 1, "clash"), (900, "", "en", "s1", 0, "clash"), (901, None, "en", "s1", 0, "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string").repartition(3)
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["text"] or "")
    assert sorted(map(key, pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()), key=str) == sorted(((r[0] is None, r[0], r[1] or "") for r in rows), key=str)
    # near copies: by brute force over five-word sets
    words = [(r[1] or "").lower().split() for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for g, r in zip(group, rows):
        best[g] = min(best.get(g, (True, 1 << 60)), (r[0] is None, r[0] if r[0] is not None else 0))
    kept = pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == sorted(best.values())
    # passages: windows of 35 words counted over all rows
    split = [re.findall(r"[^\x20\x09-\x0d]+", r[1] or "") for r in rows]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    want = []
    for r, w in zip(rows, split):
        gone = [any(seen[tuple(w[i : i + 35])] > 1 for i in range(max(0, k - 34), min(k, len(w) - 35) + 1)) for k in range(len(w))]
        if not any(gone):
            want.append((str(r[0]), r[1] or ""))
        elif not all(gone):
            want.append((str(r[0]), " ".join(x for x, g in zip(w, gone) if not g)))
    got = pipeline.drop_passages(spark, docs, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got) == sorted(want) and all(r["row"] == "clash" for r in got)
    # the mix: copies of rows, near the targets, none above twice its size
    mixed = pipeline.mix_sources(spark, docs, str(tmp_path)).collect()
    counts = collections.Counter((str(r["doc_id"]), r["text"] or "") for r in mixed)
    have = collections.Counter((str(r[0]), r[1] or "") for r in rows)
    assert all(counts[k] <= 2 * have[k] for k in counts)
    sizes, taken = collections.Counter(), collections.Counter()
    for r, w in zip(rows, split):
        sizes[r[3]] += len(w)
    for r in mixed:
        taken[r["source"]] += len((r["text"] or "").split())
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 4 * 120 and all(taken[s] <= 2 * sizes[s] for s in sizes)


def test_mixing_by_weights_and_clashing_names(spark):
    from siltstone.llm import mixing

    rows = [(k, "w " * (5 + k % 7), f"s{k % 2}", 7, float(1 + k % 4)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row int, w double").withColumn("odds", F.lit("x")).withColumn("u", F.lit("x"))
    plain = mixing.mix(docs).collect()
    assert len(plain) == 400 and {r["copies"] for r in plain} <= {0, 1, 2}
    for weight in (None, "w"):
        got = mixing.mix(docs, weight=weight).collect()
        for s in ("s0", "s1"):
            own = [r for r in got if r["source"] == s]
            # s0 is wanted twice whole: unequal weights meet the cap there
            assert (weight and s == "s0") or abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 12
            assert all(r["copies"] <= 2 for r in own)
    by = {k: sum(r["copies"] for r in got if r["doc_id"] % 4 == k) for k in range(4)}
    assert by[3] > 1.5 * by[1] and by[2] > by[0]


@pytest.mark.parametrize("name", ["op2_mix_sources", "op3_byte_bpe", "op5_substring_dedup", "op6_toxicity", "op7_telephony_audio", "op8_token_files", "op9_minhash_neardup", "op10_suffix_dedup"])
def test_empty_tables(spark, tmp_path, name):
    from siltstone.llm import queries

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_decoder_finds_the_best_reading():
    """Viterbi against every reading of the lattice."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(5)
    counts = rng.integers(0, 30, toxicity.CLASSES**4) * (rng.random(toxicity.CLASSES**4) < 0.3)
    model = toxicity.log_model(np.flatnonzero(counts), counts[counts > 0].astype(float))

    def value(parts):
        state, total = (0, 0, 0), sum(cost for _, cost in parts)
        for letter in "".join(add for add, _ in parts).encode():
            k = int(toxicity._CLASS[letter])
            if k or state[2]:
                total += float(model[((state[0] * 28 + state[1]) * 28 + state[2]) * 28 + k])
                state = (*state[1:], k)
        return total + (float(model[((state[0] * 28 + state[1]) * 28 + state[2]) * 28]) if state[2] else 0.0)

    for span in ("gr0n", "l o s", "a1|o", "sss+t", "b-l0 0d", "$h1 t", "gru nt0", "x", "1!"):
        decoder = toxicity.Decoder(model)
        readings = list(itertools.product(*decoder.options(span)))
        best = max(map(value, readings))
        found = decoder(span)
        texts = ["".join(add for add, _ in r) for r in readings if value(r) > best - 1e-4]
        assert any(sorted({*t.split(" ")} - {*toxicity.GAP.split(span), ""}) == found for t in texts), span


def test_rare_toxic_forms_are_counted_by_themselves(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(3000)]
    rows = []
    for k in range(900):
        text = rng.sample(words, 40)
        if k % 6 == 0:
            text[rng.randrange(40)] = "zzrareform"
        rows.append((k, " ".join(text), int(k % 6 == 0)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, labels).collect()}
    assert sum(got[k] == y for k, _, y in rows) >= 0.99 * len(rows)


def test_foreign_and_cut_audio_gives_null(spark):
    import struct

    from siltstone.llm import audio

    good = audio.pack(bytes(128), "adpcm")
    files = [good, good[:-3], good[:30], b"RIFF\x00\x00\x00\x00WAVEfmt \x04\x00\x00\x00\x11\x00\x01\x00data\x00\x00\x00\x00", audio.header("adpcm", 54) + bytes(54), b"RIFF", b"", None]
    files.append(good[:20] + struct.pack("<HH", 17, 2) + good[24:])
    df = spark.createDataFrame([(k, 128, None if f is None else bytearray(f)) for k, f in enumerate(files)], "doc_id long, n_bytes long, media binary")
    assert {r["doc_id"] for r in audio.pcm_column(df).collect() if r["pcm"] is not None} == {0}
    assert {r["doc_id"] for r in audio.digests(df).collect() if r["feature"] is not None} == {0}


def test_a_large_group_of_near_copies_proposes_few_pairs(spark, monkeypatch):
    """Edits that several copies share keep all of them open; they are linked as by brute force, by few proposals for each."""
    rng = random.Random(1)
    base, proposed = passages(1, 150, 1)[0].split(), []

    def edited(words, n):
        at = set(rng.sample(range(len(words)), n))
        return [rng.choice("klmnopqr") if k in at else w for k, w in enumerate(words)]

    copies = [edited(base, rng.randint(1, 7)) for _ in range(600)]
    copies += [edited(c, rng.randint(1, 4)) for c in copies[:60]] + [c[: rng.randint(110, 149)] for c in copies[60:90]]
    rng.shuffle(copies)
    sets, root = [{tuple(c[i : i + 5]) for i in range(len(c) - 4)} for c in copies], list(range(len(copies)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and 100 * len(a & b) >= 75 * len(a | b):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    proposals = neardup.proposals

    def counted(*given):
        proposed.append((more := proposals(*given)).count())
        return more

    monkeypatch.setattr(neardup, "proposals", counted)
    got = neardup.classes(spark.createDataFrame([(k, " ".join(c)) for k, c in enumerate(copies)], "doc_id long, text string").repartition(4)).collect()
    assert [r["component_id"] for r in sorted(got)] == root
    assert sum(proposed) < 10 * len(copies)
