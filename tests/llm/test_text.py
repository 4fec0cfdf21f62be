"""Tokenizers, token files, audio and mixing against plain versions."""

import hashlib
import random
import wave
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from siltstone.llm import audio, bpe, common, mixing, tokenfiles  # noqa: E402

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "the cat", "  two  spaces\n\n and\ttabs ", "don't WE'LL <|endoftext|> x", "Ünï— café… ﬁ 漢字 \U0001f600", "a" * 5000, "word " * 4000, "1 22 333\x1c x\xa0 y　 z", "é" * 7 + "?!"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s%d" % (k % 3) if k % 4 else None, 0, "clash") for k, t in enumerate(TEXTS + TEXTS[2:5])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string").repartition(3)


def oracle():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(BYTE), special_tokens={})


def encoded(coder, text):
    data, offsets = common.as_bytes(pa.array([text]))
    return bpe.encode_rows(coder, data, offsets)[0].tolist()


@given(st.text(alphabet=st.one_of(st.sampled_from("abZé' \n\t.,!<|>endoftx1\x1c\xa0　ß漢"), st.characters(codec="utf-8")), max_size=60))
@settings(max_examples=300, deadline=None)
def test_both_encoders_equal_the_libraries(text):
    tiny, word = bpe.loaded(bpe.ByteBpe, BYTE, public_tokenizers.PATTERN), bpe.loaded(bpe.WordBpe, WORD)
    assert encoded(tiny, text) == _reference().encode_ordinary(text)
    assert encoded(word, text) == word.tokenizer.encode(text, add_special_tokens=False).ids
    assert tiny.decode(np.array(encoded(tiny, text), np.int64)).tobytes() == text.encode()


_KEEP = {}


def _reference():
    if "t" not in _KEEP:
        _KEEP["t"] = oracle()
    return _KEEP["t"]


def test_round_trip_query(spark, docs):
    rows = {r["doc_id"]: r for r in bpe.round_trip(docs, BYTE, public_tokenizers.PATTERN).collect()}
    ref = _reference()
    for k, t in enumerate(TEXTS + TEXTS[2:5]):
        ids = ref.encode_ordinary(t or "")
        assert rows[k]["n_tokens"] == len(ids)
        assert rows[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_encode_decode_and_offsets(spark, docs):
    ids = bpe.encode(docs, BYTE, public_tokenizers.PATTERN)
    back = {r["doc_id"]: bytes(r["data"]).decode() for r in bpe.decode(ids, BYTE, public_tokenizers.PATTERN).collect()}
    assert back == {k: t or "" for k, t in enumerate(TEXTS + TEXTS[2:5])}
    text = "a 漢字\U0001f600b"
    spans = bpe.loaded(bpe.ByteBpe, BYTE, public_tokenizers.PATTERN).offsets(text)
    assert spans[0][1] == 0 and spans[-1][2] == len(text) and all(a < b for _, a, b in spans)
    assert {a for _, a, _ in spans} | {b for _, _, b in spans} >= {0, len(text)}


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, docs, tmp_path, encoding):
    out = str(tmp_path / encoding)
    tokenfiles.write_tokens(docs, out, WORD, encoding=encoding, page_rows=2)
    word, start = bpe.loaded(bpe.WordBpe, WORD).tokenizer, 0
    rows = {r["doc_id"]: r for r in tokenfiles.token_index(spark, out).collect()}
    for k, t in enumerate(TEXTS + TEXTS[2:5]):
        ids = [*word.encode(t or "", add_special_tokens=False).ids, 2]
        assert (rows[k]["start"], rows[k]["n_tokens"], rows[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokenfiles.read_tokens(spark, out).where("doc_id = 2").select("n_tokens").first()[0] == rows[2]["n_tokens"]


def test_tables_agree_with_the_rules():
    # the decision levels that G.711 gives for the largest and smallest codes
    assert (audio.TABLES["mulaw"][0x00], audio.TABLES["mulaw"][0x80], audio.TABLES["mulaw"][0xFF]) == (-32124, 32124, 0)
    assert (audio.TABLES["alaw"][0xD5], audio.TABLES["alaw"][0x55], audio.TABLES["alaw"][0xAA]) == (8, -8, 32256)


def slow_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            change = ((2 * (code & 7) + 1) * step) >> 3
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(audio.INDEX_MOVES[code & 7])))
            out.append(value)
    return out


def test_adpcm_across_blocks():
    raw = np.random.default_rng(0).integers(0, 256, (50, 64)).astype(np.uint8)
    assert audio.adpcm_decode(raw).tolist() == [slow_adpcm(b.tolist() and bytes(b)) for b in raw]


def test_media_query_and_pcm(spark, docs, tmp_path):
    media = audio.media_column(docs)
    rows = {r["doc_id"]: r for r in audio.stored_digests(docs).collect()}
    for k, t in enumerate(TEXTS + TEXTS[2:5]):
        raw = (t or "").encode()
        payload = raw + bytes((-len(raw)) % 64 if raw else 64)
        r = rows[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert rows[2]["feature"] == rows[len(TEXTS)]["feature"]
    pcm = {r["doc_id"]: r["pcm"] for r in audio.pcm_column(media).collect()}
    path = tmp_path / "x.wav"
    path.write_bytes(pcm[7])
    with wave.open(str(path)) as w:
        assert (w.getframerate(), w.getsampwidth(), w.getnchannels()) == (16000, 2, 1) and w.getnframes() > 0
    odd = spark.createDataFrame([(1, bytearray(b"RIFF")), (2, None)], "doc_id long, media binary")
    assert [r["pcm"] for r in audio.pcm_column(odd).collect()] == [None, None]


def test_mix(spark):
    rng = random.Random(2)
    rows = [(k, " ".join("w" for _ in range(rng.choice([0, 3, 40, 400]))), rng.choice(["a", "a", "a", "b", "c", None]), "x") for k in range(600)]
    rows += [(7, "w w", "a", "x")] * 3 + [(None, "w w w", "b", "x"), (900, None, None, "x")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, taken string")).collect()
    assert len(out) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    total, got = {}, {}
    for r in out:
        total[r["source"]] = total.get(r["source"], 0) + r["size"]
        got[r["source"]] = got.get(r["source"], 0) + r["taken"]
    target = {r["source"]: r["target"] for r in out}
    assert abs(sum(target.values()) - 1.5 * sum(total.values())) < 1e-6
    assert all(t <= 2 * total[s] + 1e-9 and abs(got[s] - t) <= 400 for s, t in target.items())
    again = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, taken string").repartition(7)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_empty_tables(spark, docs, tmp_path):
    none = docs.limit(0)
    assert mixing.mix(none).count() == 0 and bpe.round_trip(none, BYTE, public_tokenizers.PATTERN).count() == 0 and audio.stored_digests(none).count() == 0
    assert tokenfiles.stored_index(none, WORD).count() == 0
