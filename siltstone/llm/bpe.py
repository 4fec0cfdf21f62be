"""Byte-level BPE encoding and decoding (operator 3), and the word-piece encoder of operator 8.

Both run the tokenizers library over Arrow batches.  A text is first cut where ASCII white
space follows another ASCII character or a Latin letter and where an ASCII mark follows a Latin letter: no match of either
pre-tokenizer's pattern crosses such a place, so each piece can be encoded by itself.  The pieces of a batch are
dictionary-encoded and the library sees every distinct piece once for as long as the worker
remembers it (CACHE_BYTES), the rest being array work.

Cases: a null text counts as empty and has no ids; repeated rows are encoded one by one; other
columns, whatever their names, are not read; an empty table gives an empty result; a text of any
length is one piece list, never cut short.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import IS_SPACE, as_bytes, chunks, gather_ranges

#: Bytes (the objects' own included) of pieces that a worker remembers in each of its two memories; then that one starts anew.
CACHE_BYTES = 96_000_000

_LOADED: dict = {}


class Memory(dict):
    """Ids by piece, forgotten as a whole before they take more than CACHE_BYTES."""

    held = 0

    def learn(self, pieces: list[bytes], ids: list[bytes]) -> None:
        self.held += sum(map(len, pieces)) + sum(map(len, ids)) + 200 * len(pieces)
        if self.held > CACHE_BYTES:
            self.clear()
            self.held = 0
        self.update(zip(pieces, ids))


def _library():
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tokenizers

    return tokenizers


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Bytes that print in Latin-1 stand for themselves; the others take the code points from 256 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = dict(zip(shown, map(chr, shown))), 256
    for b in range(256):
        if b not in table:
            table[b], spare = chr(spare), spare + 1
    return [table[b] for b in range(256)]


def ranks_of(path: str) -> dict[bytes, int]:
    """The token bytes and ranks of a .tiktoken file."""
    import base64

    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def _merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge that made each token: its bytes, merged by lower ranks only, end as two parts."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:
            found = [(ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1)]
            low, i = min(found)
            if low >= rank:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


#: A space or line end, Latin letters (the Latin-1 ones as UTF-8), ASCII marks without the apostrophe.
PLAIN = re.compile(rb"([ \n]?)((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)").fullmatch
SHOWN = dict(enumerate(byte_alphabet()))
SHOWN_WORDS = {k: v for k, v in SHOWN.items() if k != 0x0A}


class ByteBpe:
    """A byte-level BPE of the tokenizers library, built from a rank file and a split pattern."""

    def __init__(self, path: str, pattern: str):
        lib, ranks = _library(), ranks_of(path)
        alphabet = byte_alphabet()
        show = lambda token: "".join(alphabet[b] for b in token)
        model = lib.models.BPE(vocab={show(t): r for t, r in ranks.items()}, merges=[(show(a), show(b)) for a, b in _merges(ranks)], cache_capacity=0)
        self.tokenizer = lib.Tokenizer(model)
        self.tokenizer.pre_tokenizer = lib.pre_tokenizers.Sequence([lib.pre_tokenizers.Split(lib.Regex(pattern), "isolated"), lib.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.model = model
        #: The bytes of each id, end to end, and where they begin: decoding is a gather over this table.
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.cache, self.parts = Memory(), Memory()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as native uint32 bytes.

        One leading space or line end, letters, then marks: the pattern parts these into at most three
        matches, so the model gets them at once and remembers the parts.  Any other piece is split by the library.
        """
        out, rest, parts = [b""] * len(pieces), [], self.parts
        for i, piece in enumerate(pieces):
            if m := PLAIN(piece):
                lead, word, marks = m.groups()
                if not marks and lead != b"\n":
                    out[i] = self._ids(piece)
                    continue
                keys = (b" " + word, marks) if lead == b" " else (lead, word, marks)
                out[i] = b"".join([parts.get(k) or self._remembered(k) for k in keys if k])
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i].decode("utf-8", "replace") for i in rest], add_special_tokens=False), strict=True):
            out[i] = array("I", e.ids).tobytes()
        return out

    def _ids(self, part: bytes) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(part.decode("latin-1").translate(SHOWN))]).tobytes()

    def _remembered(self, part: bytes) -> bytes:
        ids = self._ids(part)
        self.parts.learn([part], [ids])
        return ids

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids.  A character split over several ids comes whole, as bytes are joined first."""
        return self.flat[gather_ranges(self.begins[ids], self.lengths[ids])]

    def offsets(self, text: str) -> list[tuple[int, int, int]]:
        """(id, first character, end) of each token; the parts of a split character all span that character."""
        raw = text.encode()
        ids = np.frombuffer(b"".join(self.encode_pieces(pieces_of_text(raw))), np.uint32)
        ends = np.cumsum(self.lengths[ids]) if len(ids) else np.zeros(0, np.int64)
        lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        upto = np.concatenate([[0], np.cumsum(lead)])
        return [(int(i), int(upto[b + 1] - 1), int(upto[e])) for i, b, e in zip(ids, ends - self.lengths[ids], ends)]


class WordBpe:
    """A word-piece tokenizer file of the tokenizers library; white space only parts its words."""

    def __init__(self, path: str):
        lib = _library()
        self.tokenizer = lib.Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cache, self.parts = Memory(), Memory()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as native uint32 bytes.  Letters and the marks after them are words of their own to the pattern."""
        out, rest, jobs, words = [b""] * len(pieces), [], [], []
        known, parts = self.cache.get, self.parts
        for i, piece in enumerate(pieces):
            if (m := PLAIN(piece.lstrip())) and b"<|" not in piece:
                _, word, marks = m.groups()
                ids = known(b" " + word) if marks else None
                jobs.append((i, ids, len(words), marks))
                if ids is None:
                    words.append(word)
            else:
                rest.append(i)
        coded = self._ids(words)
        for i, ids, k, marks in jobs:
            ids = coded[k] if ids is None else ids
            if marks and (more := parts.get(marks)) is None:
                more = self._ids([marks])[0]
                parts.learn([marks], [more])
            out[i] = ids + more if marks else ids
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i].decode("utf-8", "replace") for i in rest], add_special_tokens=False), strict=True):
            out[i] = array("I", e.ids).tobytes()
        return out

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of words without white space: all are lower-cased and mapped to the vocabulary's characters at once."""
        if not words:
            return []
        shown = b"\n".join(words).decode().lower().encode().decode("latin-1").translate(SHOWN_WORDS).split("\n")
        tokenize = self.model.tokenize
        return [array("I", [t.id for t in tokenize(x)]).tobytes() for x in shown]


def loaded(kind: type, *args: str):
    """One tokenizer for each worker and file."""
    if (key := (kind.__name__, *args)) not in _LOADED:
        _LOADED[key] = kind(*args)
    return _LOADED[key]


LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
#: Second bytes of the Latin-1 letters in UTF-8, after C3 (without the multiplication and division signs).
SECOND = np.zeros(256, bool)
SECOND[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: at each row, at white space after a Latin letter or an ASCII character that is none, and at an ASCII mark after a letter.

    The separators 1C-1F count as white space to some patterns, so no cut follows one.  If the text
    may hold a special token's string, marks are no places to cut.
    """
    cut = np.zeros(len(data), bool)
    if len(data):
        space, letter = IS_SPACE[data], LETTER[data]
        last = data[:-1]
        letter[1:] |= (last == 0xC3) & SECOND[data[1:]]
        cut[1:] = space[1:] & ~space[:-1] & ((last < 0x80) & (last > 0x1F) | letter[:-1])
        if b"<|" not in data.tobytes():
            cut[1:] |= letter[:-1] & MARK[data[1:]]
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(cut)


def pieces_of_text(raw: bytes) -> list[bytes]:
    data = np.frombuffer(raw, np.uint8)
    at = piece_starts(data, np.array([0, len(data)]))
    return [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])]


def encode_rows(bpe, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids end to end, and where each row's begin (one more: the end)."""
    starts = piece_starts(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    bounds = np.append(starts, len(data)).astype(np.int32)
    array = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    coded = array.dictionary_encode()
    codes, distinct, cache = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), bpe.cache
    values = [cache.get(p) for p in distinct]
    if missing := [i for i, v in enumerate(values) if v is None]:
        new = [distinct[i] for i in missing]
        ids = bpe.encode_pieces(new)
        for i, v in zip(missing, ids):
            values[i] = v
        cache.learn(new, ids)
    lengths = np.fromiter(map(len, values), np.int64, len(values)) // 4
    flat = np.frombuffer(b"".join(values), np.uint32)
    begins = np.cumsum(lengths) - lengths
    ids = flat[gather_ranges(begins[codes], lengths[codes])]
    upto = np.concatenate([[0], np.cumsum(lengths[codes])])
    return ids, upto[np.searchsorted(starts, offsets)]


def encode_batches(make: Callable[[], object], rows: Callable[[object, pa.RecordBatch, int, int, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function over (doc_id, text): rows() gets the ids of some rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = make()
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            for i, j in chunks(offsets):
                part = data[offsets[i] : offsets[j]]
                ids, upto = encode_rows(bpe, part, offsets[i : j + 1] - offsets[i])
                yield rows(bpe, batch, i, j, ids, upto, part)

    return run


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, byte_ends): the ids of each text and, for each, the end of its bytes in the text."""

    def rows(bpe, batch, i, j, ids, upto, _):
        ends = np.cumsum(bpe.lengths[ids])
        first = np.concatenate([[0], ends])[upto[:-1]]
        ends = ends - np.repeat(first, np.diff(upto))
        lists = lambda v, t: pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(v, t))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), lists(ids.astype(np.int32), pa.int32()), lists(ends.astype(np.int32), pa.int32())], ["doc_id", "ids", "byte_ends"])

    return docs.select("doc_id", "text").mapInArrow(encode_batches(lambda: loaded(ByteBpe, path, pattern), rows), "doc_id long, ids array<int>, byte_ends array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data binary): the bytes of `ids`; null ids give no bytes."""

    def run(batches):
        bpe = loaded(ByteBpe, path, pattern)
        for batch in batches:
            out = [bpe.decode(np.array(x or [], np.int64)).tobytes() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes."""

    def rows(bpe, batch, i, j, ids, upto, part):
        raw = ids.astype("<u4")
        decoded = bpe.decode(ids)
        cut = np.concatenate([[0], np.cumsum(bpe.lengths[ids])])[upto]
        digest = lambda v, a, b: hashlib.sha256(memoryview(v[a:b])).hexdigest()
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").slice(i, j - i),
                pa.array(np.diff(upto), pa.int64()),
                pa.array([digest(raw, a, b) for a, b in zip(upto[:-1], upto[1:])]),
                pa.array([digest(decoded, a, b) for a, b in zip(cut[:-1], cut[1:])]),
                pa.array(np.diff(cut), pa.int64()),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"],
        )

    return docs.select("doc_id", "text").mapInArrow(encode_batches(lambda: loaded(ByteBpe, path, pattern), rows), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")
