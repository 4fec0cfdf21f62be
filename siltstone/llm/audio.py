"""Media columns: telephony audio (operator 7).

A media column holds WAV files of 8 kHz mono telephone speech: mu-law or A-law samples of one byte, or IMA ADPCM
blocks.  `pack` builds the files, `unpack` reads them back by their chunks.  Companded samples are expanded by a
lookup table of 256 entries; ADPCM is decoded sample by sample with numpy *across* blocks: a block starts with its own
predictor, so all blocks of a batch advance together.  `resample` doubles the rate by linear interpolation, and
`to_pcm` stores the result as a 16-bit WAV column.

Cases: a null or empty payload is padded to one block of zeros; a file that is no such WAV gives null samples in
`to_pcm`; equal payloads give equal files and features; an empty table gives no rows; extra columns are not read; a
payload of any length is one file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, chunks, stage

RATE, BLOCK = 8000, 64
#: WAV format tags.
CODECS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
#: Fixed values of IMA ADPCM: how the step index moves, and the step sizes.
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)


def mulaw_table() -> np.ndarray:
    """16-bit PCM of each mu-law code (G.711): the code is stored inverted as sign, exponent, mantissa."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit PCM of each A-law code (G.711): even bits are inverted; exponent 0 has no leading bit."""
    code = np.arange(256) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks, shape (n, block bytes) -> (n, samples): all blocks advance one nibble at a time."""
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    nibbles = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * nibbles.shape[0] + 1, len(blocks)), np.int16)
    out[0] = value = head
    for k in range(2 * nibbles.shape[0]):
        code = (nibbles[k >> 1] >> (4 * (k & 1))) & 15
        step, low = STEPS[index], (code & 7).astype(np.int32)
        change = ((2 * low + 1) * step) >> 3
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        out[k + 1] = value
        index = np.clip(index + INDEX_MOVES[low], 0, 88)
    return out.T


def header(codec: str, n: int) -> bytes:
    """RIFF, fmt, fact and the head of the data chunk for n bytes of samples."""
    adpcm = codec == "adpcm"
    samples = n // BLOCK * (2 * (BLOCK - 4) + 1) if adpcm else n
    align, bits = (BLOCK, 4) if adpcm else (1, 8)
    extra = struct.pack("<H", 2 * (BLOCK - 4) + 1) if adpcm else b""
    fmt = struct.pack("<HHIIHHH", CODECS[codec], 1, RATE, RATE * align // (2 * (BLOCK - 4) + 1) if adpcm else RATE, align, bits, len(extra)) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", n)
    return b"RIFF" + struct.pack("<I", len(body) + n) + body


def pack(payload: bytes, codec: str) -> bytes:
    return header(codec, len(payload)) + payload


def unpack(media: bytes) -> tuple[str, memoryview] | None:
    """Codec and sample bytes of a WAV file, by its chunks; None if it is not one of CODECS with one channel, or is cut short."""
    view = memoryview(media)
    if len(view) < 12 or bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        return None
    at, codec = 12, None
    while at + 8 <= len(view):
        kind, n = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if at + 8 + n > len(view):
            return None
        if kind == b"fmt " and n >= 16:
            code, channels, _, _, align = struct.unpack_from("<HHIIH", view, at + 8)
            codec = {v: k for k, v in CODECS.items()}.get(code) if channels == 1 else None
            if codec == "adpcm" and align != BLOCK:
                codec = None
        if kind == b"data":
            return (codec, view[at + 8 : at + 8 + n]) if codec and (codec != "adpcm" or n % BLOCK == 0) else None
        at += 8 + n + (n & 1)
    return None


def padded(text: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of a block."""
    return text + bytes(-len(text) % BLOCK or (BLOCK if not text else 0))


def samples_of(codec: str, data: np.ndarray) -> np.ndarray:
    """16-bit PCM of stored sample bytes (whole blocks)."""
    return adpcm_decode(data.reshape(-1, BLOCK)).reshape(-1) if codec == "adpcm" else TABLES[codec][data]


def resample(pcm: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Twice the rate: between two samples of a file stands their mean (rounded down); ends: where the files end."""
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    wide = pcm.astype(np.int32)
    out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
    last = ends[ends > 0] - 1
    out[2 * last + 1] = pcm[last]
    return out


def codec_of(payload: bytes) -> str:
    """The codec that the query stores a payload in: a function of its first byte alone."""
    return ("mulaw", "alaw", "adpcm")[payload[0] % 3]


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text's padded bytes as a WAV file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            for i, j in chunks(offsets):
                raw = data[offsets[i] : offsets[j]].tobytes()
                files = []
                for a, b in zip(offsets[i:j] - offsets[i], offsets[i + 1 : j + 1] - offsets[i]):
                    payload = padded(raw[a:b])
                    files.append(pack(payload, codec_of(payload)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(offsets[i : j + 1]), pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decoded(files: list[bytes | None]) -> Iterator[tuple[int, str, bytes, np.ndarray, np.ndarray]]:
    """(place, codec, stored bytes, PCM, resampled PCM) of each readable file; the files of a codec are decoded together."""
    by: dict[str, list[tuple[int, memoryview]]] = {}
    for k, media in enumerate(files):
        if media is not None and (got := unpack(media)):
            by.setdefault(got[0], []).append((k, got[1]))
    for codec, own in by.items():
        data = np.frombuffer(b"".join(v for _, v in own), np.uint8)
        sizes = np.array([len(v) for _, v in own], np.int64)
        pcm = samples_of(codec, data)
        ratio = 2 * (BLOCK - 4) + 1
        ends = np.cumsum(sizes // BLOCK * ratio if codec == "adpcm" else sizes)
        double = resample(pcm, ends) if len(pcm) else pcm
        for (k, v), a, b in zip(own, np.concatenate([[0], ends[:-1]]), ends):
            yield k, codec, v, pcm[a:b], double[2 * a : 2 * b]


def pcm_column(media: DataFrame) -> DataFrame:
    """(doc_id, pcm): the resampled audio as a 16-bit WAV file; null where `media` is no telephone WAV."""

    def run(batches):
        for batch in batches:
            _, offsets = as_bytes(batch.column("media"))
            for i, j in chunks(offsets, 500_000):
                files = batch.column("media").slice(i, j - i).to_pylist()
                out: list[bytes | None] = [None] * (j - i)
                for k, _, _, _, double in decoded(files):
                    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 2 * RATE, 4 * RATE, 2, 16) + b"data" + struct.pack("<I", 2 * len(double))
                    out[k] = b"RIFF" + struct.pack("<I", len(body) + 2 * len(double)) + body + double.astype("<i2").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(out, pa.binary())], ["doc_id", "pcm"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, pcm binary")


def features(pcm: np.ndarray, double: np.ndarray, codec: str) -> str:
    """Codec, samples, peak, mean magnitude, sign changes and the checksum of the resampled PCM."""
    wide = pcm.astype(np.int32)
    size = np.abs(wide)
    signs = int(np.count_nonzero((wide[1:] < 0) != (wide[:-1] < 0)))
    return f"{codec}:{len(pcm)}:{int(size.max(initial=0))}:{int(size.sum(dtype=np.int64)) // max(1, len(pcm))}:{signs}:{zlib.crc32(double.astype('<i2').tobytes()):08x}"


def digests(media: DataFrame) -> DataFrame:
    """What the stored files hold: sizes, digests of payload and file, and the audio's features."""

    def run(batches):
        for batch in batches:
            _, offsets = as_bytes(batch.column("media"))
            for i, j in chunks(offsets, 500_000):
                files = batch.column("media").slice(i, j - i).to_pylist()
                rows: list[tuple | None] = [None] * (j - i)
                for k, codec, stored, pcm, double in decoded(files):
                    rows[k] = (len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-64:]), len(files[k]), hashlib.sha256(files[k]).hexdigest(), features(pcm, double, codec))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                columns = [pa.array([r and r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("n_bytes").slice(i, j - i), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def stored_digests(docs: DataFrame) -> DataFrame:
    """Store the media table in the shared folder, read it back and describe it."""
    return digests(stage(media_column(docs), "media"))
