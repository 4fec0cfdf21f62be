"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the contracts call a word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Tables up to this many narrow rows (counted first) may be broadcast.
BROADCAST_ROWS = 10_000
#: Bytes of text that a Python worker handles at once.
CHUNK_BYTES = 2_000_000

#: The ASCII white space of WORD.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACE_BYTES)] = True


#: The name of a row number, private enough not to meet a column of the input.
ROW = "_siltstone_row"
#: One column chunk at a time is read into the heap, not several into direct buffers that stay with the reading threads.
READ = {"parquet.hadoop.vectored.io.enabled": "false"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.options(**READ).parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set and all executors are on this machine."""
    if not (root := spark.conf.get("spark.checkpoint.dir", None)):
        root = spark.conf.get("siltstone.local.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="siltstone-")
            spark.conf.set("siltstone.local.dir", root)
    return f"{root.rstrip('/')}/siltstone-{spark.sparkContext.applicationId}"


_SCOPE: list[str] = []


@contextlib.contextmanager
def scope(name: str) -> Iterator[str]:
    """What is staged inside goes to a folder of its own, by which it can be dropped."""
    _SCOPE.append(name)
    try:
        yield name
    finally:
        _SCOPE.pop()


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stage(df: DataFrame, label: str, narrow: bool = False, **options: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage ends there.

    narrow: a table of a few numbers for each row goes to an eighth of the shuffle's tasks, so that it is not many tiny files.
    """
    path = "/".join([shared_dir(df.sparkSession), *_SCOPE, f"{label}-{uuid.uuid4().hex}"])
    out = df.coalesce(max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)) if narrow else df
    out.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return df.sparkSession.read.options(**READ).schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row (ROW), staged so that it stays the same however often it is read."""
    return stage(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def drop_stages(spark: SparkSession) -> None:
    """Delete every staged table of this application."""
    drop_path(spark, shared_dir(spark))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the (staged) table has been counted as small, else leave the join to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values' bytes end to end, and where each begins (one more: the end).  Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about so many bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start..start+length-1 of each range, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
BASE = 0x9E3779B97F4A7C15 | 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE modulo 2^64, and of its inverse: for sums that may collide, never where equality is claimed."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = pow(BASE, -1, 1 << 64)
        up, down = np.full(size, BASE, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[0] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have[0][:n], have[1][:n]


def load8(data: np.ndarray) -> np.ndarray:
    """For each place, the eight bytes from it on as one integer (zeros beyond the end); a view of a padded copy."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


#: Ranges of more bytes than this are hashed by a cryptographic hash, one by one.
LONG_RANGE = 256


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] (bytes) for each range: equal content, equal hash.

    Eight bytes at a time go through a bijection that is not linear, so no string collides with another by its form alone.
    Whoever needs certainty compares the bytes.
    """
    at, left = load8(data), ends - starts
    out = mix64(left.astype(np.uint64) + np.uint64(0xD6E8FEB86659FD93))
    long = np.flatnonzero(left > LONG_RANGE)
    todo, place, left = (np.arange(len(starts)), starts, left) if not len(long) else ((t := np.flatnonzero(left <= LONG_RANGE)), starts[t], left[t])
    while len(todo):
        some = left > 0
        if not some.all():
            todo, place, left = todo[some], place[some], left[some]
            if not len(todo):
                break
        value = at[place]
        short = np.flatnonzero(left < 8)
        value[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
        out[todo] = mix64((out[todo] ^ value) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        place, left = place + 8, left - 8
    for k in long:
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in data, and how many words each row has."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    solid = ~IS_SPACE[data]
    before = np.empty(len(solid), bool)
    before[0] = False
    before[1:] = solid[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(len(solid), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return starts, ends, counts


def word_numbers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every word its number among the different words here (by its bytes), and how many words each row has."""
    starts, ends, counts = words_of(data, offsets)
    solid = data[~IS_SPACE[data]]
    upto = np.concatenate([[0], np.cumsum(ends - starts)])
    kind, upto = (pa.large_binary(), upto.astype(np.int64)) if len(solid) >= 1 << 31 else (pa.binary(), upto.astype(np.int32))
    words = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(upto), pa.py_buffer(solid)]).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), counts


def single_spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """data with one space between words, and where the words (starts, ends) stand in it."""
    keep = ~IS_SPACE[data]
    after = ends[ends < len(data)]
    keep[after] = True
    out = data[keep]
    out[IS_SPACE[out]] = 0x20
    upto = np.concatenate([[0], np.cumsum(keep)])
    return out.tobytes(), upto[starts], upto[starts] + ends - starts


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(0x20), data).astype(np.uint8)
