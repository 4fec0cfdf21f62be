"""Replay files: a header and a list of operations, as the operation logs of the engine."""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import KV_OPS, TS_OPS
from . import pieces

#: Fixed value: the file's magic number.
MAGIC = 0x54424452
#: Entries of a file that are made rows at once.
ENTRIES = 1 << 16
_OPS = {1: "set", 2: "delete", 3: "get"}


def header(data: bytes) -> tuple[int, int]:
    """Kind (1 key-value, 2 time series) and number of entries."""
    magic, version, kind, count = struct.unpack_from("<IHHI", data)
    if magic != MAGIC or version != 1 or kind not in (1, 2):
        raise ValueError("no replay file")
    return kind, count


def entries(data: bytes) -> Iterator[tuple]:
    """(place, op, key, value) or (place, time, data) of each entry."""
    kind, count = header(data)
    at = 12
    for k in range(count):
        if kind == 1:
            op, key_len, value_len = struct.unpack_from("<BBH", data, at)
            key, at = data[at + 4 : at + 4 + key_len], at + 4 + key_len
            value = data[at : at + value_len] if op == 1 else None
            at += value_len if op == 1 else 0
            yield k, _OPS.get(op, "unknown"), key, value
        else:
            time, size = struct.unpack_from("<IH", data, at)
            yield k, time, data[at + 6 : at + 6 + size]
            at += 6 + size


def read(spark: SparkSession, path: str, kind: int, whole: bool = False) -> DataFrame:
    """The operations of replay files of a kind.  Each file is a series and read by one task, as its entries are chained.

    whole: the files follow each other by name and are one series, that of the path; places are counted on from file to file.
    """
    files = spark.read.format("binaryFile").load(path)
    if whole:
        heads = sorted(tuple(r) for r in files.select("path", F.substring("content", 1, 12)).collect())  # a row for each file
        firsts = itertools.accumulate((header(bytes(h))[1] for _, h in heads), initial=0)
        files = files.join(F.broadcast(spark.createDataFrame([(name, path, first) for (name, _), first in zip(heads, firsts)], "path string, series string, first long")), "path")
    else:
        files = files.select(F.col("path").alias("series"), F.lit(0).cast("long").alias("first"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first, content in zip(*(batch.column(c).to_pylist() for c in range(3))):
                for some in itertools.batched(entries(content), ENTRIES):
                    columns = [list(c) for c in zip(*some)]
                    place = pa.array(columns[0], pa.int64())
                    place = pc.add(place, first)
                    series = pa.repeat(pa.scalar(name), len(place))
                    if kind == 1:
                        yield pa.RecordBatch.from_arrays([series, place, pa.array(columns[1]), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], ["series", "seq", "op", "key", "value"])
                    else:
                        yield pa.RecordBatch.from_arrays([series, place, pa.repeat(pa.scalar("append"), len(place)), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["series", "arrival", "op", "req_time", "data"])

    return files.select("series", "first", "content").mapInArrow(run, KV_OPS if kind == 1 else TS_OPS)


def encoded(ops: DataFrame, kind: int) -> DataFrame:
    """(place, entry) of operations (seq, op, key, value) or appends (arrival, req_time, data): the bytes of each entry, made in the JVM."""
    number = lambda c, size: F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(c, 8 * k).bitwiseAND(F.lit(0xFF))), 2, "0") for k in range(size)]))
    if kind == 1:
        code = F.when(F.col("op") == "set", 1).when(F.col("op") == "delete", 2).otherwise(3).cast("long")
        value = F.when(F.col("op") == "set", F.coalesce("value", F.lit(b""))).otherwise(F.lit(b""))
        return ops.select(F.col("seq").alias("place"), F.concat(number(code, 1), number(F.length("key").cast("long"), 1), number(F.length(value).cast("long"), 2), "key", value).alias("entry"))
    return ops.where("op = 'append'").select(F.col("arrival").alias("place"), F.concat(number(F.col("req_time").cast("long"), 4), number(F.length("data").cast("long"), 2), "data").alias("entry"))


def write(ops: DataFrame, path: str, kind: int) -> None:
    """The replay files of a log, in its order, written by all tasks; `read` with `whole` makes one log of them again."""
    spark = ops.sparkSession
    rows = encoded(ops, kind).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "place").sortWithinPartitions("place")
    pieces.save(rows.select(F.spark_partition_id().cast("long").alias("part"), "entry"), path, lambda n: struct.pack("<IHHI", MAGIC, 1, kind, n))
