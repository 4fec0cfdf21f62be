"""Scalar functions as Column expressions: everything stays in the JVM except `crc16_fast`, an Arrow-batched variant."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import INVALID32, STATE_NAMES

MASK32 = 0xFFFFFFFF


def byte_at(data: Column, i: Column | int) -> Column:
    """The i-th byte (from 0) as a number."""
    at = i + 1 if isinstance(i, Column) else F.lit(i + 1)
    return F.conv(F.hex(F.substring(data, at, F.lit(1))), 16, 10).cast("long")


def bytes_of(data: Column) -> Column:
    """The bytes as an array of numbers."""
    digits = F.hex(data)
    return F.when(F.length(data) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.length(data) - 1), lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long")))


def crc16(data: Column, seed: Column | int = 0xFFFF) -> Column:
    """CRC-16/MODBUS: reflected polynomial A001, no final xor; `seed` continues an earlier checksum.  One table lookup for each byte."""
    start = seed if isinstance(seed, Column) else F.lit(seed)
    table = F.array(*[F.lit(int(v)) for v in crc16_table()])

    def step(crc: Column, byte: Column) -> Column:
        return F.shiftright(crc, 8).bitwiseXOR(F.get(table, crc.bitwiseXOR(byte).bitwiseAND(F.lit(0xFF)).cast("int")).cast("long"))

    return F.aggregate(bytes_of(data), start.cast("long"), step).cast("int")


def crc16_table() -> np.ndarray:
    """The checksum of each byte value, from the rule."""
    table = np.arange(256, dtype=np.uint16)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ 0xA001, table >> 1).astype(np.uint16)
    return table


def crc16_bytes(data: bytes, crc: int = 0xFFFF) -> int:
    """The checksum of one string; `crc` continues an earlier one."""
    for b in data:
        crc = (crc >> 8) ^ int(_TABLE[(crc ^ b) & 0xFF])
    return crc


_TABLE = crc16_table()


def crc16_many(values: list[bytes]) -> np.ndarray:
    """The checksums of a batch: all strings advance together, one byte position at a time."""
    sizes = np.array([len(v) for v in values], np.int64)
    order = np.argsort(-sizes, kind="stable")
    joined = np.frombuffer(b"".join(values), np.uint8)
    starts = (np.cumsum(sizes) - sizes)[order]
    crc = np.full(len(values), 0xFFFF, np.uint16)
    for k in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(-sizes[order], -k, side="left"))
        crc[:live] = (crc[:live] >> 8) ^ _TABLE[(crc[:live] ^ joined[starts[:live] + k]) & 0xFF]
    out = np.empty(len(values), np.int64)
    out[order] = crc
    return out


@F.pandas_udf(T.IntegerType())
def crc16_fast(data: pd.Series) -> pd.Series:
    """The same checksum over a batch."""
    out = crc16_many([v if v is not None else b"" for v in data])
    return pd.Series(out).where(~data.isna().reset_index(drop=True)).astype("Int32").set_axis(data.index)


def hash16(data: Column) -> Column:
    """FNV-1a of 32 bits, folded to 16."""
    h = F.aggregate(bytes_of(data), F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619)).bitwiseAND(F.lit(MASK32)))
    return h.bitwiseXOR(F.shiftrightunsigned(h, 16)).bitwiseAND(F.lit(0xFFFF)).cast("int")


def align_up(value: Column, unit: Column | int) -> Column:
    unit = unit if isinstance(unit, Column) else F.lit(unit)
    return F.ceil(value / unit).cast("long") * unit


def seq_gt(a: Column, b: Column) -> Column:
    """a comes after b on a wrapping 32-bit counter."""
    return (a - b).bitwiseAND(F.lit(MASK32)).between(1, 0x7FFFFFFF)


def seq16_gt(a: Column, b: Column) -> Column:
    """a comes after b on a wrapping 16-bit counter."""
    return (a - b).bitwiseAND(F.lit(0xFFFF)).between(1, 0x7FFF)


def gc_reserve(sectors: Column) -> Column:
    return F.when(sectors >= 16, 2).otherwise(1)


def key_status(key: Column) -> Column:
    """OK, TOO_LARGE (no byte or 33) or PARAM (longer, or null)."""
    n = F.length(key)
    return F.when(n.between(1, 32), "OK").when((n == 0) | (n == 33), "TOO_LARGE").otherwise("PARAM")


def kv_record_size(key_len: Column, value_len: Column, gran: Column | int = 1) -> Column:
    return F.lit(16) + align_up(key_len, gran) + align_up(value_len, gran)


def state_name(state: Column) -> Column:
    out = None
    for value, name in STATE_NAMES.items():
        out = F.when(state == value, name) if out is None else out.when(state == value, name)
    return out.otherwise("UNKNOWN")


def lower_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def hex_prefix(data: Column, n: int = 64) -> Column:
    """The first n bytes in lower-case hex."""
    return lower_hex(F.substring(data, 1, n))


def absolute_time(base: Column, delta: Column, engine: bool = True) -> Column:
    """base + delta modulo 2^32; without a base, the delta (engine) or null (analyser)."""
    return F.when(base == INVALID32, delta if engine else F.lit(None).cast("long")).otherwise((base + delta).bitwiseAND(F.lit(MASK32)))


def little_endian(data: Column, at: int, size: int) -> Column:
    """An unsigned integer of `size` bytes."""
    return F.conv(F.concat(*[F.hex(F.substring(data, at + 1 + k, 1)) for k in reversed(range(size))]), 16, 10).cast("long")


def bloom_bits(h: Column) -> Column:
    """The two positions of a 16-bit hash in a filter of 256 bits."""
    return F.array(h.bitwiseAND(F.lit(0xFF)), F.shiftright(h, 8).bitwiseAND(F.lit(0xFF)))


def bloom_filter(hashes: Column) -> Column:
    """An aggregate: the filter of 256 bits, as the sorted set of its positions."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(bloom_bits(hashes)))))


def bloom_maybe(positions: Column, h: Column) -> Column:
    """Whether a filter may hold a hash: false is certain."""
    return F.forall(bloom_bits(h), lambda bit: F.array_contains(positions, bit))


def bloom_weights(hashes: DataFrame) -> np.ndarray:
    """How many of hashes (h) ask for each pair of positions: 256 by 256, whatever the number of hashes."""
    two, out = bloom_bits(F.col("h")), np.zeros((256, 256))
    for low, high, n in hashes.where("h IS NOT NULL").groupBy(two[0], two[1]).agg(F.count(F.lit(1))).collect():
        out[low, high] = n
    return out


def bloom_maybes(positions: Column, weights: np.ndarray) -> Column:
    """For how many of the weighted hashes a filter answers maybe: the sum over pairs of its positions.  Doubles are exact up to 2^53."""

    @F.pandas_udf(T.LongType())
    def count(bits: pd.Series) -> pd.Series:
        held = np.zeros((len(bits), 256))
        for row, some in zip(held, bits):
            row[some] = 1
        return pd.Series(((held @ weights) * held).sum(axis=1).astype(np.int64), bits.index)

    return count(positions)


def ring_next(sector: Column, sectors: Column | int) -> Column:
    return F.pmod(sector + 1, sectors if isinstance(sectors, Column) else F.lit(sectors))


def ring_prev(sector: Column, sectors: Column | int) -> Column:
    return F.pmod(sector - 1, sectors if isinstance(sectors, Column) else F.lit(sectors))


def register(spark: SparkSession) -> None:
    """SQL names for the functions that user code may replace."""
    spark.udf.register("crc16_modbus", crc16_fast)
