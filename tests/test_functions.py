import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import scalar as S

CASES = [(b"123456789", 0x4B37, 0x0A9A), (b"wifi", 0x0220, 0x6360), (b"mode", 0x7EC6, 0x0C7C), (b"count", 0x81C0, 0xE445), (b"alpha", 0x6B6B, 0x3020), (b"WG", 0xB27F, 0xF1B4), (b"samepref00009d", 0xD53F, 0x4325), (b"samepref000190", 0xEA6F, 0x4325)]


def test_checksums_and_hashes(spark):
    df = spark.createDataFrame([(bytearray(b),) for b, _, _ in CASES], "b binary")
    rows = df.select("b", S.crc16(F.col("b")).alias("slow"), S.crc16_fast("b").alias("fast"), S.hash16(F.col("b")).alias("h")).collect()
    assert {bytes(r["b"]): (r["slow"], r["fast"], r["h"]) for r in rows} == {b: (c, c, h) for b, c, h in CASES}


def test_checksum_of_nothing_is_the_seed_and_continues(spark):
    df = spark.createDataFrame([(bytearray(b""), bytearray(b"1234"), bytearray(b"56789"))], "e binary, a binary, b binary")
    row = df.select(S.crc16(F.col("e")).alias("e"), S.crc16_fast("e").alias("f"), S.crc16(F.col("b"), S.crc16(F.col("a"))).alias("c")).first()
    assert (row["e"], row["f"], row["c"]) == (0xFFFF, 0xFFFF, 0x4B37)


@given(st.binary(max_size=80), st.binary(max_size=80))
@settings(max_examples=50, deadline=None)
def test_checksum_streams(a, b):
    assert S.crc16_bytes(b, S.crc16_bytes(a)) == S.crc16_bytes(a + b)


@pytest.mark.parametrize("a,b,after", [(0, 0xFFFFFFFF, True), (0xFFFFFFFF, 0, False), (5, 5, False), (0x80000000, 0, False), (0x7FFFFFFF, 0, True)])
def test_wrapping_order(spark, a, b, after):
    row = spark.createDataFrame([(a, b)], "a long, b long").select(S.seq_gt(F.col("a"), F.col("b")).alias("x")).first()
    assert row["x"] is after


def test_small_functions(spark):
    row = spark.range(1).select(
        S.align_up(F.lit(13), 8).alias("up"),
        S.little_endian(F.lit(bytearray(b"\x01\x02\x03\x04")), 1, 2).alias("le"),
        S.absolute_time(F.lit(0xFFFFFFFE), F.lit(5)).alias("t"),
        S.ring_prev(F.lit(0), 16).alias("p"),
        S.state_name(F.lit(255)).alias("s"),
        S.bloom_bits(F.lit(0x4325)).alias("b"),
    ).first()
    assert (row["up"], row["le"], row["t"], row["p"], row["s"], row["b"]) == (16, 0x0302, 3, 15, "WRITING", [0x25, 0x43])


def test_filters_are_asked_by_pairs_of_bits(spark):
    hashes = [(k * 7919 + k * k) & 0xFFFF for k in range(400)] + [0x0505, 0x0505, 0x1234, None]
    asked = spark.createDataFrame([(h,) for h in hashes], "h int")
    weights = S.bloom_weights(asked)
    assert weights.shape == (256, 256) and weights.sum() == 403 and weights[5, 5] == 2
    filters = spark.createDataFrame([(k, h) for k in range(9) for h in hashes[k * 40 : k * 40 + 1 + 5 * k] + [0x0505]], "sector int, h int").groupBy("sector").agg(S.bloom_filter(F.col("h")).alias("bits"))
    got = {r["sector"]: r["n"] for r in filters.select("sector", S.bloom_maybes(F.col("bits"), weights).alias("n")).collect()}
    assert got == {r["sector"]: sum(h is not None and {h & 255, h >> 8} <= set(r["bits"]) for h in hashes) for r in filters.collect()}
