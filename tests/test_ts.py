import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.operators import ts
from siltstone.schema import INVALID32, TIME_MAX, Geometry

G = Geometry()


def ops(spark, rows, series="a"):
    return spark.createDataFrame([(series, k, op, t, None if d is None else bytearray(d)) for k, (op, t, d) in enumerate(rows)], "series string, arrival long, op string, req_time long, data binary")


def model(rows):
    """One row for each append: (epoch, time, status)."""
    last = epoch = 0
    out = []
    for op, t, d in rows:
        if op == "reset_epoch":
            last, epoch = 0, epoch + 1
            continue
        if d is None or not 1 <= len(d) <= G.ts_max_data:
            out.append((epoch, None, "PARAM" if d is None else "TOO_LARGE"))
            continue
        time = last + 1 if t in (None, 0, INVALID32) or t <= last else t
        if time > TIME_MAX:
            out.append((epoch, None, "TIME_EXHAUSTED"))
        else:
            out.append((epoch, time, "OK"))
            last = time
    return out


def repaired(spark, rows, chunk):
    got = ts.repair(ts.epochs(ops(spark, rows), chunk), chunk=chunk).orderBy("arrival").collect()
    return [(r["epoch"], r["time"], r["status"]) for r in got]


@pytest.mark.parametrize("asked,want", [([5, 5, 3, 0, 9, INVALID32], [5, 6, 7, 8, 9, 10]), ([TIME_MAX - 1, 1, 1], [TIME_MAX - 1, TIME_MAX, None])])
def test_repair_examples(spark, asked, want):
    assert [t for _, t, _ in repaired(spark, [("append", t, b"x") for t in asked], 2)] == want


def test_repair_and_epochs_equal_the_model(spark):
    rng = random.Random(3)
    rows = [("reset_epoch", None, None) if rng.random() < 0.05 else ("append", rng.choice([0, None, INVALID32, rng.randrange(1, 60), rng.randrange(1, 400)]), rng.choice([b"abc", b"", None, b"x" * 9])) for _ in range(300)]
    for chunk in (7, 1 << 16):
        assert repaired(spark, rows, chunk) == model(rows)


def packed(sizes, cap, sector, fill):
    out = []
    for z in sizes:
        if fill + z > cap:
            sector, fill = sector + 1, 0
        out.append((sector, fill))
        fill += z
    return out, sector, fill


@given(st.lists(st.lists(st.integers(1, 20), min_size=1, max_size=30), min_size=1, max_size=4), st.integers(20, 60))
@settings(max_examples=60, deadline=None)
def test_composed_steps_equal_a_fold(runs, cap):
    import numpy as np

    from siltstone.operators import packing

    whole = None
    for sizes in runs:
        one = packing.steps_of(np.array(sizes), cap)
        whole = one if whole is None else whole.then(one)
    opened, level = packing.Steps.unpack(whole.pack())(np.arange(cap + 1))
    for fill in range(cap + 1):
        assert packed(sum(runs, []), cap, 0, fill)[1:] == (opened[fill], level[fill])
        sector, offset = packing.place_from(np.array(runs[0]), cap, 3, fill)
        assert list(zip(sector, offset)) == packed(runs[0], cap, 3, fill)[0]


def test_next_fit_by_chunks_equals_a_fold(spark):
    rng = random.Random(4)
    rows = [("append", 0, bytes(rng.randrange(1, 900))) for _ in range(200)]
    log = ts.repair(ops(spark, rows))
    want, sector, fill = [], 0, 0
    for _, _, d in rows:
        size = 12 + len(d)
        if fill + size > G.ts_cap:
            sector, fill = sector + 1, 0
        want.append((sector, 20 + fill))
        fill += size
    for chunk in (16, 1 << 16):
        got = ts.pack_next_fit(log, chunk=chunk).orderBy("arrival").collect()
        assert [(r["sector"], r["offset"]) for r in got] == want


def test_epochs_and_positional_reads(spark):
    rows = [("append", 1000, b"a"), ("reset_epoch", None, None), ("append", 10, b"b")]
    log = ts.pack_next_fit(ts.repair(ts.epochs(ops(spark, rows))))
    assert [r["time"] for r in ts.time_range(log, 1, 100).collect()] == [10]
    assert ts.latest(log).first()["time"] == 10 and ts.oldest(log).first()["time"] == 1000
    assert ts.span(log).select("oldest", "newest").first() == (1000, 10)
    assert {r["arrival"]: r["sector"] for r in log.collect()} == {0: 0, 2: 1}


def test_ring_drops_whole_sectors(spark):
    log = ts.pack_fixed(ops(spark, [("append", 0, b"x" * 8)] * 1000), 8)
    assert ts.retain(log, 2).count() == 1000 - 203 * 3
    assert ts.lost(log, 2).select("rotations", "records_lost").first() == (4, 609)


def test_range_bounds(spark):
    log = ts.repair(ops(spark, [("append", t, b"x") for t in range(1, 11)]))
    assert ts.time_range(log, 3, 0).count() == 8 and ts.time_range(log, 5, 4).count() == 0 and ts.time_range(log, 2, 2).count() == 1


def test_empty(spark):
    none = ts.repair(ops(spark, []))
    assert none.count() == 0 and ts.pack_next_fit(none).count() == 0 and ts.latest(ts.pack_next_fit(none)).count() == 0


@pytest.mark.parametrize("sizes,per_sector", [((8, 20), 203), ((128, 140), 29), ((1023, 1035), 3), ((2032, 2044), 1), ((4064, 4076), 1)])
def test_capacity(spark, sizes, per_sector):
    log = ts.pack_fixed(ops(spark, [("append", 0, bytes(sizes[0]))] * (per_sector + 1)), sizes[0])
    assert {r["sector"] for r in log.collect()} == {0, 1} and log.first()["record_size"] == sizes[1]
