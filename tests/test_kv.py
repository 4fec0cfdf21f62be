import random

import pytest

from siltstone.operators import gc, kv, recover
from siltstone.schema import G16, Geometry


def ops(spark, rows):
    return spark.createDataFrame([("s", k, op, bytearray(key), None if v is None else bytearray(v)) for k, (op, key, v) in enumerate(rows)], "series string, seq long, op string, key binary, value binary")


def test_current_equals_a_dictionary(spark):
    rng, rows, state = random.Random(1), [], {}
    for _ in range(500):
        key = b"k%d" % rng.randrange(40)
        if rng.random() < 0.2:
            rows.append(("delete", key, None))
            state.pop(key, None)
        else:
            value = bytes(rng.randrange(0, 9))
            rows.append(("set", key, value))
            state[key] = value
    log = ops(spark, rows)
    assert {bytes(r["key"]): bytes(r["value"]) for r in kv.current(log).collect()} == state
    assert {bytes(r["key"]): bytes(r["value"]) for r in kv.current(gc.compact(log)).collect()} == state
    assert kv.versions(log).where("live").count() == len(state)


def test_reads(spark):
    now = kv.current(ops(spark, [("set", b"big", b"12345678"), ("set", b"empty", b""), ("set", b"gone", b"x"), ("delete", b"gone", None), ("set", b"samepref00009d", b"1"), ("set", b"samepref000190", b"2")]))
    one = lambda k, c=None: kv.get(now, k, c).select("status", "value", "value_len").first()
    assert one(b"big", 4) == ("TOO_LARGE", bytearray(b"1234"), 8)
    assert one(b"empty") == ("OK", bytearray(b""), 0)
    assert one(b"gone")["status"] == "NOT_FOUND"
    assert one(b"")["status"] == "TOO_LARGE" and one(b"k" * 33)["status"] == "TOO_LARGE" and one(b"k" * 34)["status"] == "PARAM"
    assert bytes(one(b"samepref00009d")["value"]) + bytes(one(b"samepref000190")["value"]) == b"12"


@pytest.mark.parametrize("key,value,status", [(32, 10, "OK"), (33, 1, "TOO_LARGE"), (34, 1, "PARAM"), (2, 4062, "OK"), (2, 4063, "TOO_LARGE"), (2, 4096, "TOO_LARGE"), (2, 0, "OK")])
def test_limits(spark, key, value, status):
    assert kv.validated(ops(spark, [("set", b"k" * key, bytes(value))])).first()["status"] == status


def test_space_and_admission(spark):
    rows = [("set", b"key%02d" % k, bytes(64)) for k in range(50)] + [("delete", b"key%02d" % k, None) for k in range(25)]
    row = kv.space(kv.validated(kv.current(ops(spark, rows)))).first()
    assert row == (57120, 25 * (16 + 5 + 64), 57120 - 25 * 85)
    tiny = Geometry(sectors=3)
    full = [("set", b"a", bytes(4000)), ("set", b"b", bytes(4000)), ("set", b"c", bytes(4000)), ("delete", b"a", None), ("set", b"c", bytes(4000)), ("delete", b"x", None)]
    assert [r["status"] for r in kv.admit(ops(spark, full), tiny).orderBy("seq").collect()] == ["OK", "OK", "FULL", "OK", "OK", "NOT_FOUND"]


SECTORS = [(0, "ACTIVE", 4096, 1000, 5), (1, "SEALED", 4096, 4080, 9), (2, "SEALED", 4000, 1200, 3), (3, "SEALED", 4096, 300, 20), (4, "ERASED", 16, 0, 7), (5, "ERASED", 16, 0, 7), (6, "SEALED", 4096, 0, 1)]


def sectors(spark, rows=SECTORS):
    return spark.createDataFrame(rows, "sector int, status string, write_off long, garbage_bytes long, erase_cnt long")


def test_victim_scores(spark):
    g = Geometry(sectors=8)
    c = gc.candidates(sectors(spark), 0, g)
    got = {r["sector"]: (r["live"], r["gpct"], r["wpct"], r["cpct"], r["score"]) for r in c.where("mine").collect()}
    assert got[1] == (0, 100, 42, 100, 926) and got[2] == (2784, 30, 10, 32, 272) and got[3] == (3780, 7, 100, 8, 357)
    assert [r["sector"] for r in gc.zero_live(c).collect()] == [1]
    assert sorted(r["sector"] for r in gc.scored(c).collect()) == [1, 2]
    assert sorted(r["sector"] for r in gc.forced(c).collect()) == [1, 2, 3]
    assert gc.wear_level(c).count() == 0
    assert gc.victim(sectors(spark), 0, g).first() == (1, 1)
    assert gc.next_sector(sectors(spark)).first()["sector"] == 4 and gc.needed(sectors(spark), g).first()["needed"] is False


def test_wear_levelling_comes_last(spark):
    rows = [(0, "ACTIVE", 100, 0, 5), (1, "SEALED", 4096, 0, 1), (2, "SEALED", 4096, 0, 120), (3, "ERASED", 16, 0, 7), (4, "ERASED", 16, 0, 2)]
    assert gc.victim(sectors(spark, rows), 0).first() == (4, 1)


def test_recovery_settles_and_is_idempotent(spark):
    rows = [(0, 16, 254, True, 0xFFFFFFFE, b"wrap"), (0, 40, 254, True, 0, b"wrap"), (0, 70, 255, True, 1, b"cut"), (0, 90, 255, False, 2, b"torn"), (1, 16, 252, True, 3, b"dead")]
    log = spark.createDataFrame([(s, o, st, ok, q, bytearray(k), 20) for s, o, st, ok, q, k in rows], "sector int, offset long, state int, crc_ok boolean, seq long, key binary, record_size int")
    once = recover.kv_recover(log)
    state = {r["offset"] + 4096 * r["sector"]: r["state"] for r in once.collect()}
    assert state == {16: 252, 40: 254, 70: 254, 90: 252, 4112: 252}
    assert {r["offset"] + 4096 * r["sector"]: r["state"] for r in recover.kv_recover(once).collect()} == state
    totals = {r["sector"]: (r["live_bytes"], r["garbage_bytes"]) for r in recover.kv_sectors(once).collect()}
    assert totals == {0: (40, 40), 1: (0, 20)}


def test_ts_recovery_orders_the_ring(spark):
    sectors_ = spark.createDataFrame([(0, "ACTIVE", 1, 100), (1, "SEALED", 0xFFFF, 50), (2, "SEALED", 0, 70), (3, "CORRUPT", 9, 9)], "sector int, status string, seq long, time_base long")
    log = spark.createDataFrame([(s, 20, 255, True, 1, 0, 0) for s in range(4)], "sector int, offset long, state int, crc_ok boolean, time_delta long, time_base long, time long")
    got = {r["sector"]: (r["ring_pos"], r["state"], r["time"]) for r in recover.ts_recover(log, sectors_).collect()}
    assert got == {1: (0, 255, 51), 2: (1, 255, 71), 0: (2, 254, 101)}


def test_wear_and_geometry(spark):
    assert kv.wear(sectors(spark)).first() == (1, 20, 7, 19)
    assert (G16.kv_cap, G16.gc_reserve, G16.kv_max_live, G16.ts_cap, G16.ts_max_data) == (4080, 2, 57120, 4076, 4064)
    with pytest.raises(ValueError):
        Geometry(sector_size=65536).check_ts()
    with pytest.raises(ValueError):
        Geometry(sectors=2).check_kv()


def test_two_stores_stay_apart(spark):
    rows = [("a", 1, "set", bytearray(b"k"), bytearray(b"1")), ("b", 2, "set", bytearray(b"k"), bytearray(b"2")), ("b", 3, "set", bytearray(b"j"), bytearray(b"3"))]
    now = kv.current(spark.createDataFrame(rows, "series string, seq long, op string, key binary, value binary"))
    keys = spark.createDataFrame([("a", bytearray(b"k")), ("a", bytearray(b"j")), ("b", bytearray(b"k"))], "series string, key binary")
    assert sorted((r["series"], r["status"], bytes(r["value"] or b"")) for r in kv.multi_get(now, keys).collect()) == [("a", "NOT_FOUND", b""), ("a", "OK", b"1"), ("b", "OK", b"2")]
    assert kv.exists(now, keys).count() == 2 and kv.get(now.where("series = 'b'"), b"k").count() == 1


def test_records_never_cross_a_sector(spark):
    rng = random.Random(7)
    log = ops(spark, [("set", b"k%d" % (k % 9), bytes(rng.randrange(0, 3000))) for k in range(120)])
    at = 0
    for r in kv.place(log, chunk=16).orderBy("sector", "offset").collect():
        assert r["offset"] + r["record_size"] <= 4096 and r["seq"] == at
        at += 1


def test_an_iterator_notices_changes(spark):
    log = ops(spark, [("set", b"k%d" % k, b"v") for k in range(4)])
    placed = kv.place(log)
    noted = kv.generation(log).first()["generation"]
    assert kv.next_page(log, placed, noted, None, 3)[0] == "OK" and kv.next_page(log, placed, noted, (0, 4000), 3)[0] == "ITER_END"
    assert kv.next_page(log.union(log.limit(1)), placed, noted, None, 3)[0] == "BUSY"


def test_collection_keeps_what_is_visible(spark):
    rng = random.Random(3)
    rows = [("set", b"k%02d" % rng.randrange(60), bytes(rng.randrange(50, 900))) for _ in range(90)]
    log = ops(spark, rows)
    laid = kv.place(log).join(kv.versions(log).select("series", "seq", "live"), ["series", "seq"]).selectExpr("series", "cast(sector AS int) AS sector", "offset", "seq", "key", "live", "seq <> 70 AS crc_ok", "record_size")
    tops = {}
    for r in laid.collect():
        tops[r["sector"]] = max(tops.get(r["sector"], 0), r["offset"] + r["record_size"])
    used = len(tops)
    sectors_ = spark.createDataFrame([("s", k, "ACTIVE" if k == used - 1 else "SEALED", int(w), 5 + k) for k, w in tops.items()] + [("s", used, "ERASED", 16, 1)], "series string, sector int, status string, write_off long, erase_cnt long")
    got = gc.ensure_space(laid, sectors_, Geometry(sectors=16)).collect()
    want = {(bytes(r["key"]), r["seq"]) for r in laid.where("live AND crc_ok").collect()}
    records = [r for r in got if r["type"] == "record"]
    assert {(bytes(r["key"]), r["old_seq"]) for r in records} == want and len({(r["sector"], r["offset"]) for r in records}) == len(want)
    after = {r["sector"]: r for r in got if r["type"] == "sector"}
    stats = next(r for r in got if r["type"] == "stats")
    erased = sum(r["status"] == "ERASED" for r in after.values())
    assert stats["gc_runs"] >= 1 and stats["gc_reclaimed_bytes"] == 4080 * stats["gc_runs"] and sum(r["status"] == "ACTIVE" for r in after.values()) == 1
    assert erased >= 1 and stats["gc_migrated_recs"] == sum(r["seq"] != r["old_seq"] for r in records)
    assert sum(r["erase_cnt"] for r in after.values()) == sum(5 + k for k in tops) + 1 + stats["gc_runs"]
    assert all(r["sector"] in after and after[r["sector"]]["status"] != "ERASED" for r in records)


def test_counters_start_anew_after_a_reset(spark):
    from siltstone.operators import metrics

    rows = [("a", 1, "write_ops", 1), ("a", 2, "reset", 1), ("a", 3, "write_ops", 1), ("a", 4, "gc_reclaimed_bytes", 4080), ("b", 1, "read_ops", 1), ("c", 1, "reset", 1)]
    got = {r["series"]: r for r in metrics.counters(spark.createDataFrame(rows, "series string, at long, counter string, amount long"), metrics.KV_COUNTERS).collect()}
    assert (got["a"]["write_ops"], got["a"]["gc_reclaimed_bytes"], got["b"]["read_ops"], got["c"]["write_ops"]) == (1, 4080, 1, 0)


def test_many_collections_equal_a_plain_model(spark):
    """250 nearly full sectors: each collection wins two records' room, and what it costs follows the sector, not the store."""
    import time

    size, per, n = 40, 102, 250
    rows = [("s", s, 16 + size * k, s * per + k, bytearray(b"%d" % (s * per + k)), (s * per + k) % 51 != 7, (s * per + k) % 997 != 0, size) for s in range(n) for k in range(per)]
    heads = [("s", s, "ACTIVE" if s == n - 1 else "SEALED", 16 + size * per, s * 37 % 90) for s in range(n)] + [("s", n, "ERASED", 16, 50)]
    log = spark.createDataFrame(rows, "series string, sector int, offset long, seq long, key binary, live boolean, crc_ok boolean, record_size int")
    done = gc.ensure_space(log, spark.createDataFrame(heads, "series string, sector int, status string, write_off long, erase_cnt long"), Geometry(sectors=16))
    done.count()  # compiles code and starts Python workers
    began = time.perf_counter()
    got = done.collect()
    took = time.perf_counter() - began

    at = {s: [(q, q, ok) for _, sec, _, q, _, live, ok, _ in rows[s * per : (s + 1) * per] if live] for s in range(n)} | {n: []}
    dead = {s: sum(not r[5] for r in rows[s * per : (s + 1) * per]) for s in range(n)} | {n: 0}
    state, wear, fill, active, top, runs = {s: h[2] for s, h in enumerate(heads)}, {s: h[4] for s, h in enumerate(heads)}, {s: (h[3] - 16) // size for s, h in enumerate(heads)}, n - 1, n * per - 1, 0
    while (free := [s for s in state if state[s] == "ERASED"]) and len(free) < 3:
        mine = [s for s in state if s != active and state[s] != "ERASED"]
        used = [wear[s] for s in state if state[s] != "ERASED"]
        live = {s: (fill[s] - dead[s]) * size for s in mine}
        room, limit = 4080 - fill[active] * size + 4080 * len(free), 1 if len(free) < 2 else 5
        fit = [s for s in mine if dead[s] and live[s] <= room]
        share = {s: dead[s] * size * 100 // (fill[s] * size) for s in fit}
        score = {s: 7 * share[s] + 3 * ((wear[s] - min(used)) * 100 // max(1, max(used) - min(used))) + 100 - min(100, live[s] * 100 // 4080) for s in fit}
        phases = [[(wear[s], s) for s in mine if dead[s] and not live[s]], [(-score[s], s) for s in fit if share[s] >= limit], [(-dead[s], s) for s in fit]]
        if (victim := next((min(p)[1] for p in phases if p), None)) is None:
            break
        runs += 1
        for _, old, ok in [r for r in at[victim] if r[2]]:
            if fill[active] == per:
                state[active] = "SEALED"
                active = min((wear[s], s) for s in state if state[s] == "ERASED")[1]
                state[active], fill[active] = "ACTIVE", 0
            top, fill[active] = top + 1, fill[active] + 1
            at[active].append((top, old, ok))
        at[victim], dead[victim], fill[victim], state[victim], wear[victim] = [], 0, 0, "ERASED", wear[victim] + 1
    assert runs > 20 and next(r["gc_runs"] for r in got if r["type"] == "stats") == runs
    assert {(r["sector"], r["seq"], r["old_seq"], bytes(r["key"])) for r in got if r["type"] == "record"} == {(s, q, old, b"%d" % old) for s in at for q, old, ok in at[s] if ok}
    assert {r["sector"]: (r["status"], r["write_off"], r["erase_cnt"]) for r in got if r["type"] == "sector"} == {s: (state[s], 16 + fill[s] * size, wear[s]) for s in state}
    assert took < 6, took
