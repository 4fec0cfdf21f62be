import json
import struct

import pytest

from siltstone.functions.scalar import crc16_bytes
from siltstone.operators import kv, ts
from siltstone.sources import dump, vectors
from siltstone.streaming import stateful

KV_HASH = {b"wifi": 0x6360, b"mode": 0x0C7C, b"count": 0xE445}


def kv_record(key, value, seq, state, crc=None):
    return struct.pack("<BBBBHHIHH", 0xA5, state, len(key), 0xFF, len(value), KV_HASH.get(key, 0), seq, crc16_bytes(key + value) if crc is None else crc, 0xFFFF) + key + value


def kv_image(extra=b"", sectors=8):
    head = struct.pack("<IH", 0x4B564442, 2), struct.pack("<II", 1, 2)
    crc = crc16_bytes(head[1], crc16_bytes(head[0]))
    first = head[0] + struct.pack("<H", crc) + head[1]
    first += kv_record(b"wifi", b"lab-net", 3, 0xFC) + kv_record(b"mode", b"normal", 4, 0xFC) + kv_record(b"mode", b"service", 5, 0xFE) + kv_record(b"count", b"\x01\x02\x03\x04", 6, 0xFE) + extra
    return first.ljust(4096, b"\xff") + b"\xff" * 4096 * (sectors - 1), crc


def ts_image():
    body = struct.pack("<IIIHHHH", 0x54534442, 1, 1000, 1, 0xFFFF, 0xFFFF, 0xFFFF)
    for i in range(24):
        data = bytes([i, i, 0xA0 + i, 0x55, 0])
        body += struct.pack("<BBHIHH", 0xB6, 0xFE, 5, i, crc16_bytes(data), 0xFFFF) + data
    return body.ljust(4096, b"\xff") + b"\xff" * 4096 * 7


def opened(spark, tmp_path, raw, **options):
    path = tmp_path / "image.bin"
    path.write_bytes(raw)
    return dump.open_image(spark, dump.Image(str(path), **options))


def test_key_value_image(spark, tmp_path):
    raw, crc = kv_image()
    d = opened(spark, tmp_path, raw)
    assert d.kind == "kvdb" and crc == 0x94C0
    assert d.summary.first().asDict() == {"kind": "kvdb", "sectors": 8, "records": 4, "valid_current": 2, "anomalies": 0}
    assert d.observable.count() == 13
    records = [(r["offset"], r["seq"], r["state_name"], r["key"], r["value_hex"], r["data_crc"], r["record_size"]) for r in d.records.orderBy("offset").collect()]
    assert records == [(16, 3, "DEAD", "wifi", "6c61622d6e6574", 0x593E, 27), (43, 4, "DEAD", "mode", "6e6f726d616c", 0xF346, 26), (69, 5, "VALID", "mode", "73657276696365", 0xA4FD, 27), (96, 6, "VALID", "count", "01020304", 0x27CD, 25)]
    assert [(r["key"], r["seq"]) for r in d.valid.collect()] == [("count", 6), ("mode", 5)]
    assert d.rows.where("type = 'erased_tail'").select("offset", "length").first() == (121, 3975)
    assert d.rows.where("type = 'sector_header' AND sector = 0").first()["hdr_crc_ok"] is True
    assert dump.verify(d, strict=True) == "OK"


def test_time_series_image(spark, tmp_path):
    d = opened(spark, tmp_path, ts_image())
    assert d.summary.first().asDict() == {"kind": "tsdb", "sectors": 8, "records": 24, "valid_records": 24, "anomalies": 0}
    assert d.observable.count() == 33 and [r["time"] for r in d.valid.collect()] == list(range(1000, 1024))
    assert d.rows.where("type = 'erased_tail'").select("offset", "length").first() == (428, 3668)


def test_anomalies(spark, tmp_path):
    raw, _ = kv_image(kv_record(b"bad", b"v", 7, 0xFE, crc=1) + b"\x00" * 16 + kv_record(b"far", b"", 8, 0xFE)[:4] + struct.pack("<HHIHH", 5000, 0, 8, 0, 0))
    raw = raw[:4096] + b"\x00" * 4096 + raw[8192:-100]
    d = opened(spark, tmp_path, raw, total_size=8 * 4096)
    found = sorted((r["severity"], r["message"], r["sector"]) for r in d.anomalies.collect())
    assert found == [("error", "KVDB VALID record CRC mismatch", 0), ("error", "short sector", 7), ("warn", "KVDB record exceeds sector", 0), ("warn", "invalid KVDB record header", 0), ("warn", "invalid KVDB sector header", 1)]
    assert dump.verify(d) == "FAILED" and [r["key"] for r in d.valid.collect()] == ["count", "mode"]


def test_manifest_and_unknown(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"kind": "auto", "input": "image.bin", "sector_size": "0x1000"}))
    (tmp_path / "image.bin").write_bytes(ts_image())
    image = dump.from_manifest(spark, str(tmp_path / "m.json"), write_gran=1)
    assert image.path == str(tmp_path / "image.bin") and image.sector_size == 4096 and image.write_gran == 1
    assert dump.detect(spark, image) == "tsdb"
    (tmp_path / "image.bin").write_bytes(b"\xff" * 8192)
    with pytest.raises(ValueError):
        dump.detect(spark, image)


def test_export(spark, tmp_path):
    out = str(tmp_path / "out")
    dump.export(opened(spark, tmp_path, kv_image()[0]), out)
    assert spark.read.json(f"{out}/summary.json").first()["records"] == 4
    assert spark.read.csv(f"{out}/kv_records.csv", header=True).count() == 4 and spark.read.json(f"{out}/kv_current.json").count() == 2


def test_replay_files(spark, tmp_path):
    entries = struct.pack("<BBH", 1, 1, 2) + b"kvv" + struct.pack("<BBH", 2, 1, 0) + b"k" + struct.pack("<BBH", 1, 1, 1) + b"zv"
    (tmp_path / "kv.bin").write_bytes(struct.pack("<IHHI", 0x54424452, 1, 1, 3) + entries)
    log = vectors.read(spark, str(tmp_path / "kv.bin"), 1)
    assert [bytes(r["key"]) for r in kv.current(log).collect()] == [b"z"]
    (tmp_path / "ts.bin").write_bytes(struct.pack("<IHHI", 0x54424452, 1, 2, 2) + struct.pack("<IH", 5, 1) + b"a" + struct.pack("<IH", 5, 1) + b"b")
    assert [r["time"] for r in ts.repair(vectors.read(spark, str(tmp_path / "ts.bin"), 2)).orderBy("arrival").collect()] == [5, 6]
    with pytest.raises(ValueError):
        vectors.header(b"\x00" * 12)


def test_streams_equal_batches(spark, tmp_path):
    rows = [("s%d" % (k % 3), k, "reset_epoch" if k % 41 == 40 else "append", (k * 7) % 90, bytearray(b"x" * (1 + k % 300))) for k in range(240)]
    df = spark.createDataFrame(rows, "series string, arrival long, op string, req_time long, data binary")
    for part in range(3):
        df.where(f"arrival div 80 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful.stamp(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["series"], r["arrival"]): (r["epoch"], r["time"], r["sector"], r["offset"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    log = ts.pack_next_fit(ts.repair(ts.epochs(df)))
    assert got == {(r["series"], r["arrival"]): (r["epoch"], r["time"], r["sector"], r["offset"]) for r in log.collect()}


def test_streamed_upserts(spark, tmp_path):
    rows = [("s", k, "delete" if k % 5 == 4 else "set", bytearray(b"k%d" % (k % 7)), bytearray(b"%d" % k)) for k in range(60)]
    df = spark.createDataFrame(rows, "series string, seq long, op string, key binary, value binary")
    for part in range(3):
        df.where(f"seq div 20 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stateful.upsert(stream, str(tmp_path / "table"), str(tmp_path / "c2")).awaitTermination()
    now = stateful.read_current(df, str(tmp_path / "table"))
    assert {bytes(r["key"]): r["seq"] for r in now.collect()} == {bytes(r["key"]): r["seq"] for r in kv.current(df).collect()}


def test_faults_are_seen(spark, tmp_path):
    from siltstone.sources import layout

    raw, _ = kv_image()
    hurt = layout.flipped(raw, 69 + 16 + 4, 1, 0x20)  # a byte of the value of the record at 69
    d = opened(spark, tmp_path, hurt)
    assert [(r["message"], r["offset"]) for r in d.anomalies.collect()] == [("KVDB VALID record CRC mismatch", 69)] and dump.verify(d) == "FAILED"
    whole = kv_record(b"wifi", b"new", 7, 0xFF)
    cut = layout.cut_write(raw, 121, whole, 18)
    assert cut[121:139] == whole[:18] and cut[139] == 0xFF
    with pytest.raises(ValueError):
        layout.programmed(raw, 16, b"\xff")
    assert layout.programmed(raw, 17, b"\xfc")[17] == 0xFC


def test_a_made_sector_reads_back(spark, tmp_path):
    from siltstone.sources import layout

    made = layout.kv_sector(4, 9, [(254, b"key", b"value", 7, 11, 0), (252, b"k", b"", 8, 12, 0)], 4096, 4)
    d = opened(spark, tmp_path, made, write_gran=2)
    assert [(r["key"], r["seq"], r["state_name"], r["record_size"], r["crc_ok"]) for r in d.records.orderBy("offset").collect()] == [("key", 11, "VALID", 28, True), ("k", 12, "DEAD", 20, True)]
    head = d.rows.where("type = 'sector_header'").first()
    assert head["hdr_crc_ok"] and (head["erase_cnt"], head["create_seq"]) == (4, 9)
    with pytest.raises(ValueError):
        dump.checked_size(spark, dump.Image(str(tmp_path / "image.bin")), 8192)


def test_an_image_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "image.bin").write_bytes(ts_image() * 8)
    cut = dump.sectors(spark, dump.Image(str(tmp_path / "image.bin")))
    assert cut.count() == 64 and cut.rdd.getNumPartitions() > 1 and all(len(r["raw"]) == 4096 for r in cut.collect())


def test_an_image_in_pieces(spark, tmp_path, monkeypatch):
    from siltstone.sources import pieces

    monkeypatch.setattr(pieces, "PIECE", 3 * 4096)
    raw = kv_image(kv_record(b"bad", b"v", 7, 0xFE, crc=1))[0][: 7 * 4096] + kv_image()[0][:4096]
    cut = spark.createDataFrame([(k, bytearray(raw[k * 4096 : (k + 1) * 4096])) for k in range(8)], "sector int, raw binary").repartition(4)
    dump.save(cut, str(tmp_path / "image"))
    names = sorted(p.name for p in (tmp_path / "image").iterdir() if p.name[0] not in "._")
    assert len(names) == 3 and b"".join((tmp_path / "image" / n).read_bytes() for n in names) == raw
    (tmp_path / "one.bin").write_bytes(raw)
    one, many = (dump.Image(str(tmp_path / n)) for n in ("one.bin", "image"))
    for total in (None, 5 * 4096, 10 * 4096):
        views = [dump.parse(dump.sectors(spark, dump.replace(i, total_size=total)), "kvdb") for i in (one, many)]
        assert views[0].exceptAll(views[1]).isEmpty() and views[1].exceptAll(views[0]).isEmpty() and views[1].select("sector").distinct().count() == (total or len(raw)) // 4096
    assert dump.checked_size(spark, many, len(raw)) == many and dump.open_image(spark, many).summary.first() == ("kvdb", 8, 9, 2, 1)


def test_an_empty_image_is_a_file(spark, tmp_path):
    dump.save(spark.createDataFrame([], "sector int, raw binary"), str(tmp_path / "image"))
    assert dump.total_size(spark, str(tmp_path / "image")) == 0 and dump.sectors(spark, dump.Image(str(tmp_path / "image"))).count() == 0


def test_pieces_where_arrow_has_no_file_system(spark, tmp_path, monkeypatch):
    from siltstone.sources import pieces

    monkeypatch.setattr(pieces, "_arrow", lambda where: None)
    dump.save(spark.createDataFrame([(0, bytearray(kv_image()[0]))], "sector int, raw binary"), str(tmp_path / "image"))
    assert dump.total_size(spark, str(tmp_path / "image")) == 8 * 4096


def test_a_log_in_several_replay_files(spark, tmp_path):
    rows = [("s", 5 * k, ("set", "delete")[k % 3 == 2], bytearray(b"k%d" % (k % 7)), None if k % 3 == 2 else bytearray(b"v%d" % k)) for k in range(1, 90)]
    vectors.write(spark.createDataFrame(rows, "series string, seq long, op string, key binary, value binary").repartition(5), str(tmp_path / "log"), 1)
    files = [p for p in (tmp_path / "log").iterdir() if p.name[0] not in "._"]
    assert len(files) > 1 and sum(vectors.header(p.read_bytes())[1] for p in files) == 89
    back = vectors.read(spark, str(tmp_path / "log"), 1, whole=True).orderBy("seq").collect()
    assert [(r["seq"], r["op"], r["key"], r["value"]) for r in back] == [(k, op, key, value) for k, (_, _, op, key, value) in enumerate(rows)]
    assert {r["series"] for r in back} == {str(tmp_path / "log")} and vectors.read(spark, str(tmp_path / "log"), 1).select("series").distinct().count() == len(files)


def test_an_export_parses_the_image_once(spark, tmp_path):
    d = opened(spark, tmp_path, kv_image()[0])
    made = spark.sparkContext.accumulator(0)

    def counted(frames):
        for pdf in frames:
            made.add(len(pdf))
            yield pdf

    rows = d.rows.count()
    dump.export(dump.Dump(d.kind, d.rows.mapInPandas(counted, d.rows.schema)), str(tmp_path / "out"))
    assert made.value == rows and not (tmp_path / "out" / "_rows").exists()
    assert spark.read.json(str(tmp_path / "out/observable_dataset.json")).count() == 13 and spark.read.csv(str(tmp_path / "out/valid_dataset.csv"), header=True).columns == ["key", "value_hex", "value_len", "seq", "sector", "offset"]
