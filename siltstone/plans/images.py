"""Registered queries over stored images and replay files, recovery, and compaction.

Images are made of `events`: the key-value log with damage on fixed places (every fiftieth checksum, the headers of sectors 9, 26, ...,
sixteen zero bytes after the records of sectors 3, 8, ... where they fit, two erased sectors at the end), and the time series with sealed
sectors, every fortieth checksum damaged and every ninety-seventh write cut off.  Each is written into the shared folder, in pieces, and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import gc, kv, metrics, recover, ts
from ..schema import CONSTANTS, G16, INVALID32, Geometry
from ..shared import new_path
from ..sources import dump, vectors
from ..sources.layout import kv_sector, ts_sector
from .catalogue import FROM, KV, LAID, OPS, PACK, _wanted, events, kv_laid, kv_ops, query, text, ts_log, ts_ops

# ---- building


def kv_image_sectors(spark, sf_dir) -> DataFrame:
    """(sector, raw) of the key-value image."""
    rows = kv_laid(spark, sf_dir).select("sector", "offset", "seq", "key", "value", "live", S.hash16(F.col("key")).alias("key_hash"))

    def build(n: int, rows: list[dict]) -> bytes:
        records = [(254 if r["live"] else 252, r["key"], r["value"], r["key_hash"], r["seq"], int(r["seq"] % 50 == 0)) for r in rows]
        used = 16 + sum(16 + len(k) + len(v) for _, k, v, *_ in records)
        raw = kv_sector((n * 37) % 113, n + 1, records, 4096, 1, b"\x00" * 16 if n % 5 == 3 and used + 32 <= 4096 else b"", [r["crc"] for r in rows])
        return b"\x00" * 4 + raw[4:] if n % 17 == 9 else raw

    blank = rows.agg(F.max("sector").cast("int").alias("m")).select(F.explode(F.array(F.col("m") + 1, F.col("m") + 2)).alias("sector"), F.lit(bytearray(b"\xff" * 4096)).alias("raw"))
    return dump.made(rows, ("key", "value"), build).unionByName(blank)


def ts_image_sectors(spark, sf_dir) -> DataFrame:
    """(sector, raw) of the time-series image: the last sector is still written on."""
    log = ts_log(spark, sf_dir).select("sector", "offset", "arrival", "time", "data")
    log = log.crossJoin(F.broadcast(log.agg(F.max("sector").alias("head"))))  # one row

    def build(n: int, rows: list[dict]) -> bytes:
        base = rows[0]["time"]
        records = [(255 if r["arrival"] % 97 == 0 else 254, r["time"] - base, r["data"], int(r["arrival"] % 40 == 0)) for r in rows]
        return ts_sector(n % 7, base, (n + 1) & 0xFFFF, records, 4096, 1, n < rows[0]["head"], [r["crc"] for r in rows])

    return dump.made(log, ("data",), build)


def kv_dump(spark, sf_dir) -> dump.Dump:
    dump.save(kv_image_sectors(spark, sf_dir), path := new_path(spark, "kv.bin"))
    return dump.open_image(spark, dump.Image(path))


def ts_dump(spark, sf_dir) -> dump.Dump:
    dump.save(ts_image_sectors(spark, sf_dir), path := new_path(spark, "ts.bin"))
    return dump.open_image(spark, dump.Image(path))


KVI = LAID + """, top AS (SELECT max(sector) AS m FROM laid), heads AS (SELECT unnest(range(0, (SELECT m + 3 FROM top))) AS sector),
 ends AS (SELECT h.sector, h.sector > t.m AS blank, h.sector % 17 = 9 AND h.sector <= t.m AS broken, coalesce(b.write_off, 16) AS used, h.sector % 5 = 3 AND coalesce(b.write_off, 16) + 32 <= 4096 AND h.sector <= t.m AS zeros FROM heads h CROSS JOIN top t LEFT JOIN bytes b ON b.sector = h.sector),
 recs AS (SELECT l.*, l.seq % 50 <> 0 AS ok FROM laid l WHERE sector % 17 <> 9),
 wrong AS (SELECT 'warn' AS severity, 'invalid KVDB sector header' AS message, sector::INT AS sector, NULL::BIGINT AS "offset" FROM ends WHERE broken
  UNION ALL SELECT 'warn', 'invalid KVDB record header', sector::INT, sector * 4096 + used FROM ends WHERE zeros AND NOT broken
  UNION ALL SELECT 'error', 'KVDB VALID record CRC mismatch', sector::INT, sector * 4096 + off FROM recs WHERE live AND NOT ok)"""
TSI = PACK + """, top AS (SELECT max(sector) AS m FROM log), base AS (SELECT sector, arg_min(time, off) AS b, count(*) AS n, max(off + size) AS e FROM log GROUP BY sector),
 recs AS (SELECT l.*, b.b, l.arrival % 97 <> 0 AS done, l.arrival % 40 <> 0 AS ok FROM log l JOIN base b USING (sector))"""


# ---- images


@query(f"WITH RECURSIVE {KVI} SELECT sector::INT AS sector, sector * 4096 + off AS \"offset\", seq, CASE WHEN live THEN 'VALID' ELSE 'DEAD' END AS state_name, key, strlen(value)::INT AS value_len, ok AS crc_ok, size::INT AS record_size, lower(hex(encode(value))) AS value_hex FROM recs")
def image_kv_records(spark, sf_dir):
    return kv_dump(spark, sf_dir).records.select("sector", "offset", "seq", "state_name", "key", "value_len", "crc_ok", "record_size", "value_hex")


@query(f"WITH RECURSIVE {KVI} SELECT sector::INT AS sector, CASE WHEN blank THEN 'ERASED' WHEN broken THEN 'CORRUPT' ELSE 'KVDB' END AS status, CASE WHEN blank THEN 4294967295 ELSE (sector * 37) % 113 END AS erase_cnt, CASE WHEN blank THEN 4294967295 ELSE sector + 1 END AS create_seq, NOT blank AND NOT broken AS hdr_crc_ok FROM ends")
def image_kv_headers(spark, sf_dir):
    return kv_dump(spark, sf_dir).rows.where("type = 'sector_header'").select("sector", "status", "erase_cnt", "create_seq", "hdr_crc_ok")


@query(f"WITH RECURSIVE {KVI} SELECT sector::INT AS sector, sector * 4096 + used + CASE WHEN zeros THEN 16 ELSE 0 END AS \"offset\", 4096 - used - CASE WHEN zeros THEN 16 ELSE 0 END AS length FROM ends WHERE NOT blank AND NOT broken AND used + CASE WHEN zeros THEN 16 ELSE 0 END + 16 <= 4096")
def image_kv_tails(spark, sf_dir):
    return kv_dump(spark, sf_dir).rows.where("type = 'erased_tail'").select("sector", "offset", "length")


@query(f"WITH RECURSIVE {KVI} SELECT * FROM wrong")
def image_kv_anomalies(spark, sf_dir):
    return kv_dump(spark, sf_dir).anomalies


@query(f"WITH RECURSIVE {KVI} SELECT key, seq, value, sector::INT AS sector, sector * 4096 + off AS \"offset\" FROM recs WHERE live AND ok")
def image_kv_current(spark, sf_dir):
    return kv_dump(spark, sf_dir).valid.select("key", "seq", F.decode(F.unhex("value_hex"), "utf-8").alias("value"), "sector", "offset")


@query(f"WITH RECURSIVE {KVI} SELECT 'kvdb' AS kind, (SELECT count(*) FROM ends) AS sectors, (SELECT count(*) FROM recs) AS records, (SELECT count(*) FROM recs WHERE live AND ok) AS valid_current, (SELECT count(*) FROM wrong) AS anomalies")
def image_kv_summary(spark, sf_dir):
    return kv_dump(spark, sf_dir).summary


@query(f"WITH RECURSIVE {KVI} SELECT CASE WHEN count(*) FILTER (severity = 'error') = 0 THEN 'OK' ELSE 'FAILED' END AS plain, CASE WHEN count(*) = 0 THEN 'OK' ELSE 'FAILED' END AS strict FROM wrong")
def image_kv_verify(spark, sf_dir):
    d = kv_dump(spark, sf_dir)
    return spark.createDataFrame([(dump.verify(d), dump.verify(d, strict=True))], "plain string, strict string")


@query(f"WITH RECURSIVE {KVI} SELECT 0::BIGINT AS tsdb, count(*) AS kvdb FROM ends WHERE NOT blank AND NOT broken")
def image_kind_votes(spark, sf_dir):
    return dump.kinds(kv_image_sectors(spark, sf_dir))


@query(f"WITH RECURSIVE {KVI} SELECT sector::INT AS sector, count(*) AS records, sum(size)::BIGINT AS bytes FROM recs GROUP BY 1")
def image_kv_engine_scan(spark, sf_dir):
    """The engine's own scan rule, records in every state."""
    rows = dump.parse(kv_image_sectors(spark, sf_dir), "kvdb", engine=True)
    return dump.engine_scan(rows, recover=True).groupBy("sector").agg(F.count(F.lit(1)).alias("records"), F.sum("record_size").alias("bytes"))


@query(f"WITH RECURSIVE {KVI}, n AS (SELECT count(*) AS r, count(*) FILTER (live AND ok) AS v FROM recs), t AS (SELECT count(*) AS t FROM ends WHERE NOT blank AND NOT broken AND used + CASE WHEN zeros THEN 16 ELSE 0 END + 16 <= 4096), h AS (SELECT count(*) AS h, count(*) FILTER (zeros AND NOT broken) AS z FROM ends) SELECT unnest(['summary.json', 'anomalies.json', 'observable_dataset.json', 'observable_dataset.csv', 'valid_dataset.json', 'valid_dataset.csv', 'kv_current.json', 'kv_records.csv']) AS name, unnest([1, (SELECT count(*) FROM wrong), r + t + h + z, r + t + h + z, v, v, v, r]) AS n FROM n, t, h")
def image_export(spark, sf_dir):
    """Every exported file, read back and counted."""
    dump.export(kv_dump(spark, sf_dir), out := new_path(spark, "export"))
    names = ["summary.json", "anomalies.json", "observable_dataset.json", "observable_dataset.csv", "valid_dataset.json", "valid_dataset.csv", "kv_current.json", "kv_records.csv"]
    counts = [(spark.read.json(f"{out}/{n}") if n.endswith("json") else spark.read.csv(f"{out}/{n}", header=True)).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n in names]
    whole = counts[0]
    for c in counts[1:]:
        whole = whole.unionByName(c)
    return whole


@query(f"WITH RECURSIVE {KVI}, s AS (SELECT count(*) * 4096 AS size FROM ends) SELECT size AS asked, 'OK' AS status FROM s UNION ALL SELECT size - 4096, 'PARAM' FROM s")
def image_exact_size(spark, sf_dir):
    """Loading into a partition of the image's size, and into a smaller one."""
    cut = kv_image_sectors(spark, sf_dir)
    dump.save(cut, path := new_path(spark, "kv.bin"))
    size, out = dump.total_size(spark, path), []
    for asked in (size, size - 4096):
        try:
            dump.checked_size(spark, dump.Image(path), asked)
            out.append((asked, "OK"))
        except ValueError:
            out.append((asked, "PARAM"))
    return spark.createDataFrame(out, "asked long, status string")


@query(f"WITH RECURSIVE {TSI} SELECT sector::INT AS sector, sector * 4096 + off AS \"offset\", time, time - b AS time_delta, CASE WHEN done THEN 'VALID' ELSE 'WRITING' END AS state_name, len::INT AS data_len, ok AS crc_ok, lower(hex(encode(props))) AS data_hex FROM recs")
def image_ts_records(spark, sf_dir):
    return ts_dump(spark, sf_dir).records.select("sector", "offset", "time", "time_delta", "state_name", "data_len", "crc_ok", "data_hex")


@query(f"WITH RECURSIVE {TSI} SELECT sector::INT AS sector, CASE WHEN sector < m THEN 'SEALED' ELSE 'ACTIVE' END AS status, b AS time_base, CASE WHEN sector < m THEN n ELSE 65535 END::INT AS count, CASE WHEN sector < m THEN e ELSE 65535 END::INT AS end_off, (sector + 1) & 65535 AS seq, sector < m AS hdr_crc_ok FROM base, top")
def image_ts_headers(spark, sf_dir):
    return ts_dump(spark, sf_dir).rows.where("type = 'sector_header'").select("sector", "status", "time_base", "count", "end_off", "seq", "hdr_crc_ok")


@query(f"WITH RECURSIVE {TSI} SELECT time, sector::INT AS sector, sector * 4096 + off AS \"offset\", props AS data FROM recs WHERE done AND ok")
def image_ts_valid(spark, sf_dir):
    return ts_dump(spark, sf_dir).valid.select("time", "sector", "offset", F.decode(F.unhex("data_hex"), "utf-8").alias("data"))


@query(f"WITH RECURSIVE {TSI} SELECT 'tsdb' AS kind, (SELECT m + 1 FROM top) AS sectors, count(*) AS records, count(*) FILTER (done AND ok) AS valid_records, count(*) FILTER (done AND NOT ok) AS anomalies FROM recs")
def image_ts_summary(spark, sf_dir):
    return ts_dump(spark, sf_dir).summary


@query(f"WITH RECURSIVE {TSI} SELECT sector * 4096 + off AS \"offset\", time FROM recs WHERE done ORDER BY 1 LIMIT 40")
def image_ts_scan_stop(spark, sf_dir):
    """A scan that passes over cut-off writes and stops after forty records."""
    return dump.engine_scan(ts_dump(spark, sf_dir).rows, most=40).select("offset", "time")


# ---- replay files


@query(f"WITH {KV} SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, op, key, CASE WHEN op = 'set' THEN value END AS value FROM kv")
def replay_kv(spark, sf_dir):
    """The operation log written as replay files and read back."""
    vectors.write(kv_ops(spark, sf_dir), path := new_path(spark, "kv.rdbt"), 1)
    return vectors.read(spark, path, 1, whole=True).select("seq", "op", text("key").alias("key"), text("value").alias("value"))


@query(f"WITH {OPS} SELECT row_number() OVER (ORDER BY arrival) - 1 AS arrival, req_time, props AS data FROM ops")
def replay_ts(spark, sf_dir):
    vectors.write(ts_ops(spark, sf_dir), path := new_path(spark, "ts.rdbt"), 2)
    return vectors.read(spark, path, 2, whole=True).select("arrival", "req_time", text("data").alias("data"))


# ---- functions over bytes

_HASH = "list_transform(range(strlen(s)), lambda i: ('0x' || substr(hex(encode(s)), (2 * i + 1)::INT, 2))::BIGINT)"
_FNV = f"list_reduce(list_concat([2166136261::BIGINT], {_HASH}), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"


@query(f"WITH RECURSIVE {LAID}, k AS (SELECT DISTINCT key AS s FROM laid UNION SELECT cast(c_custkey AS VARCHAR) FROM customer), f AS (SELECT s, {_FNV} AS h FROM k), g AS (SELECT s, xor(h, h >> 16) & 65535 AS h FROM f), bits AS (SELECT DISTINCT sector, unnest([h & 255, (h >> 8) & 255]) AS bit FROM laid JOIN g ON key = s), m AS (SELECT sector, list(bit) AS bits FROM bits GROUP BY sector) SELECT sector, len(bits)::INT AS n_bits, (SELECT count(*) FROM customer JOIN g ON cast(c_custkey AS VARCHAR) = s WHERE list_contains(bits, h & 255) AND list_contains(bits, (h >> 8) & 255)) AS maybe FROM m")
def fn_bloom(spark, sf_dir):
    """Each sector's filter: bits set, and for how many customer numbers it answers maybe."""
    filters = kv_laid(spark, sf_dir).select("sector", S.hash16(F.col("key")).alias("h")).groupBy("sector").agg(S.bloom_filter(F.col("h")).alias("bits"))
    # sectors never meet keys: keys are counted by their two bits, 65,536 pairs at most
    weights = S.bloom_weights(_wanted(spark, sf_dir).select(S.hash16(F.col("key")).alias("h")))
    return filters.select("sector", F.size("bits").alias("n_bits"), S.bloom_maybes(F.col("bits"), weights).alias("maybe"))


@query("WITH e AS (SELECT event_id, hex(encode(props)) AS x FROM events) SELECT event_id, ('0x' || substr(x, 3, 2) || substr(x, 1, 2))::BIGINT AS u16, ('0x' || substr(x, 9, 2) || substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2))::BIGINT AS u32 FROM e")
def fn_unpack(spark, sf_dir):
    data = F.encode("props", "utf-8")
    return events(spark, sf_dir).select("event_id", S.little_endian(data, 0, 2).alias("u16"), S.little_endian(data, 1, 4).alias("u32"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::BIGINT)" for k, v in (("MAX_KEY_LEN", 32), ("MAX_VAL_LEN", 4095), ("STATE_WRITING", 255), ("STATE_VALID", 254), ("STATE_DEAD", 252), ("TIME_INVALID", 4294967295), ("TIME_MAX", 4294967294), ("SEQ_INVALID", 4294967295), ("ADDR_INVALID", 4294967295), ("KV_SECTOR_MAGIC", 1263944770), ("KV_RECORD_MAGIC", 165), ("KV_VERSION", 2), ("TS_SECTOR_MAGIC", 1414743106), ("TS_RECORD_MAGIC", 182), ("MIN_SECTOR_SIZE", 4096), ("MAX_SECTORS", 255), ("KV_MIN_SECTORS", 3), ("TS_MIN_SECTORS", 2), ("WRITE_GRAN_MAX", 3), ("GC_GARBAGE_PCT", 20), ("GC_WEAR_THRESHOLD", 100), ("GC_W_GARBAGE", 7), ("GC_W_WEAR", 3), ("GC_W_CAPACITY", 1), ("STACK_BUF_SIZE", 64))) + ") AS t(name, value)")
def fn_constants(spark, sf_dir):
    return spark.createDataFrame(list(CONSTANTS.items()), "name string, value long")


# ---- recovery, formatting, counters

_SEC = "s AS (SELECT DISTINCT (event_id // 100)::INT AS sector FROM events WHERE event_id < 25000)"


def _made_sectors(spark, sf_dir) -> DataFrame:
    """Up to 250 sectors, one for each hundred of the first events' numbers: a partition has no more."""
    return events(spark, sf_dir).where("event_id < 25000").select(F.expr("cast(event_id div 100 AS int)").alias("sector")).distinct()


def _in(df: DataFrame, name: str, n: int, k: int):
    return F.pmod(F.col(name), F.lit(n)) == k


@query(f"WITH {_SEC} SELECT sector, CASE WHEN sector % 9 = 4 THEN 'EMPTY' WHEN sector % 11 = 5 THEN 'CORRUPT' WHEN sector % 5 <> 1 AND sector % 7 <> 2 THEN 'SEALED' ELSE 'ACTIVE' END AS status FROM s")
def ts_classify(spark, sf_dir):
    """Sectors erased, with a bad mark, sealed, with a bad seal, or open."""
    s = _made_sectors(spark, sf_dir)
    is_ = lambda n, k: _in(s, "sector", n, k)
    status = recover.ts_status(~is_(11, 5), is_(9, 4), ~is_(7, 2), F.when(is_(5, 1), 0xFFFF).otherwise(100), F.when(is_(5, 1), 0xFFFF).otherwise(2000))
    return s.select("sector", status.alias("status"))


_START = f"""WITH {_SEC}, h AS (SELECT sector, sector % 9 = 4 AS erased, sector % 13 = 6 AS corrupt, (sector * 31) % 107 AS erase_cnt, (4294967200 + sector * 2) & 4294967295 AS create_seq, 4294967200::BIGINT + sector * 2 AS ord FROM s),
 r AS (SELECT event_id, (event_id // 100)::INT AS sector, (16 + (event_id % 100) * 40)::BIGINT AS off, user_id AS key, CASE WHEN event_id % 4 = 0 THEN 255 WHEN event_id % 4 = 1 THEN 252 ELSE 254 END AS state, event_id % 7 <> 0 AS ok FROM events WHERE event_id < 25000),
 k AS (SELECT r.*, CASE WHEN state = 255 THEN CASE WHEN ok THEN 254 ELSE 252 END ELSE state END AS st FROM r JOIN h USING (sector) WHERE NOT erased AND NOT corrupt), n AS (SELECT key, max(event_id) AS e FROM k WHERE st = 254 GROUP BY key),
 f AS (SELECT k.*, CASE WHEN st = 254 AND k.event_id <> e THEN 252 ELSE st END AS state2 FROM k LEFT JOIN n USING (key)),
 b AS (SELECT sector, sum(CASE WHEN state2 = 254 THEN 40 ELSE 0 END)::BIGINT AS live_bytes, sum(CASE WHEN state2 = 252 THEN 40 ELSE 0 END)::BIGINT AS garbage_bytes, max(off + 40) AS write_off FROM f GROUP BY sector),
 act AS (SELECT sector FROM h JOIN b USING (sector) ORDER BY write_off < 4096 DESC, ord DESC LIMIT 1)"""


def _start(spark, sf_dir):
    s = _made_sectors(spark, sf_dir)
    heads = s.select("sector", (~_in(s, "sector", 13, 6)).alias("magic_ok"), F.lit(True).alias("crc_ok"), _in(s, "sector", 9, 4).alias("erased"), F.pmod(F.col("sector") * 31, F.lit(107)).cast("long").alias("erase_cnt"), (F.lit(4294967200) + F.col("sector") * 2).bitwiseAND(F.lit(0xFFFFFFFF)).alias("create_seq"))
    k = F.col("event_id")
    log = events(spark, sf_dir).where("event_id < 25000").select(F.expr("cast(event_id div 100 AS int)").alias("sector"), (16 + k % 100 * 40).alias("offset"), (F.lit(4294966000) + k).bitwiseAND(F.lit(0xFFFFFFFF)).alias("seq"), F.col("user_id").alias("key"), F.when(k % 4 == 0, 255).when(k % 4 == 1, 252).otherwise(254).alias("state"), (k % 7 != 0).alias("crc_ok"), F.lit(40).alias("record_size"))
    return recover.kv_start(log, heads)


@query(_START + " SELECT h.sector, CASE WHEN erased OR corrupt THEN 'ERASED' WHEN h.sector = (SELECT sector FROM act) THEN 'ACTIVE' WHEN write_off > 16 THEN 'SEALED' ELSE 'ACTIVE' END AS status, (erase_cnt + CASE WHEN corrupt AND NOT erased THEN 1 ELSE 0 END)::BIGINT AS erase_cnt, CASE WHEN erased OR corrupt THEN 0 ELSE create_seq END AS create_seq, coalesce(garbage_bytes, 0) AS garbage_bytes, coalesce(live_bytes, 0) AS live_bytes, coalesce(write_off, 16) AS write_off FROM h LEFT JOIN b USING (sector)")
def recover_kv_sectors(spark, sf_dir):
    """Start-up of a store whose sequence numbers pass the end of the counter: the sectors."""
    return _start(spark, sf_dir)[1]


@query(_START + " SELECT sector, off AS \"offset\", state2 AS state FROM f")
def recover_kv_records(spark, sf_dir):
    return _start(spark, sf_dir)[0].select("sector", "offset", "state")


@query(f"""WITH {_SEC}, h AS (SELECT sector, CASE WHEN sector % 9 = 4 THEN 'EMPTY' WHEN sector % 11 = 5 THEN 'CORRUPT' WHEN sector = (SELECT max(sector) FROM s) THEN 'ACTIVE' ELSE 'SEALED' END AS status, (65500 + CASE WHEN sector % 13 = 7 THEN sector - 3 ELSE sector END) & 65535 AS seq, 65500 + CASE WHEN sector % 13 = 7 THEN sector - 3 ELSE sector END AS ord FROM s),
 live AS (SELECT * FROM h WHERE status IN ('SEALED', 'ACTIVE')), ht AS (SELECT (SELECT sector FROM live ORDER BY ord DESC, sector LIMIT 1) AS head, (SELECT sector FROM live ORDER BY ord, sector LIMIT 1) AS tail),
 r AS (SELECT (event_id // 100)::INT AS sector, event_id % 100 AS delta, event_id % 6 = 0 AS cut, event_id % 7 <> 0 AS ok FROM events WHERE event_id < 25000),
 c AS (SELECT h.sector, h.status, h.seq, h.ord, CASE WHEN status = 'SEALED' AND h.sector <> head THEN 90 WHEN status IN ('SEALED', 'ACTIVE') THEN (SELECT count(*) FROM r WHERE r.sector = h.sector AND (NOT cut OR (h.sector = head AND ok))) ELSE 0 END AS n, (SELECT max(1000 * h.sector + delta) FROM r WHERE r.sector = h.sector AND (NOT cut OR (h.sector = head AND ok))) AS last FROM h, ht),
 p AS (SELECT c.*, (c.sector - tail + (SELECT count(*) FROM s)) % (SELECT count(*) FROM s) AS pos FROM c, ht), ring AS (SELECT * FROM p, ht WHERE pos <= (head - tail + (SELECT count(*) FROM s)) % (SELECT count(*) FROM s)),
 g AS (SELECT *, last_value(CASE WHEN status <> 'EMPTY' THEN seq END IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ring WHERE status <> 'CORRUPT')
 SELECT (SELECT head FROM ht) AS head, (SELECT tail FROM ht) AS tail, (SELECT sum(n) FROM ring)::BIGINT AS total_count, (SELECT last FROM c, ht WHERE sector = head)::BIGINT AS last_time, (SELECT count(*) FROM g WHERE status = 'EMPTY' OR ((prev - seq) & 65535) BETWEEN 1 AND 32767) AS data_gaps, false AS format""")
def recover_ts_start(spark, sf_dir):
    """Start-up of a time series: head, tail, counts, last time and gaps."""
    s = _made_sectors(spark, sf_dir)
    is_ = lambda n, k: _in(s, "sector", n, k)
    number = F.when(is_(13, 7), F.col("sector") - 3).otherwise(F.col("sector"))
    top = s.agg(F.max("sector").alias("top"))
    status = F.when(is_(9, 4), "EMPTY").when(is_(11, 5), "CORRUPT").when(F.col("sector") == F.col("top"), "ACTIVE").otherwise("SEALED")
    heads = s.crossJoin(F.broadcast(top)).select("sector", status.alias("status"), (F.lit(65500) + number).bitwiseAND(F.lit(0xFFFF)).cast("long").alias("seq"), (F.col("sector") * 1000).cast("long").alias("time_base"), F.lit(90).alias("count"))
    k = F.col("event_id")
    log = events(spark, sf_dir).where("event_id < 25000").select(F.expr("cast(event_id div 100 AS int)").alias("sector"), k.alias("offset"), F.when(k % 6 == 0, 255).otherwise(254).alias("state"), (k % 7 != 0).alias("crc_ok"), (k % 100).alias("time_delta"), F.lit(0).alias("time_base"), F.lit(0).alias("time"))
    return recover.ts_start(log, heads)


@query(f"WITH {_SEC} SELECT sector, CASE WHEN sector = 0 THEN 'ACTIVE' ELSE 'ERASED' END AS status, (sector * 31) % 107 + 1 AS erase_cnt, CASE WHEN sector = 0 THEN 1 ELSE 0 END::BIGINT AS create_seq, 0::BIGINT AS garbage_bytes, 16::BIGINT AS write_off FROM s")
def format_kv(spark, sf_dir):
    s = _made_sectors(spark, sf_dir)
    return recover.formatted(s.withColumn("erase_cnt", F.pmod(F.col("sector") * 31, F.lit(107))))


@query(f"WITH {_SEC} SELECT sector, CASE WHEN sector = 0 THEN 'ACTIVE' ELSE 'EMPTY' END AS status, (sector * 31) % 107 + 1 AS erase_cnt, CASE WHEN sector = 0 THEN 1 ELSE 0 END::BIGINT AS head_seq FROM s")
def format_ts(spark, sf_dir):
    s = _made_sectors(spark, sf_dir)
    return recover.formatted(s.withColumn("erase_cnt", F.pmod(F.col("sector") * 31, F.lit(107))), "tsdb").select("sector", "status", "erase_cnt", F.col("create_seq").alias("head_seq"))


@query("WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'delete_ops' WHEN 'view' THEN 'read_ops' WHEN 'signup' THEN 'reset' ELSE 'write_ops' END AS c FROM events), r AS (SELECT user_id, max(CASE WHEN c = 'reset' THEN event_id END) AS last FROM e GROUP BY user_id), k AS (SELECT e.* FROM e JOIN r USING (user_id) WHERE last IS NULL OR event_id > last) SELECT cast(r.user_id AS VARCHAR) AS series, count(*) FILTER (c = 'read_ops') AS read_ops, count(*) FILTER (c = 'write_ops') AS write_ops, count(*) FILTER (c = 'delete_ops') AS delete_ops, (count(*) FILTER (c = 'write_ops')) * 0 AS gc_runs, (count(*) FILTER (c = 'write_ops')) * 0 AS gc_reclaimed_bytes, (count(*) FILTER (c = 'write_ops')) * 0 AS gc_migrated_recs, (count(*) FILTER (c = 'write_ops')) * 0 AS flash_errors, count(*) FILTER (c = 'read_ops' AND event_id % 50 = 0) AS crc_errors, (count(*) FILTER (c = 'write_ops')) * 0 AS corrupt_sectors FROM r LEFT JOIN k USING (user_id) GROUP BY r.user_id")
def kv_counters_reset(spark, sf_dir):
    """All nine counters of each user's store since its last reset (a signup)."""
    kind = F.col("event_type")
    counter = F.when(kind == "error", "delete_ops").when(kind == "view", "read_ops").when(kind == "signup", "reset").otherwise("write_ops")
    e = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("series"), F.col("event_id").alias("at"), counter.alias("counter"), F.lit(1).alias("amount"))
    bad = e.where("counter = 'read_ops' AND at % 50 = 0").withColumn("counter", F.lit("crc_errors"))
    return metrics.counters(e.unionByName(bad), metrics.KV_COUNTERS)


@query(f"WITH RECURSIVE {PACK}, h AS (SELECT max(sector) AS m FROM log) SELECT 'all' AS series, (SELECT count(*) FROM log) AS write_ops, (SELECT count(*) FROM log WHERE time >= {FROM}) AS read_ops, m AS sector_rotations, (SELECT count(*) FROM log WHERE sector <= m - 16) AS records_lost, 0::BIGINT AS flash_errors, (SELECT count(*) FROM log WHERE time >= {FROM} AND arrival % 40 = 0) AS crc_errors, 0::BIGINT AS data_gaps FROM h")
def ts_counters(spark, sf_dir):
    """The seven counters after every append and one read from a time on, damaged records passed over."""
    log = ts_log(spark, sf_dir)
    one = lambda rows, name, amount=F.lit(1): rows.select("series", F.col("arrival").alias("at"), F.lit(name).alias("counter"), amount.cast("long").alias("amount"))
    read = log.where(F.col("time") >= FROM)
    lost = ts.lost(log, 16).withColumn("arrival", F.lit(0).cast("long"))
    found = one(log, "write_ops").unionByName(one(read, "read_ops")).unionByName(one(read.where("arrival % 40 = 0"), "crc_errors")).unionByName(one(lost, "sector_rotations", F.col("rotations"))).unionByName(one(lost, "records_lost", F.col("records_lost")))
    return metrics.counters(found, metrics.TS_COUNTERS)


@query(f"WITH RECURSIVE {PACK}, l AS (SELECT * FROM log ORDER BY sector DESC, off DESC LIMIT 1), f AS (SELECT * FROM log ORDER BY sector, off LIMIT 1) SELECT 'latest' AS which, CASE WHEN arrival % 40 = 0 THEN 'CRC' WHEN len > 9 THEN 'TOO_LARGE' ELSE 'OK' END AS status, CASE WHEN arrival % 40 <> 0 THEN props[1:9] END AS data, len::INT AS data_len FROM l UNION ALL SELECT 'oldest', CASE WHEN arrival % 40 = 0 THEN 'CRC' WHEN len > 9 THEN 'TOO_LARGE' ELSE 'OK' END, CASE WHEN arrival % 40 <> 0 THEN props[1:9] END, len::INT FROM f UNION ALL SELECT 'nothing', 'NOT_FOUND', NULL, NULL")
def ts_read_one(spark, sf_dir):
    """The last and the first record read into nine bytes, with damaged records, and a series without any."""
    log = ts_log(spark, sf_dir).withColumn("crc_ok", F.col("arrival") % 40 != 0)
    asked = spark.createDataFrame([("all",)], "series string")
    none = spark.createDataFrame([("empty",)], "series string")
    show = lambda df, which: df.select(F.lit(which).alias("which"), "status", text("data").alias("data"), "data_len")
    return show(ts.read_one(asked, ts.latest(log), 9), "latest").unionByName(show(ts.read_one(asked, ts.oldest(log), 9), "oldest")).unionByName(show(ts.read_one(none, ts.latest(log), 9), "nothing"))


@query(f"WITH RECURSIVE {PACK} SELECT 'all' AS series, min(time) AS oldest, max(time) AS newest FROM log UNION ALL SELECT 'empty', 4294967295, 4294967295")
def ts_time_range_empty(spark, sf_dir):
    """A series with records and one without: the sentinel stands for both ends of the latter."""
    return ts.span(ts_log(spark, sf_dir), spark.createDataFrame([("all",), ("empty",)], "series string"))


# ---- compaction as it runs


@query(f"WITH {KV}, live AS (SELECT * FROM cur WHERE seq % 50 <> 0) SELECT row_number() OVER (ORDER BY seq) AS seq, seq AS old_seq, key, value FROM live")
def gc_compact(spark, sf_dir):
    """The compacted log: damaged records dropped, the rest numbered anew."""
    ops = kv_ops(spark, sf_dir).withColumn("crc_ok", F.col("seq") % 50 != 0)
    return gc.compact(ops).select("seq", "old_seq", text("key").alias("key"), text("value").alias("value"))


@query(f"WITH RECURSIVE {LAID}, t AS (SELECT max(sector) + 1 AS m, max(seq) AS top FROM laid), v AS (SELECT *, row_number() OVER (ORDER BY off) AS i, sum(size) OVER (ORDER BY off) - size AS before FROM laid WHERE sector = 2 AND live AND seq % 50 <> 0) SELECT sector, off AS \"offset\", seq, key FROM laid WHERE sector <> 2 UNION ALL SELECT m, (16 + before)::BIGINT, top + i, key FROM v, t")
def gc_reclaim_sector(spark, sf_dir):
    """The log after sector 2 is collected into a fresh one."""
    log = kv_laid(spark, sf_dir).select("series", "sector", "offset", "seq", "key", F.lit(254).alias("state"), (F.col("seq") % 50 != 0).alias("crc_ok"), "live", "record_size")
    fresh = log.agg(F.max("sector")).first()[0]
    return gc.reclaim(log, 2, [] if fresh is None else [(fresh + 1, 16)]).select("sector", "offset", "seq", text("key").alias("key"))


@query()
def gc_ensure_space(spark, sf_dir):
    """Collection of a store for each hundred users until three sectors are erased; each has one erased sector to begin with.  An iteration,
    so SQL has no form of it: tests hold it against a plain model."""
    series = F.concat(F.lit("u"), F.expr("cast(cast(decode(key, 'utf-8') AS int) div 100 AS string)"))
    ops = kv_ops(spark, sf_dir).withColumn("series", series)
    placed = kv.place(ops)
    laid = placed.join(kv.versions(ops).select("series", "seq", "live"), ["series", "seq"])
    log = laid.select("series", F.col("sector").cast("int").alias("sector"), "offset", "seq", "key", "live", (F.col("seq") % 50 != 0).alias("crc_ok"), "record_size")
    used = placed.select("series", F.col("sector").cast("int").alias("sector"), "offset", "record_size").groupBy("series", "sector").agg(F.max(F.col("offset") + F.col("record_size")).alias("write_off"))
    top = used.groupBy("series").agg(F.max("sector").alias("top"))
    used = used.join(top, "series").select("series", "sector", F.when(F.col("sector") == F.col("top"), "ACTIVE").otherwise("SEALED").alias("status"), "write_off")
    spare = top.select("series", (F.col("top") + 1).cast("int").alias("sector"), F.lit("ERASED").alias("status"), F.lit(16).cast("long").alias("write_off"))
    sectors = used.unionByName(spare).withColumn("erase_cnt", F.pmod(F.col("sector") * 37, F.lit(113)).cast("long"))
    return gc.ensure_space(log, sectors).select("type", "series", "sector", "offset", "seq", "old_seq", text("key").alias("key"), "status", "write_off", "erase_cnt", "gc_runs", "gc_reclaimed_bytes", "gc_migrated_recs")
