"""Registered queries over the driver's tables, and their DuckDB equivalents.

`events` serves as both logs: as a time series (arrival = event_id, requested time = the event's second, payload = props) and as
a key-value log (key = user_id, value = props, an 'error' event deletes).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import gc, kv, metrics, recover, ts


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The range that the range queries ask for, as seconds from 1970.
FROM, TO = 1704070000, 1704600000


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def ts_ops(spark: SparkSession, sf_dir: str, series: str = "'all'") -> DataFrame:
    """The append log of events; seconds are counted without a time zone."""
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    return events(spark, sf_dir).select(F.expr(series).cast("string").alias("series"), F.col("event_id").alias("arrival"), F.lit("append").alias("op"), seconds.alias("req_time"), F.encode("props", "utf-8").alias("data"))


def ts_epoch_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a reset before each signup."""
    ops = ts_ops(spark, sf_dir).withColumn("arrival", F.col("arrival") * 2 + 1)
    resets = events(spark, sf_dir).where("event_type = 'signup'").select(F.lit("all").alias("series"), (F.col("event_id") * 2).alias("arrival"), F.lit("reset_epoch").alias("op"), F.lit(None).cast("long").alias("req_time"), F.lit(None).cast("binary").alias("data"))
    return ops.unionByName(resets)


def ts_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ts.repair(ts_ops(spark, sf_dir)).where("status = 'OK'")
    return ts.pack_next_fit(rows).withColumn("state", F.lit(254)).withColumn("crc_ok", F.lit(True))


def kv_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.encode(F.col("user_id").cast("string"), "utf-8")
    op = F.when(F.col("event_type") == "error", "delete").otherwise("set")
    return events(spark, sf_dir).select(F.lit("all").alias("series"), F.col("event_id").alias("seq"), op.alias("op"), key.alias("key"), F.encode("props", "utf-8").alias("value"))


def kv_laid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = kv_ops(spark, sf_dir)
    live = kv.versions(ops).select("series", "seq", "live")
    return kv.place(ops).join(live, ["series", "seq"])


def kv_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sector rows of the laid-out log; erase counts and erased sectors are made up from the number."""
    rows = kv.sector_bytes(kv_laid(spark, sf_dir))
    erased = F.pmod("sector", F.lit(11)) == 5
    return rows.select(
        F.col("sector").cast("int").alias("sector"),
        F.when(erased, "ERASED").when(F.col("sector") == 0, "ACTIVE").otherwise("SEALED").alias("status"),
        F.when(erased, 16).otherwise(F.col("write_off")).cast("long").alias("write_off"),
        F.when(erased, 0).otherwise(F.col("garbage_bytes")).cast("long").alias("garbage_bytes"),
        F.pmod(F.col("sector") * 37, F.lit(113)).cast("long").alias("erase_cnt"),
    )


text = lambda c: F.decode(F.col(c), "utf-8")

# ---- SQL building blocks

OPS = "ops AS (SELECT event_id AS arrival, cast(floor(epoch(ts)) AS BIGINT) AS req_time, props, strlen(props) AS len, user_id, event_type, value FROM events)"
REP = OPS + ", num AS (SELECT *, row_number() OVER (ORDER BY arrival) AS i FROM ops), rep AS (SELECT arrival, props, len, user_id, i, i + greatest(0, max(req_time - i) OVER (ORDER BY arrival ROWS UNBOUNDED PRECEDING)) AS time FROM num)"
PACK = REP + """, walk AS (SELECT i, 0::BIGINT AS sector, 20::BIGINT AS off, 12 + len AS size FROM rep WHERE i = 1
 UNION ALL SELECT r.i, CASE WHEN w.off + w.size + 12 + r.len > 4096 THEN w.sector + 1 ELSE w.sector END, CASE WHEN w.off + w.size + 12 + r.len > 4096 THEN 20 ELSE w.off + w.size END, 12 + r.len FROM walk w JOIN rep r ON r.i = w.i + 1),
 log AS (SELECT r.arrival, r.props, r.len, r.time, w.sector, w.off, w.size FROM rep r JOIN walk w USING (i))"""
KV = "kv AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'set' END AS op, cast(user_id AS VARCHAR) AS key, props AS value FROM events), newest AS (SELECT key, max(seq) AS seq FROM kv GROUP BY key), cur AS (SELECT kv.* FROM kv JOIN newest USING (key, seq) WHERE op = 'set')"
LAID = KV + """, sized AS (SELECT *, 16 + strlen(key) + strlen(value) AS size, row_number() OVER (ORDER BY seq) AS i FROM kv WHERE op = 'set'),
 steps AS (SELECT i, 0::BIGINT AS sector, 16::BIGINT AS off, size FROM sized WHERE i = 1
 UNION ALL SELECT r.i, CASE WHEN w.off + w.size + r.size > 4096 THEN w.sector + 1 ELSE w.sector END, CASE WHEN w.off + w.size + r.size > 4096 THEN 16 ELSE w.off + w.size END, r.size FROM steps w JOIN sized r ON r.i = w.i + 1),
 laid AS (SELECT p.seq, p.key, p.value, p.size, t.sector, t.off, c.seq IS NOT NULL AS live FROM sized p JOIN steps t USING (i) LEFT JOIN cur c ON c.seq = p.seq),
 bytes AS (SELECT sector, sum(CASE WHEN live THEN size ELSE 0 END)::BIGINT AS live_bytes, sum(CASE WHEN live THEN 0 ELSE size END)::BIGINT AS garbage_bytes, max(off + size)::BIGINT AS write_off FROM laid GROUP BY sector),
 sec AS (SELECT sector::INT AS sector, CASE WHEN sector % 11 = 5 THEN 'ERASED' WHEN sector = 0 THEN 'ACTIVE' ELSE 'SEALED' END AS status, CASE WHEN sector % 11 = 5 THEN 16 ELSE write_off END AS write_off, CASE WHEN sector % 11 = 5 THEN 0 ELSE garbage_bytes END AS garbage_bytes, (sector * 37) % 113 AS erase_cnt FROM bytes)"""
CAND = LAID + """, tot AS (SELECT count(*) FILTER (status = 'ERASED') AS erased, min(erase_cnt) AS min_ec, max(erase_cnt) AS max_ec, coalesce(min(erase_cnt) FILTER (status <> 'ERASED'), 0) AS used_min, coalesce(max(erase_cnt) FILTER (status <> 'ERASED'), 0) AS used_max, coalesce(max(CASE WHEN sector = 0 AND status = 'ACTIVE' THEN 4096 - write_off END), 0) AS room FROM sec),
 c0 AS (SELECT *, CASE WHEN status = 'ERASED' THEN 0 ELSE greatest(write_off - 16, 0) END AS used, sector <> 0 AND status IN ('ACTIVE', 'SEALED') AS mine, room + 4080 * erased AS avail FROM sec, tot),
 c1 AS (SELECT *, greatest(used - garbage_bytes, 0) AS live, CASE WHEN used > 0 THEN garbage_bytes * 100 // used ELSE 0 END AS gpct, (erase_cnt - used_min) * 100 // (CASE WHEN used_max > used_min THEN used_max - used_min ELSE 1 END) AS wpct FROM c0),
 cand AS (SELECT *, 7 * gpct + 3 * wpct + CASE WHEN live = 0 THEN 100 ELSE 100 - least(live * 100 // 4080, 100) END AS score, CASE WHEN erased > 2 THEN 20 WHEN erased = 2 THEN 5 ELSE 1 END AS threshold FROM c1)"""


# ---- time series


@query(f"WITH {REP} SELECT arrival, time FROM rep")
def ts_append_repair(spark, sf_dir):
    return ts.repair(ts_ops(spark, sf_dir)).where("status = 'OK'").select("arrival", "time")


@query(f"WITH {OPS}, num AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY arrival) AS i FROM ops) SELECT cast(user_id AS VARCHAR) AS series, arrival, i + greatest(0, max(req_time - i) OVER (PARTITION BY user_id ORDER BY arrival ROWS UNBOUNDED PRECEDING)) AS time FROM num")
def ts_append_repair_by_user(spark, sf_dir):
    return ts.repair(ts_ops(spark, sf_dir, "user_id")).where("status = 'OK'").select("series", "arrival", "time")


@query("WITH o AS (SELECT event_id AS i, CASE WHEN event_id % 7 = 0 THEN NULL ELSE repeat(props, 1 + event_id % 500) END AS data, CASE WHEN event_id = 40 THEN 4294967293 ELSE event_id END AS t FROM events), f AS (SELECT *, strlen(data) BETWEEN 1 AND 4064 AS fine FROM o), n AS (SELECT *, row_number() OVER (ORDER BY i) AS k FROM f WHERE fine), r AS (SELECT i, k + greatest(0, max(t - k) OVER (ORDER BY i)) AS time FROM n) SELECT CASE WHEN data IS NULL THEN 'PARAM' WHEN NOT fine THEN 'TOO_LARGE' WHEN time > 4294967294 THEN 'TIME_EXHAUSTED' ELSE 'OK' END AS status, count(*) AS n FROM f LEFT JOIN r USING (i) GROUP BY 1")
def ts_append_status(spark, sf_dir):
    """Every status of an append: payloads of 1 to 500 copies of props, every seventh missing, and one time near the end of the counter."""
    k = F.col("event_id")
    data = F.when(k % 7 != 0, F.encode(F.expr("repeat(props, cast(1 + event_id % 500 AS int))"), "utf-8"))
    ops = events(spark, sf_dir).select(F.lit("all").alias("series"), k.alias("arrival"), F.lit("append").alias("op"), F.when(k == 40, F.lit(4294967293)).otherwise(k).alias("req_time"), data.alias("data"))
    return ts.repair(ops).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {REP} SELECT arrival, time, props AS data FROM rep WHERE time BETWEEN {FROM} AND {TO}")
def ts_query_range(spark, sf_dir):
    return ts.time_range(ts.repair(ts_ops(spark, sf_dir)), FROM, TO).select("arrival", "time", text("data").alias("data"))


@query(f"WITH {REP} SELECT count(*) AS n, sum(len)::BIGINT AS sum_len, min(len) AS min_len, max(len) AS max_len, (sum(len) // count(*))::BIGINT AS avg_len, min(time) AS first_time, max(time) AS last_time FROM rep WHERE time BETWEEN {FROM} AND {TO}")
def ts_query_range_fold(spark, sf_dir):
    rows = ts.time_range(ts.repair(ts_ops(spark, sf_dir)), FROM, TO).select("time", F.length("data").cast("long").alias("len"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("sum_len"), F.min("len").alias("min_len"), F.max("len").alias("max_len"), F.expr("sum(len) div count(1)").alias("avg_len"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


@query(f"WITH RECURSIVE {PACK} SELECT arrival, time FROM log ORDER BY sector, off LIMIT 25")
def ts_query_limit_stop(spark, sf_dir):
    return ts.take(ts_log(spark, sf_dir), 25).select("arrival", "time")


@query(f"WITH RECURSIVE {PACK} SELECT time, props AS data, sector, off AS \"offset\" FROM log ORDER BY sector DESC, off DESC LIMIT 1")
def ts_latest(spark, sf_dir):
    return ts.latest(ts_log(spark, sf_dir)).select("time", text("data").alias("data"), "sector", "offset")


@query(f"WITH RECURSIVE {PACK} SELECT time, props AS data, sector, off AS \"offset\" FROM log WHERE sector > (SELECT max(sector) FROM log) - 16 ORDER BY sector, off LIMIT 1")
def ts_oldest(spark, sf_dir):
    return ts.oldest(ts.retain(ts_log(spark, sf_dir), 16)).select("time", text("data").alias("data"), "sector", "offset")


@query(f"WITH RECURSIVE {PACK} SELECT count(*) AS records FROM log WHERE sector > (SELECT max(sector) FROM log) - 16")
def ts_count(spark, sf_dir):
    return ts.count_valid(ts.retain(ts_log(spark, sf_dir), 16)).select("records")


@query(f"WITH RECURSIVE {PACK} SELECT arg_min(time, sector * 65536 + off) AS oldest, arg_max(time, sector * 65536 + off) AS newest FROM log WHERE sector > (SELECT max(sector) FROM log) - 16")
def ts_time_range(spark, sf_dir):
    return ts.span(ts.retain(ts_log(spark, sf_dir), 16)).select("oldest", "newest")


EPOCH = OPS + ", marked AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (ORDER BY arrival)::INT AS epoch FROM ops)"


@query(f"WITH {EPOCH} SELECT arrival, epoch FROM marked")
def ts_epoch_assign(spark, sf_dir):
    return ts.epochs(ts_epoch_ops(spark, sf_dir)).where("op = 'append'").select(F.expr("(arrival - 1) div 2").alias("arrival"), "epoch")


@query(f"WITH {EPOCH}, num AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY arrival) AS i FROM marked) SELECT arrival, epoch, i + greatest(0, max(req_time - i) OVER (PARTITION BY epoch ORDER BY arrival ROWS UNBOUNDED PRECEDING)) AS time FROM num")
def ts_epoch_repair(spark, sf_dir):
    return ts.repair(ts.epochs(ts_epoch_ops(spark, sf_dir))).where("status = 'OK'").select(F.expr("(arrival - 1) div 2").alias("arrival"), "epoch", "time")


@query(f"WITH {REP} SELECT arrival, ((i - 1) // 203)::BIGINT AS sector, (20 + ((i - 1) % 203) * 20)::BIGINT AS \"offset\" FROM rep")
def ts_pack_fixed(spark, sf_dir):
    return ts.pack_fixed(ts_ops(spark, sf_dir), 8).select("arrival", F.col("sector").cast("long").alias("sector"), F.col("offset").cast("long").alias("offset"))


@query(f"WITH RECURSIVE {PACK} SELECT arrival, sector, off AS \"offset\" FROM log")
def ts_pack_nextfit(spark, sf_dir):
    return ts_log(spark, sf_dir).select("arrival", "sector", "offset")


@query(f"WITH RECURSIVE {PACK} SELECT arrival, sector FROM log WHERE sector > (SELECT max(sector) FROM log) - 16")
def ts_ring_retain(spark, sf_dir):
    return ts.retain(ts_log(spark, sf_dir), 16).select("arrival", "sector")


@query(f"WITH RECURSIVE {PACK} SELECT max(sector) AS rotations, count(*) FILTER (sector <= (SELECT max(sector) FROM log) - 16) AS records_lost FROM log")
def ts_records_lost(spark, sf_dir):
    return ts.lost(ts_log(spark, sf_dir), 16).select("rotations", "records_lost")


@query(f"WITH RECURSIVE {PACK} SELECT sector, count(*) AS records, sum(size)::BIGINT AS bytes, arg_min(time, off) AS time_base, arg_max(time, off) AS last_time, max(off + size)::BIGINT AS end_off FROM log GROUP BY sector")
def ts_sector_stats(spark, sf_dir):
    return ts.sector_stats(ts_log(spark, sf_dir)).select("sector", "records", "bytes", "time_base", "last_time", "end_off")


@query(f"WITH RECURSIVE {PACK} SELECT arrival, time - min(time) OVER (PARTITION BY sector) AS time_delta, (sector % 16)::BIGINT AS slot FROM log")
def ts_delta_join(spark, sf_dir):
    """Records joined to their sector's base time: delta from the base, and the ring slot that the sector takes."""
    log = ts_log(spark, sf_dir)
    base = ts.sector_stats(log).select("series", "sector", "time_base")
    return log.join(base, ["series", "sector"]).select("arrival", (F.col("time") - F.col("time_base")).alias("time_delta"), F.pmod("sector", F.lit(16)).alias("slot"))


@query("WITH s AS (SELECT DISTINCT event_id // 100 AS ring_pos FROM events), f AS (SELECT ring_pos, (CASE WHEN ring_pos % 13 = 7 THEN ring_pos - 3 ELSE ring_pos END) & 65535 AS seq, ring_pos % 9 = 4 AS empty FROM s), l AS (SELECT *, last_value(CASE WHEN NOT empty THEN seq END IGNORE NULLS) OVER (ORDER BY ring_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM f) SELECT count(*) FILTER (empty OR ((prev - seq) & 65535) BETWEEN 1 AND 32767) AS data_gaps FROM l")
def ts_gap_detect(spark, sf_dir):
    """Sequence numbers from tail to head, some falling and some sectors empty."""
    rows = events(spark, sf_dir).select(F.expr("event_id div 100").alias("ring_pos")).distinct()
    seq = F.when(F.pmod("ring_pos", F.lit(13)) == 7, F.col("ring_pos") - 3).otherwise(F.col("ring_pos")).bitwiseAND(F.lit(0xFFFF))
    rows = rows.select(F.lit("all").alias("series"), "ring_pos", seq.alias("seq"), F.when(F.pmod("ring_pos", F.lit(9)) == 4, "EMPTY").otherwise("SEALED").alias("status"))
    return ts.gaps(rows).select("data_gaps")


@query("SELECT event_id AS arrival, CASE WHEN event_id % 50 <> 0 AND strlen(repeat(props, 1 + event_id % 12)) <= 64 THEN repeat(props, 1 + event_id % 12) END AS data, strlen(repeat(props, 1 + event_id % 12)) AS len, CASE WHEN event_id % 50 = 0 THEN 'CRC' WHEN strlen(repeat(props, 1 + event_id % 12)) > 32 THEN 'TOO_LARGE' ELSE 'OK' END AS read_status FROM events")
def ts_payload_policy(spark, sf_dir):
    """Payloads of one to twelve copies of props; every fiftieth record is damaged; the caller's buffer holds 32 bytes."""
    rows = events(spark, sf_dir).select("event_id", F.encode(F.expr("repeat(props, 1 + cast(event_id % 12 AS int))"), "utf-8").alias("data"), (F.col("event_id") % 50 != 0).alias("crc_ok"))
    return rows.select(F.col("event_id").alias("arrival"), F.decode(ts.payload(F.col("data"), 32, F.col("crc_ok")), "utf-8").alias("data"), F.length("data").cast("long").alias("len"), ts.read_status(32, F.length("data"), F.col("crc_ok")).alias("read_status"))


@query(f"WITH RECURSIVE {PACK}, h AS (SELECT max(sector) AS m FROM log), e AS (SELECT m % 16 AS head, CASE WHEN m >= 15 THEN (m + 1) % 16 ELSE 0 END AS tail FROM h), s AS (SELECT unnest(range(16)) AS sector) SELECT sector::BIGINT AS sector, CASE WHEN sector = head AND sector = tail THEN 'HEAD+TL' WHEN sector = head THEN 'HEAD' WHEN sector = tail THEN 'TAIL' WHEN (CASE WHEN tail <= head THEN sector BETWEEN tail AND head ELSE sector >= tail OR sector <= head END) THEN 'DATA' ELSE 'FREE' END AS role FROM s, e")
def ts_role_map(spark, sf_dir):
    head = ts_log(spark, sf_dir).agg(F.max("sector").alias("m")).select((F.col("m") % 16).alias("head"), F.when(F.col("m") >= 15, (F.col("m") + 1) % 16).otherwise(0).alias("tail"))
    return spark.range(16).withColumnRenamed("id", "sector").crossJoin(F.broadcast(head)).select("sector", ts.role(F.col("sector"), F.col("head"), F.col("tail")).alias("role"))


@query("SELECT min((sector * 31) % 107) AS min_erase, max((sector * 31) % 107) AS max_erase, (sum((sector * 31) % 107) // count(*))::BIGINT AS avg_erase, max((sector * 31) % 107) - min((sector * 31) % 107) AS spread FROM (SELECT DISTINCT event_id // 203 AS sector FROM events)")
def ts_wear_info(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.expr("event_id div 203").alias("sector")).distinct()
    return kv.wear(rows.withColumn("erase_cnt", F.pmod(F.col("sector") * 31, F.lit(107))))


# ---- key-value


@query(f"WITH {KV} SELECT key, value, seq FROM cur")
def kv_current(spark, sf_dir):
    return kv.current(kv_ops(spark, sf_dir)).select(text("key").alias("key"), text("value").alias("value"), "seq")


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys to look up: every customer number."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return customers.select(F.encode(F.col("c_custkey").cast("string"), "utf-8").alias("key"))


def _read(df: DataFrame) -> DataFrame:
    return df.select(text("key").alias("key"), "status", text("value").alias("value"), F.coalesce(F.col("value_len").cast("long"), F.lit(0)).alias("value_len"))


@query(f"WITH {KV} SELECT k.key, CASE WHEN c.value IS NULL THEN 'NOT_FOUND' ELSE 'OK' END AS status, c.value, coalesce(strlen(c.value), 0) AS value_len FROM (SELECT '7' AS key) k LEFT JOIN cur c USING (key)")
def kv_get(spark, sf_dir):
    return _read(kv.get(kv.current(kv_ops(spark, sf_dir)), b"7"))


@query(f"WITH {KV} SELECT k.key, CASE WHEN c.value IS NULL THEN 'NOT_FOUND' WHEN strlen(c.value) > 8 THEN 'TOO_LARGE' ELSE 'OK' END AS status, substr(c.value, 1, 8) AS value, coalesce(strlen(c.value), 0) AS value_len FROM (SELECT cast(c_custkey AS VARCHAR) AS key FROM customer) k LEFT JOIN cur c USING (key)")
def kv_get_truncated(spark, sf_dir):
    return _read(kv.multi_get(kv.current(kv_ops(spark, sf_dir)), _wanted(spark, sf_dir), 8))


@query(f"WITH {KV} SELECT key FROM (SELECT cast(c_custkey AS VARCHAR) AS key FROM customer) k WHERE EXISTS (SELECT 1 FROM cur WHERE cur.key = k.key)")
def kv_exists(spark, sf_dir):
    return kv.exists(kv.current(kv_ops(spark, sf_dir)), _wanted(spark, sf_dir)).select(text("key").alias("key"))


@query(f"WITH {KV} SELECT k.key, CASE WHEN c.value IS NULL THEN 'NOT_FOUND' ELSE 'OK' END AS status, c.value, coalesce(strlen(c.value), 0) AS value_len FROM (SELECT cast(c_custkey AS VARCHAR) AS key FROM customer) k LEFT JOIN cur c USING (key)")
def kv_multiget(spark, sf_dir):
    return _read(kv.multi_get(kv.current(kv_ops(spark, sf_dir)), _wanted(spark, sf_dir)))


@query("SELECT o_custkey AS key, o_orderkey AS seq, o_orderstatus AS value FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def kv_current_orders(spark, sf_dir):
    """Orders as snapshots of a customer's state: the newest one."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ops = orders.select(F.lit("orders").alias("series"), F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.lit("set").alias("op"), F.col("o_orderstatus").alias("value"))
    return kv.current(ops).select("key", "seq", "value")


@query(f"WITH RECURSIVE {LAID} SELECT sector, off AS \"offset\", key, substr(value, 1, 6) AS value FROM laid WHERE live AND (sector > 2 OR (sector = 2 AND off > 100)) ORDER BY sector, off LIMIT 20")
def kv_iterate_page(spark, sf_dir):
    """The iterator's second page: twenty live records after a position; the limit is the page."""
    return kv.page(kv_laid(spark, sf_dir).where("live"), (2, 100), 20, value_capacity=6).select("sector", "offset", text("key").alias("key"), text("value").alias("value"))


@query(f"WITH {KV} SELECT key, seq, (SELECT count(*) FROM kv k WHERE k.key = n.key AND op = 'set') AS versions FROM newest n JOIN kv USING (key, seq) WHERE op = 'delete'")
def kv_delete_effect(spark, sf_dir):
    """Keys whose last operation is a delete, and the versions it hides."""
    ops = kv_ops(spark, sf_dir)
    hidden = ops.groupBy("series", "key").agg(F.count(F.when(F.col("op") == "set", 1)).alias("versions"))
    return kv.newest(ops).where("op = 'delete'").join(hidden, ["series", "key"]).select(text("key").alias("key"), "seq", "versions")


@query(f"WITH RECURSIVE {LAID} SELECT seq, key, live FROM laid")
def kv_versions(spark, sf_dir):
    return kv.versions(kv_ops(spark, sf_dir)).select("seq", text("key").alias("key"), "live")


@query(f"WITH RECURSIVE {LAID} SELECT sector, live_bytes, garbage_bytes, write_off FROM bytes")
def kv_garbage_by_sector(spark, sf_dir):
    return kv.sector_bytes(kv_laid(spark, sf_dir)).select("sector", "live_bytes", "garbage_bytes", F.col("write_off").cast("long").alias("write_off"))


@query(f"WITH {KV}, u AS (SELECT least(coalesce(sum(16 + strlen(key) + strlen(value)), 0), 57120)::BIGINT AS used FROM cur) SELECT 57120::BIGINT AS total, used, 57120 - used AS available FROM u")
def kv_space_info(spark, sf_dir):
    return kv.space(kv.validated(kv.current(kv_ops(spark, sf_dir))))


@query(f"WITH RECURSIVE {LAID} SELECT min(erase_cnt) AS min_erase, max(erase_cnt) AS max_erase, (sum(erase_cnt) // count(*))::BIGINT AS avg_erase, max(erase_cnt) - min(erase_cnt) AS spread FROM sec")
def kv_wear_info(spark, sf_dir):
    return kv.wear(kv_sectors(spark, sf_dir))


@query(f"WITH RECURSIVE {LAID} SELECT sector, write_off * 100 // 4096 AS used_pct, garbage_bytes * 100 // write_off AS garbage_pct, 4096 - write_off AS free_bytes FROM sec")
def kv_sector_usage(spark, sf_dir):
    return metrics.usage(kv_sectors(spark, sf_dir), 4096)


@query("SELECT count(*) FILTER (event_type <> 'error') AS write_ops, count(*) FILTER (event_type = 'error') AS delete_ops FROM events")
def kv_runtime_stats(spark, sf_dir):
    ops = kv_ops(spark, sf_dir)
    return ops.agg(F.count(F.when(F.col("op") == "set", 1)).alias("write_ops"), F.count(F.when(F.col("op") == "delete", 1)).alias("delete_ops"))


@query(f"WITH {KV}, o AS (SELECT cast(cast(key AS INT) // 10 AS VARCHAR) AS series, op, lag(op) OVER (PARTITION BY key ORDER BY seq) AS last FROM kv) SELECT series, CASE WHEN op = 'delete' AND (last IS NULL OR last = 'delete') THEN 'NOT_FOUND' ELSE 'OK' END AS status, count(*) AS n FROM o GROUP BY 1, 2")
def kv_admission(spark, sf_dir):
    """Status of each operation under the store's capacity, one store for each ten users: ordered folds, side by side."""
    ops = kv_ops(spark, sf_dir).withColumn("series", F.expr("cast(cast(decode(key, 'utf-8') AS int) div 10 AS string)"))
    return kv.admit(ops).groupBy("series", "status").agg(F.count(F.lit(1)).alias("n"))


# ---- compaction


def _gc(rows: DataFrame) -> DataFrame:
    return rows.select("sector", "erase_cnt", "garbage_bytes", F.col("live").cast("long").alias("live"), F.col("score").cast("long").alias("score"))


_COLS = "sector, erase_cnt, garbage_bytes, live, score"


@query(f"WITH RECURSIVE {CAND} SELECT {_COLS} FROM cand WHERE mine AND live = 0 AND garbage_bytes > 0")
def gc_zero_live(spark, sf_dir):
    return _gc(gc.zero_live(gc.candidates(kv_sectors(spark, sf_dir), 0)))


@query(f"WITH RECURSIVE {CAND} SELECT {_COLS} FROM cand WHERE mine AND garbage_bytes > 0 AND gpct >= threshold AND live <= avail")
def gc_scored(spark, sf_dir):
    return _gc(gc.scored(gc.candidates(kv_sectors(spark, sf_dir), 0)))


@query(f"WITH RECURSIVE {CAND} SELECT {_COLS} FROM cand WHERE mine AND garbage_bytes > 0 AND live <= avail")
def gc_forced(spark, sf_dir):
    return _gc(gc.forced(gc.candidates(kv_sectors(spark, sf_dir), 0)))


@query(f"WITH RECURSIVE {CAND}, l AS (SELECT sector FROM cand WHERE mine ORDER BY erase_cnt, sector LIMIT 1) SELECT {_COLS} FROM cand WHERE sector = (SELECT sector FROM l) AND max_ec - min_ec >= 100 AND live <= avail")
def gc_wear_level(spark, sf_dir):
    return _gc(gc.wear_level(gc.candidates(kv_sectors(spark, sf_dir), 0)))


@query(f"""WITH RECURSIVE {CAND}, l AS (SELECT sector FROM cand WHERE mine ORDER BY erase_cnt, sector LIMIT 1), v AS (
 SELECT 1 AS phase, erase_cnt AS k, sector FROM cand WHERE mine AND live = 0 AND garbage_bytes > 0
 UNION ALL SELECT 2, -score, sector FROM cand WHERE mine AND garbage_bytes > 0 AND gpct >= threshold AND live <= avail
 UNION ALL SELECT 3, -garbage_bytes, sector FROM cand WHERE mine AND garbage_bytes > 0 AND live <= avail
 UNION ALL SELECT 4, erase_cnt, sector FROM cand WHERE sector = (SELECT sector FROM l) AND max_ec - min_ec >= 100 AND live <= avail)
 SELECT phase, sector FROM v ORDER BY phase, k, sector LIMIT 1""")
def gc_victim(spark, sf_dir):
    return gc.victim(kv_sectors(spark, sf_dir), 0)


@query(f"WITH RECURSIVE {LAID} SELECT sector, erase_cnt FROM sec WHERE status = 'ERASED' ORDER BY erase_cnt, sector LIMIT 1")
def gc_next_sector(spark, sf_dir):
    return gc.next_sector(kv_sectors(spark, sf_dir))


@query(f"WITH RECURSIVE {LAID} SELECT count(*) FILTER (status = 'ERASED') < 3 AS needed, count(*) FILTER (status = 'ERASED') AS erased FROM sec")
def gc_needed(spark, sf_dir):
    return gc.needed(kv_sectors(spark, sf_dir))


@query(f"WITH {KV} SELECT key, value FROM cur")
def gc_compact_preserves(spark, sf_dir):
    return kv.current(gc.compact(kv_ops(spark, sf_dir))).select(text("key").alias("key"), text("value").alias("value"))


# ---- functions

_BYTES = "list_transform(range(strlen(s)), lambda i: ('0x' || substr(hex(encode(s)), (2 * i + 1)::INT, 2))::BIGINT)"


@query(f"SELECT s, list_reduce(list_concat([65535::BIGINT], {_BYTES}), lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 40961) ELSE x >> 1 END))::INT AS crc FROM (SELECT DISTINCT props AS s FROM events)")
def fn_crc16(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("props").alias("s")).distinct().select("s", S.crc16(F.encode("s", "utf-8")).alias("crc"))


@query(ORACLES["fn_crc16"])
def fn_crc16_fast(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("props").alias("s")).distinct().select("s", S.crc16_fast(F.encode("s", "utf-8")).alias("crc"))


@query(f"WITH h AS (SELECT s, list_reduce(list_concat([2166136261::BIGINT], {_BYTES}), lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS h FROM (SELECT DISTINCT props AS s FROM events)) SELECT s, (xor(h, h >> 16) & 65535)::INT AS hash FROM h")
def fn_hash16(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("props").alias("s")).distinct().select("s", S.hash16(F.encode("s", "utf-8")).alias("hash"))


@query("WITH p AS (SELECT event_id, (event_id * 2654435761) & 4294967295 AS a, (event_id * 40503 + 7) & 4294967295 AS b FROM events) SELECT event_id, ((a - b) & 4294967295) BETWEEN 1 AND 2147483647 AS after32, ((a - b) & 65535) BETWEEN 1 AND 32767 AS after16 FROM p")
def fn_seq_gt(spark, sf_dir):
    mask = F.lit(0xFFFFFFFF)
    p = events(spark, sf_dir).select("event_id", (F.col("event_id") * F.lit(2654435761)).bitwiseAND(mask).alias("a"), (F.col("event_id") * 40503 + 7).bitwiseAND(mask).alias("b"))
    return p.select("event_id", S.seq_gt(F.col("a"), F.col("b")).alias("after32"), S.seq16_gt(F.col("a"), F.col("b")).alias("after16"))


@query("SELECT k AS key_len, g AS gran, 4080 - 16 - ((k + g - 1) // g) * g AS max_value, 16 + ((k + g - 1) // g) * g + ((100 + g - 1) // g) * g AS record_size, (((4076 - 12) // g) * g)::BIGINT AS max_payload FROM (SELECT unnest(range(1, 33)) AS k) a, (SELECT unnest([1, 2, 4, 8]) AS g) b")
def fn_geometry(spark, sf_dir):
    """Largest value by key length and write unit, the size of a record with 100 bytes, and the largest payload."""
    grid = spark.range(1, 33).withColumnRenamed("id", "key_len").withColumn("gran", F.explode(F.array(*[F.lit(g) for g in (1, 2, 4, 8)])))
    k, g = F.col("key_len"), F.col("gran")
    return grid.select("key_len", "gran", (F.lit(4080 - 16) - S.align_up(k, g)).alias("max_value"), S.kv_record_size(k, F.lit(100), g).alias("record_size"), F.expr("4064 div gran * gran").alias("max_payload"))


@query("SELECT s AS sectors, CASE WHEN s >= 16 THEN 2 ELSE 1 END AS reserve, (s - CASE WHEN s >= 16 THEN 2 ELSE 1 END) * 4080 AS max_live, (s // 3 + 1) % s AS next, (s // 3 - 1 + s) % s AS prev FROM (SELECT unnest(range(3, 256)) AS s)")
def fn_ring(spark, sf_dir):
    s, at = F.col("id"), F.expr("id div 3")
    reserve = S.gc_reserve(s)
    return spark.range(3, 256).select(s.alias("sectors"), reserve.alias("reserve"), ((s - reserve) * 4080).alias("max_live"), S.ring_next(at, s).alias("next"), S.ring_prev(at, s).alias("prev"))


@query("SELECT n, CASE WHEN n BETWEEN 1 AND 32 THEN 'OK' WHEN n IN (0, 33) THEN 'TOO_LARGE' ELSE 'PARAM' END AS status FROM (SELECT unnest(range(0, 41)) AS n)")
def fn_key_status(spark, sf_dir):
    return spark.range(0, 41).select(F.col("id").alias("n"), S.key_status(F.encode(F.expr("repeat('k', cast(id AS int))"), "utf-8")).alias("status"))


@query("SELECT n, CASE WHEN n % 3 = 0 THEN n * 5 ELSE (4294967290 + n * 5) & 4294967295 END AS engine_time, CASE WHEN n % 3 = 0 THEN -1 ELSE (4294967290 + n * 5) & 4294967295 END AS tool_time FROM (SELECT unnest(range(0, 60)) AS n)")
def fn_absolute_time(spark, sf_dir):
    base = F.when(F.col("id") % 3 == 0, F.lit(0xFFFFFFFF)).otherwise(F.lit(4294967290))
    delta = F.col("id") * 5
    return spark.range(0, 60).select(F.col("id").alias("n"), S.absolute_time(base, delta).alias("engine_time"), F.coalesce(S.absolute_time(base, delta, engine=False), F.lit(-1)).alias("tool_time"))


@query("SELECT props AS s, lower(hex(encode(props[1:4]))) AS prefix FROM (SELECT DISTINCT props FROM events)")
def fn_hex_prefix(spark, sf_dir):
    return events(spark, sf_dir).select("props").distinct().select(F.col("props").alias("s"), S.hex_prefix(F.encode("props", "utf-8"), 4).alias("prefix"))


# ---- recovery


@query("WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 255 WHEN 1 THEN 252 ELSE 254 END AS state, event_id % 7 <> 0 AS ok FROM events), s AS (SELECT event_id, CASE WHEN state = 255 THEN CASE WHEN ok THEN 254 ELSE 252 END ELSE state END AS state FROM r) SELECT event_id, state, CASE state WHEN 254 THEN 'VALID' ELSE 'DEAD' END AS state_name FROM s")
def recover_writing(spark, sf_dir):
    k = F.col("event_id")
    state = F.when(k % 4 == 0, 255).when(k % 4 == 1, 252).otherwise(254)
    rows = events(spark, sf_dir).select("event_id", recover.settle(state, k % 7 != 0).alias("state"))
    return rows.select("event_id", "state", S.state_name(F.col("state")).alias("state_name"))


@query("WITH r AS (SELECT event_id, (4294966000 + event_id) & 4294967295 AS seq, user_id, CASE event_id % 4 WHEN 0 THEN 255 WHEN 1 THEN 252 ELSE 254 END AS state, event_id % 7 <> 0 AS ok FROM events), s AS (SELECT *, CASE WHEN state = 255 THEN CASE WHEN ok THEN 254 ELSE 252 END ELSE state END AS st FROM r), n AS (SELECT user_id, max(event_id) AS e FROM s WHERE st = 254 GROUP BY user_id) SELECT s.event_id AS \"offset\", CASE WHEN st = 254 AND s.event_id <> e THEN 252 ELSE st END AS state FROM s LEFT JOIN n USING (user_id)")
def recover_kv(spark, sf_dir):
    """Records whose sequence numbers pass the end of the counter."""
    k = F.col("event_id")
    log = events(spark, sf_dir).select(F.lit(0).alias("sector"), k.alias("offset"), (F.lit(4294966000) + k).bitwiseAND(F.lit(0xFFFFFFFF)).alias("seq"), F.col("user_id").alias("key"), F.when(k % 4 == 0, 255).when(k % 4 == 1, 252).otherwise(254).alias("state"), (k % 7 != 0).alias("crc_ok"))
    return recover.kv_recover(log).select("offset", "state")


# ---- metrics


@query("SELECT least((len - 1) // 102, 9)::INT AS bin, count(*) AS n FROM (SELECT 1 + event_id * 37 % 1023 AS len FROM events) GROUP BY 1")
def size_histogram_decile(spark, sf_dir):
    n = 1 + F.col("event_id") * 37 % 1023
    return events(spark, sf_dir).groupBy(metrics.deciles(n, 1023).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN len <= 32 THEN '<=32' WHEN len <= 256 THEN '<=256' WHEN len <= 1024 THEN '<=1024' WHEN len < 4062 THEN '<max' ELSE '=max' END AS class, count(*) AS n FROM (SELECT least(1 + event_id * 37 % 5000, 4062) AS len FROM events) GROUP BY 1")
def size_classes(spark, sf_dir):
    n = F.least(1 + F.col("event_id") * 37 % 5000, F.lit(4062))
    return events(spark, sf_dir).groupBy(metrics.size_class(n, 4062).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH s AS (SELECT event_type, greatest(1, ceil(value * 1000 / 1000))::BIGINT AS v FROM events) SELECT event_type, count(*) AS samples, (sum(v) // count(*))::BIGINT AS avg_us, min(v) AS min_us, max(v) AS max_us, list_sort(list(v))[count(*) * 95 // 100 + 1] AS p95_us, (count(*) * 1000000 // sum(v))::BIGINT AS ops_per_s FROM s GROUP BY event_type")
def bench_p95(spark, sf_dir):
    return metrics.latency(events(spark, sf_dir), "event_type", F.col("value") * 1000)


LIFE = "SELECT w AS writes_per_day, round(100000.0 * 16 * 4096 / (w * {waf} * {rec}), 6) AS days FROM (SELECT unnest([100, 1000, 10000, 100000]) AS w)"


def _life(spark: SparkSession, amplification, record: float) -> DataFrame:
    days = metrics.lifespan_days(F.lit(100000.0), F.lit(16), F.lit(4096), F.col("w"), amplification, F.lit(record))
    return spark.createDataFrame([(w,) for w in (100, 1000, 10000, 100000)], "w int").select(F.col("w").alias("writes_per_day"), F.round(days, 6).alias("days"))


@query(LIFE.format(waf="((0.75 * 2 + 0.25 * (3 + ceil(200 / 64.0))) * (1 + 0.5))", rec="38.0"))
def lifespan_kv(spark, sf_dir):
    return _life(spark, metrics.kv_amplification(F.lit(0.75), F.lit(0.25), F.lit(200.0), F.lit(64.0), F.lit(0.5)), 38.0)


@query(LIFE.format(waf="(0.75 * 2 + 0.25 * (2 + 2))", rec="32.0"))
def lifespan_ts(spark, sf_dir):
    return _life(spark, metrics.ts_amplification(F.lit(0.75), F.lit(0.25), F.lit(2)), 32.0)


@query("SELECT n AS payload, (4076 // (12 + n))::BIGINT AS per_sector, (4076 // (12 + n) * 800000)::BIGINT AS lifetime FROM (SELECT unnest([8, 128, 1023, 2032, 4064]) AS n)")
def capacity_projection(spark, sf_dir):
    rows = spark.createDataFrame([(n,) for n in (8, 128, 1023, 2032, 4064)], "payload int")
    each = metrics.per_sector(F.col("payload"), F.lit(4076))
    return rows.select("payload", each.cast("long").alias("per_sector"), (each * 800000).cast("long").alias("lifetime"))


@query(f"WITH {KV}, e AS (SELECT key, arg_max(value, seq) AS value FROM kv WHERE op = 'set' GROUP BY key), j AS (SELECT e.key AS ek, cur.key AS ck, e.value AS ev, cur.value AS cv FROM e FULL JOIN cur ON e.key = cur.key) SELECT CASE WHEN ck IS NULL THEN 'hidden' WHEN ek IS NULL THEN 'extra' WHEN ev = cv THEN 'equal' ELSE 'different' END AS outcome, count(*) AS n FROM j GROUP BY 1")
def mixed_workload_check(spark, sf_dir):
    """The last value set for each key against what is visible."""
    ops = kv_ops(spark, sf_dir)
    expected = ops.where("op = 'set'").groupBy("key").agg(F.max_by("value", "seq").alias("ev"))
    both = expected.withColumn("ek", F.lit(1)).join(kv.current(ops).select("key", F.col("value").alias("cv"), F.lit(1).alias("ck")), "key", "full_outer")
    outcome = F.when(F.col("ck").isNull(), "hidden").when(F.col("ek").isNull(), "extra").when(F.col("ev") == F.col("cv"), "equal").otherwise("different")
    return both.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
