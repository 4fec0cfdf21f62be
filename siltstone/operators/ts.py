"""Time-series operators: timestamp repair, epochs, segment packing, ring retention and the reads over them.

An append log is (series, arrival, op, req_time, data); arrival is an integer that rises with time of arrival.  Results are
positional: order is (sector, offset), never time, since time restarts with each epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import G16, INVALID32, TIME_MAX, TS_RECORD_HEADER, VALID, Geometry
from .packing import next_fit
from .prefix import CHUNK, running_sum


def epochs(ops: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds `epoch`: how many resets came before (a reset row opens its own epoch)."""
    marked = ops.withColumn("_r", (F.col("op") == "reset_epoch").cast("int"))
    return running_sum(marked, ["series"], "arrival", "_r", "epoch", chunk).drop("_r").withColumn("epoch", F.col("epoch").cast("int"))


def length_status(data: Column, geometry: Geometry) -> Column:
    n = F.length(data)
    return F.when(n.isNull(), "PARAM").when(n.between(1, geometry.ts_max_data), "OK").otherwise("TOO_LARGE")


def repair(ops: DataFrame, geometry: Geometry = G16, chunk: int = CHUNK) -> DataFrame:
    """Adds `time` and `status` to appends: a time that is unset or not after the last one becomes the last one plus one.

    In closed form the i-th accepted append of an epoch gets i + max(0, max over j <= i of (t_j - j)).  Rows that would pass the
    last time are TIME_EXHAUSTED and change nothing.  Nothing is dropped for being late.
    """
    if "epoch" not in ops.columns:
        ops = ops.withColumn("epoch", F.lit(0))
    rows = ops.where("op = 'append'").withColumn("status", length_status(F.col("data"), geometry))
    fine = rows.where("status = 'OK'").withColumn("_c", F.expr(f"arrival div {chunk}"))
    keys = ["series", "epoch"]
    w = W.partitionBy(*keys, "_c").orderBy("arrival").rowsBetween(W.unboundedPreceding, 0)
    unset = F.col("req_time").isNull() | F.col("req_time").isin(0, INVALID32)
    fine = fine.withColumn("_i", F.row_number().over(w).cast("long"))
    fine = fine.withColumn("_d", F.when(~unset, F.col("req_time") - F.col("_i")))
    per = fine.groupBy(*keys, "_c").agg(F.max("_i").alias("_n"), F.max("_d").alias("_m"))
    v = W.partitionBy(*keys).orderBy("_c")
    per = per.withColumn("_off", F.sum("_n").over(v) - F.col("_n"))
    per = per.withColumn("_lead", F.max(F.col("_m") - F.col("_off")).over(v.rowsBetween(W.unboundedPreceding, -1)))
    fine = fine.withColumn("_in", F.max("_d").over(w)).join(per.select(*keys, "_c", "_off", "_lead"), [*keys, "_c"])
    lead = F.greatest(F.lit(0), F.col("_lead"), F.col("_in") - F.col("_off"))
    fine = fine.withColumn("time", F.col("_i") + F.col("_off") + lead)
    fine = fine.withColumn("status", F.when(F.col("time") > TIME_MAX, "TIME_EXHAUSTED").otherwise("OK")).withColumn("time", F.when(F.col("time") <= TIME_MAX, F.col("time")))
    fine = fine.drop("_c", "_i", "_d", "_in", "_off", "_lead")
    return fine.unionByName(rows.where("status <> 'OK'").withColumn("time", F.lit(None).cast("long")))


def time_range(df: DataFrame, start: int, stop: int, column: str = "time") -> DataFrame:
    """Rows with start <= time <= stop; a stop of 0 is the last time; an empty range has no rows."""
    return df.where(F.col(column).between(start, stop or TIME_MAX))


def pack_fixed(log: DataFrame, data_len: int, geometry: Geometry = G16, chunk: int = CHUNK) -> DataFrame:
    """Adds sector and offset where all payloads have one size: a sector holds a fixed number of records."""
    size = TS_RECORD_HEADER + -(-data_len // geometry.gran) * geometry.gran
    each = geometry.ts_cap // size
    numbered = running_sum(log.withColumn("_1", F.lit(1)), ["series"], "arrival", "_1", "_i", chunk)
    i = F.col("_i") - 1
    return numbered.withColumn("sector", F.floor(i / each)).withColumn("offset", geometry.ts_start + (i % each) * size).drop("_1", "_i").withColumn("record_size", F.lit(size))


def pack_next_fit(log: DataFrame, geometry: Geometry = G16, chunk: int = CHUNK) -> DataFrame:
    """Adds record_size, sector and offset: a record opens a sector when it does not fit the current one; so does each epoch."""
    if "epoch" not in log.columns:
        log = log.withColumn("epoch", F.lit(0))
    gran = geometry.gran
    sized = log.withColumn("record_size", (F.lit(TS_RECORD_HEADER) + F.ceil(F.length("data") / gran) * gran).cast("int"))
    return next_fit(sized, "arrival", "record_size", geometry.ts_cap, geometry.ts_start, chunk)


def retain(log: DataFrame, sectors: int) -> DataFrame:
    """The ring: records of the last `sectors` sectors of their series."""
    head = log.groupBy("series").agg(F.max("sector").alias("_head"))
    return log.join(head, "series").where(F.col("sector") > F.col("_head") - sectors).drop("_head")


def lost(log: DataFrame, sectors: int) -> DataFrame:
    """series, rotations, records_lost: how often a sector was opened, and what the evicted ones held."""
    head = log.groupBy("series").agg(F.max("sector").alias("head"))
    gone = F.count(F.when(F.col("sector") <= F.col("head") - sectors, 1))
    return log.join(head, "series").groupBy("series").agg(F.max("head").alias("rotations"), gone.alias("records_lost"))


def sector_stats(log: DataFrame) -> DataFrame:
    """Records, bytes, first and last time, base and end offset of each sector."""
    return log.groupBy("series", "sector").agg(F.count(F.lit(1)).alias("records"), F.sum("record_size").alias("bytes"), F.min_by("time", "offset").alias("time_base"), F.max_by("time", "offset").alias("last_time"), F.max(F.col("offset") + F.col("record_size")).alias("end_off"))


def place() -> Column:
    return F.struct("sector", "offset")


def latest(log: DataFrame) -> DataFrame:
    """The last record by position of each series (not the one with the greatest time)."""
    return log.groupBy("series").agg(F.max_by(F.struct("time", "data", "sector", "offset", *(["crc_ok"] if "crc_ok" in log.columns else [])), place()).alias("r")).select("series", "r.*")


def oldest(log: DataFrame) -> DataFrame:
    return log.groupBy("series").agg(F.min_by(F.struct("time", "data", "sector", "offset", *(["crc_ok"] if "crc_ok" in log.columns else [])), place()).alias("r")).select("series", "r.*")


def read_one(series: DataFrame, found: DataFrame, buffer: int) -> DataFrame:
    """(series, status, time, data, data_len) of latest or oldest for every asked series: NOT_FOUND without a record, CRC (no bytes) where
    `crc_ok` fails, TOO_LARGE with the bytes that fit the buffer."""
    rows = series.select("series").distinct().join(found, "series", "left")
    bad = ~F.coalesce(F.col("crc_ok"), F.lit(True))
    n = F.length("data")
    status = F.when(F.col("data").isNull(), "NOT_FOUND").when(bad, "CRC").when(n > buffer, "TOO_LARGE").otherwise("OK")
    return rows.select("series", status.alias("status"), F.when(~bad, F.col("time")).alias("time"), F.when(~bad, F.substring("data", 1, buffer)).alias("data"), n.alias("data_len"))


def read_status(buffer: int, length: Column, crc_ok: Column) -> Column:
    """Status of a read into a buffer: CRC before TOO_LARGE."""
    return F.when(~crc_ok, "CRC").when(length > buffer, "TOO_LARGE").otherwise("OK")


def span(log: DataFrame, series: DataFrame | None = None) -> DataFrame:
    """series, oldest and newest time by position; both are INVALID32 for a series (of the given ones) that holds no record."""
    found = log.groupBy("series").agg(F.min_by("time", place()).alias("oldest"), F.max_by("time", place()).alias("newest"))
    if series is not None:
        found = series.select("series").distinct().join(found, "series", "left")
    none = F.lit(INVALID32).cast("long")
    return found.select("series", F.coalesce("oldest", none).alias("oldest"), F.coalesce("newest", none).alias("newest"))


def count_valid(log: DataFrame) -> DataFrame:
    """Retained records in state VALID, bad checksums included."""
    return log.groupBy("series").agg(F.count(F.when(F.col("state") == VALID, 1)).alias("records"))


def payload(data: Column, buffer: int, crc_ok: Column) -> Column:
    """What a query hands over: the bytes if they fit 64 bytes or the caller's buffer, null if not or if the checksum fails."""
    return F.when(crc_ok & (F.length(data) <= max(64, buffer)), data)


def gaps(sectors: DataFrame, order: str = "ring_pos", seq: str = "seq") -> DataFrame:
    """series, data_gaps: empty sectors and falling sequence numbers from tail to head."""
    w = W.partitionBy("series").orderBy(order)
    step = sectors.withColumn("_last", F.last(F.when(F.col("status") != "EMPTY", F.col(seq)), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    back = (F.col("_last") - F.col(seq)).bitwiseAND(F.lit(0xFFFF)).between(1, 0x7FFF)
    return step.groupBy("series").agg(F.count(F.when((F.col("status") == "EMPTY") | back, 1)).alias("data_gaps"))


def role(sector: Column, head: Column, tail: Column) -> Column:
    """HEAD, HEAD+TL, TAIL, DATA or FREE on the ring from tail to head."""
    inside = F.when(tail <= head, sector.between(tail, head)).otherwise((sector >= tail) | (sector <= head))
    return F.when((sector == head) & (sector == tail), "HEAD+TL").when(sector == head, "HEAD").when(sector == tail, "TAIL").when(inside, "DATA").otherwise("FREE")


def take(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows of each series by position: a callback that stops after n."""
    at = F.row_number().over(W.partitionBy("series").orderBy("sector", "offset"))
    return rows.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")  # Spark keeps n rows of each partition before it shuffles


