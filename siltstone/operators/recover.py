"""Recovery as pure transformations of parsed records and sector headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import DEAD, G16, INVALID32, VALID, WRITING, Geometry


def settle(state: Column, crc_ok: Column) -> Column:
    """A write that was cut off counts if its checksum holds, and is dead if not."""
    return F.when(state == WRITING, F.when(crc_ok, VALID).otherwise(DEAD)).otherwise(state)


def kv_status(magic_ok: Column, crc_ok: Column, erased: Column, last: Column) -> Column:
    """Status of a key-value sector; `last`: it has the highest creation number, so it may be written on."""
    return F.when(erased, "ERASED").when(~magic_ok | ~crc_ok, "CORRUPT").when(last, "ACTIVE").otherwise("SEALED")


def ts_status(magic_ok: Column, erased: Column, sealed_crc_ok: Column, count: Column, end_off: Column) -> Column:
    """EMPTY, CORRUPT, SEALED, or ACTIVE (a bad seal leaves a sector active)."""
    return F.when(erased, "EMPTY").when(~magic_ok, "CORRUPT").when(sealed_crc_ok & (count != 0xFFFF) & (end_off != 0xFFFF), "SEALED").otherwise("ACTIVE")


def unwrap(df: DataFrame, seq: str = "seq", out: str = "seq64") -> DataFrame:
    """Sequence numbers of a wrapping 32-bit counter in one order: by the distance from the oldest.

    At most half of the range is in use at a time, so if numbers lie in both outer quarters, the low ones are the later.
    """
    ends = df.agg(F.min(seq).alias("_a"), F.max(seq).alias("_b"))
    wrapped = (F.col("_b") - F.col("_a") > 0x7FFFFFFF) & (F.col(seq) < 0x80000000)
    return df.crossJoin(F.broadcast(ends)).withColumn(out, F.when(wrapped, F.col(seq) + (1 << 32)).otherwise(F.col(seq))).drop("_a", "_b")


def kv_recover(log: DataFrame) -> DataFrame:
    """The records after start-up: cut-off writes settled, and of the valid versions of a key all but the newest dead."""
    settled = unwrap(log.withColumn("state", settle(F.col("state"), F.col("crc_ok"))))
    newest = settled.where(F.col("state") == VALID).groupBy("key").agg(F.max(F.struct("seq64", "sector", "offset")).alias("newest"))
    out = settled.join(newest, "key", "left")
    stale = (F.col("state") == VALID) & (F.struct("seq64", "sector", "offset") != F.col("newest"))
    return out.withColumn("state", F.when(stale, DEAD).otherwise(F.col("state"))).drop("newest", "seq64")


def kv_sectors(log: DataFrame) -> DataFrame:
    """live_bytes and garbage_bytes of each sector of recovered records; cut-off writes count as neither."""
    size = F.col("record_size")
    return log.groupBy("sector").agg(F.sum(F.when(F.col("state") == VALID, size).otherwise(0)).alias("live_bytes"), F.sum(F.when(F.col("state") == DEAD, size).otherwise(0)).alias("garbage_bytes"), F.max(F.col("offset") + size).alias("write_off"))


def ts_recover(log: DataFrame, sectors: DataFrame) -> DataFrame:
    """Records by ring position (`ring_pos` from the tail): corrupt sectors out, cut-off writes of the head sector settled, base added.

    sectors: (sector, status, seq, time_base) with a 16-bit sequence number that wraps.
    """
    ring = sectors.where("status IN ('SEALED', 'ACTIVE')")
    ends = ring.agg(F.min("seq").alias("_a"), F.max("seq").alias("_b"))
    at = F.when((F.col("_b") - F.col("_a") > 0x7FFF) & (F.col("seq") < 0x8000), F.col("seq") + 0x10000).otherwise(F.col("seq"))
    # as many rows as the partition has sectors: 255 at most
    ring = ring.crossJoin(F.broadcast(ends)).withColumn("_at", at)
    ring = ring.withColumn("ring_pos", F.row_number().over(W.orderBy("_at", "sector")) - 1).withColumn("head", F.col("_at") == F.max("_at").over(W.partitionBy()))
    rows = log.drop("time_base", "time").join(F.broadcast(ring.select("sector", "ring_pos", "head", "time_base")), "sector")
    state = F.when(F.col("head"), settle(F.col("state"), F.col("crc_ok"))).otherwise(F.col("state"))
    time = F.when(F.col("time_base") == INVALID32, F.col("time_delta")).otherwise((F.col("time_base") + F.col("time_delta")).bitwiseAND(F.lit(0xFFFFFFFF)))
    return rows.withColumn("state", state).withColumn("time", time)


def kv_start(log: DataFrame, sectors: DataFrame, geometry: Geometry = G16) -> tuple[DataFrame, DataFrame]:
    """Start-up of a key-value store: (records, sectors).

    log: parsed records (sector, offset within it, state, crc_ok, seq, key, record_size); sectors: one row for each of the partition's
    sectors (sector, magic_ok, crc_ok, erased, erase_cnt, create_seq).  Corrupt sectors lose their records and are erased once more; the sector
    with the highest creation number that still has room is written on (without one, that with the highest number), others with
    records are sealed.
    """
    corrupt = ~F.col("erased") & ~(F.col("magic_ok") & F.col("crc_ok"))
    heads = sectors.withColumn("corrupt", corrupt)
    kept = log.join(F.broadcast(heads.where("NOT erased AND NOT corrupt").select("sector")), "sector", "left_semi")  # 255 sectors at most
    records = kv_recover(kept)
    used = heads.join(kv_sectors(records), "sector", "left").withColumn("write_off", F.coalesce(F.col("write_off"), F.lit(geometry.kv_start)).cast("long"))
    mine = ~F.col("erased") & ~F.col("corrupt")
    ends = used.where(mine).agg(F.min("create_seq").alias("_a"), F.max("create_seq").alias("_b"))
    at = F.when((F.col("_b") - F.col("_a") > 0x7FFFFFFF) & (F.col("create_seq") < 0x80000000), F.col("create_seq") + (1 << 32)).otherwise(F.col("create_seq"))
    used = used.crossJoin(F.broadcast(ends)).withColumn("_at", F.when(mine, at))
    best = used.agg(F.max(F.when(mine, F.struct((F.col("write_off") < geometry.sector_size).alias("room"), "_at", (-F.col("sector")).alias("s")))).alias("best"))
    used = used.crossJoin(F.broadcast(best))  # one row each
    status = F.when(F.col("erased") | F.col("corrupt"), "ERASED").when(F.col("sector") == -F.col("best.s"), "ACTIVE").when(F.col("write_off") > geometry.kv_start, "SEALED").otherwise("ACTIVE")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = used.select("sector", status.alias("status"), (F.col("erase_cnt") + F.col("corrupt").cast("int")).cast("long").alias("erase_cnt"), F.when(mine, F.col("create_seq")).otherwise(F.lit(0)).cast("long").alias("create_seq"), zero("garbage_bytes"), zero("live_bytes"), F.when(mine, F.col("write_off")).otherwise(F.lit(geometry.kv_start)).cast("long").alias("write_off"))
    return records, out


def ts_start(log: DataFrame, sectors: DataFrame) -> DataFrame:
    """Start-up of a time series, as one row: head, tail, total_count, last_time, data_gaps, and whether it must be formatted.

    sectors: (sector, status of ts_status, seq, time_base, count); log: records of the sectors (sector, offset, state, crc_ok, time_base,
    time_delta).  The head has the highest sequence number on the wrapping counter, the tail the lowest; a sealed body sector
    counts as its header says, the others by their valid records.
    """
    n = sectors.select(F.count(F.lit(1)).alias("_n"))
    rows = ts_recover(log, sectors)
    ring = sectors.where("status IN ('SEALED', 'ACTIVE')")
    ends = ring.agg(F.min("seq").alias("_a"), F.max("seq").alias("_b"))
    at = F.when((F.col("_b") - F.col("_a") > 0x7FFF) & (F.col("seq") < 0x8000), F.col("seq") + 0x10000).otherwise(F.col("seq"))
    placed = ring.crossJoin(F.broadcast(ends)).withColumn("_at", at)
    two = placed.agg(F.max_by("sector", F.struct("_at", -F.col("sector"))).alias("head"), F.min_by("sector", F.struct("_at", "sector")).alias("tail"))
    counts = rows.groupBy("sector").agg(F.count(F.when(F.col("state") == VALID, 1)).alias("found"), F.max(F.when(F.col("state") == VALID, F.col("time"))).alias("_time"))
    every = sectors.join(counts, "sector", "left").crossJoin(F.broadcast(two.crossJoin(n)))  # one row
    # physical order around the ring, from the tail to the head
    every = every.withColumn("ring_pos", F.pmod(F.col("sector") - F.col("tail"), F.col("_n"))).where("ring_pos <= pmod(head - tail, _n)")
    each = F.when((F.col("status") == "SEALED") & (F.col("sector") != F.col("head")), F.col("count")).when(F.col("status").isin("SEALED", "ACTIVE"), F.coalesce("found", F.lit(0))).otherwise(0)
    from .ts import gaps

    found = every.agg(F.max("head").alias("head"), F.max("tail").alias("tail"), F.sum(each).cast("long").alias("total_count"), F.max(F.when(F.col("sector") == F.col("head"), F.col("_time"))).alias("_last"), F.max("_time").alias("_any"))
    lost = gaps(every.where("status <> 'CORRUPT'").select(F.lit("s").alias("series"), "ring_pos", "seq", "status")).select("data_gaps")
    last = F.coalesce(F.col("_last"), F.col("_any"), F.lit(0))  # the head's, else the greatest of all
    return found.crossJoin(F.broadcast(lost)).select("head", "tail", "total_count", last.cast("long").alias("last_time"), "data_gaps", F.col("head").isNull().alias("format"))


def formatted(sectors: DataFrame, kind: str = "kvdb", geometry: Geometry = G16) -> DataFrame:
    """The sectors after formatting: all erased once more (wear is kept), the first one opened with the first number."""
    first = F.col("sector") == 0
    opened = F.when(first, F.lit(1)).otherwise(F.lit(0)).cast("long")
    start = geometry.kv_start if kind == "kvdb" else geometry.ts_start
    return sectors.select("sector", F.when(first, "ACTIVE").otherwise("ERASED" if kind == "kvdb" else "EMPTY").alias("status"), (F.coalesce("erase_cnt", F.lit(0)) + 1).cast("long").alias("erase_cnt"), opened.alias("create_seq"), F.lit(0).cast("long").alias("garbage_bytes"), F.lit(start).cast("long").alias("write_off"))
