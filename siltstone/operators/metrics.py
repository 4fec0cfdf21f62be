"""Counters, histograms, latency statistics, and the lifespan and capacity arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import align_up


def latency(df: DataFrame, group: str, ns: Column) -> DataFrame:
    """samples, avg, min, max, p95 (the sorted sample at floor(0.95 n)) in whole microseconds, at least 1, and operations a second.

    Equal samples are counted first, so a group of any size is a row for each distinct sample; no group is sorted as a whole.
    """
    counts = df.select(group, F.greatest(F.lit(1), F.ceil(ns / 1000)).cast("long").alias("v")).groupBy(group, "v").agg(F.count(F.lit(1)).alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(W.partitionBy(group).orderBy("v")))
    total = upto.groupBy(group).agg(F.sum("c").alias("samples"), F.sum(F.col("c") * F.col("v")).alias("sum"), F.min("v").alias("min_us"), F.max("v").alias("max_us"))
    p95 = upto.join(total.select(group, "samples"), group).where(F.col("upto") > F.expr("samples * 95 div 100")).groupBy(group).agg(F.min("v").alias("p95_us"))
    return total.join(p95, group).select(group, "samples", F.expr("sum div samples").alias("avg_us"), "min_us", "max_us", "p95_us", F.expr("samples * 1000000 div sum").alias("ops_per_s"))


KV_COUNTERS = ("read_ops", "write_ops", "delete_ops", "gc_runs", "gc_reclaimed_bytes", "gc_migrated_recs", "flash_errors", "crc_errors", "corrupt_sectors")
TS_COUNTERS = ("write_ops", "read_ops", "sector_rotations", "records_lost", "flash_errors", "crc_errors", "data_gaps")


def counters(events: DataFrame, names: tuple[str, ...], since: Column | None = None) -> DataFrame:
    """series and a column for each counter, from events (series, at, counter, amount).

    A reset is an event of counter 'reset': only what comes after a series' last one counts.  since: a condition on events instead.
    """
    if since is None:
        last = events.groupBy("series").agg(F.max(F.when(F.col("counter") == "reset", F.col("at"))).alias("_reset"))
        counted = events.join(last, "series").where("_reset IS NULL OR at > _reset")
        every = last.select("series")
    else:
        counted, every = events.where(since), events.select("series").distinct()
    sums = counted.groupBy("series").agg(*[F.sum(F.when(F.col("counter") == c, F.col("amount"))).alias(c) for c in names])
    return every.join(sums, "series", "left").select("series", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])


def deciles(value: Column, most: int) -> Column:
    """Bin 0 to 9 of a size from 1 to most."""
    width = max(1, most // 10)
    return F.least(F.floor((value - 1) / width), F.lit(9)).cast("int")


def size_class(value: Column, most: int) -> Column:
    return F.when(value <= 32, "<=32").when(value <= 256, "<=256").when(value <= 1024, "<=1024").when(value < most, "<max").otherwise("=max")


def usage(sectors: DataFrame, sector_size: int) -> DataFrame:
    """Used and garbage share in whole per cent, and free bytes, of each sector."""
    return sectors.select("sector", F.expr(f"write_off * 100 div {sector_size}").alias("used_pct"), F.expr("CASE WHEN write_off > 0 THEN garbage_bytes * 100 div write_off ELSE 0 END").alias("garbage_pct"), (F.lit(sector_size) - F.col("write_off")).alias("free_bytes"))


def kv_amplification(small: Column, large: Column, value: Column, sector: Column, gc: Column) -> Column:
    """(small * 2 + large * (3 + ceil(value / sector))) * (1 + gc)."""
    return (small * 2 + large * (3 + F.ceil(value / sector))) * (1 + gc)


def ts_amplification(small: Column, large: Column, pieces: Column) -> Column:
    return small * 2 + large * (2 + pieces)


def lifespan_days(cycles: Column, sectors: Column, size: Column, writes: Column, amplification: Column, record: Column) -> Column:
    return cycles * sectors * size / (writes * amplification * record)


def per_sector(data_len: Column, cap: Column, gran: int = 1) -> Column:
    return F.floor(cap / (12 + align_up(data_len, gran)))
