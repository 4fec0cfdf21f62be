"""Key-value operators: the latest version of each key over an upsert/delete log, lookups, and space accounting.

An operation log is (series, seq, op, key, value) with op 'set' or 'delete' and a sequence number that does not wrap (dumps
are unwrapped when they are read).  Keys are bytes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import key_status, kv_record_size
from ..schema import G16, VALUE_MAX, Geometry
from .packing import next_fit
from .prefix import CHUNK


def validated(ops: DataFrame, geometry: Geometry = G16) -> DataFrame:
    """Adds record_size and status (OK, PARAM, TOO_LARGE): rejected rows stay to be seen."""
    n = F.coalesce(F.length("value"), F.lit(0))
    size = kv_record_size(F.length("key"), n, geometry.gran)
    large = (n > VALUE_MAX) | (size > geometry.kv_cap)
    keyed = key_status(F.col("key"))
    return ops.withColumn("record_size", size.cast("int")).withColumn("status", F.when(keyed != "OK", keyed).when((F.col("op") == "set") & large, "TOO_LARGE").otherwise("OK"))


def newest(ops: DataFrame, keys: tuple[str, ...] = ("series", "key")) -> DataFrame:
    """The last operation of each key, deletes included: one partial aggregate, one shuffle of its result."""
    rest = [c for c in ops.columns if c not in keys]
    return ops.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(*keys, "r.*")


def current(ops: DataFrame, keys: tuple[str, ...] = ("series", "key")) -> DataFrame:
    """The visible version of each key."""
    return newest(ops, keys).where("op = 'set'")


def versions(ops: DataFrame) -> DataFrame:
    """Every set with `live`: whether it is the visible version of its key."""
    last = newest(ops).select("series", "key", F.col("seq").alias("last"), F.col("op").alias("last_op"))
    return ops.where("op = 'set'").join(last, ["series", "key"]).withColumn("live", (F.col("seq") == F.col("last")) & (F.col("last_op") == "set")).drop("last", "last_op")


def get(now: DataFrame, key: bytes, capacity: int | None = None) -> DataFrame:
    """(key, status, value, value_len) of one key of one store; a short buffer gets a prefix and TOO_LARGE, with the full length."""
    keys = now.sparkSession.createDataFrame([(bytearray(key),)], "key binary")
    return multi_get(now, keys, capacity)


def in_store(now: DataFrame, keys: DataFrame) -> tuple[DataFrame, list[str]]:
    """What to join keys on: store and key if the keys name their store, else the key (now is then a single store)."""
    on = ["series", "key"] if "series" in keys.columns else ["key"]
    return now.select(*on, "value"), on


def multi_get(now: DataFrame, keys: DataFrame, capacity: int | None = None) -> DataFrame:
    """The same for every row of keys (key binary, and series where now holds several stores); absent keys are NOT_FOUND, invalid
    ones PARAM or TOO_LARGE."""
    values, on = in_store(now, keys)
    return read(keys.join(values, on, "left"), capacity)


def read(found: DataFrame, capacity: int | None, crc_ok: Column | None = None) -> DataFrame:
    n = F.length("value")
    short = F.lit(False) if capacity is None else n > capacity
    bad = F.lit(False) if crc_ok is None else ~crc_ok
    keyed = key_status(F.col("key"))
    status = F.when(keyed != "OK", keyed).when(F.col("value").isNull(), "NOT_FOUND").when(bad, "CRC").when(short, "TOO_LARGE").otherwise("OK")
    value = F.col("value") if capacity is None else F.substring("value", 1, capacity)
    return found.select(*(["series"] if "series" in found.columns else []), "key", status.alias("status"), F.when(~bad, value).alias("value"), n.alias("value_len"))


def exists(now: DataFrame, keys: DataFrame) -> DataFrame:
    """Those of keys that are present."""
    values, on = in_store(now, keys)
    return keys.join(values, on, "left_semi")


def place(ops: DataFrame, geometry: Geometry = G16, chunk: int = CHUNK) -> DataFrame:
    """Adds sector and offset to sets: a record that does not fit the rest of the sector opens the next one."""
    sets = validated(ops, geometry).where("op = 'set' AND status = 'OK'").drop("status").withColumn("epoch", F.lit(0))
    return next_fit(sets, "seq", "record_size", geometry.kv_cap, geometry.kv_start, chunk).drop("epoch")


def page(now: DataFrame, after: tuple[int, int] | None, n: int, key_capacity: int = 33, value_capacity: int | None = None) -> DataFrame:
    """The next n live records of one store in physical order after a (sector, offset); keys and values cut to the caller's buffers."""
    rows = now if after is None else now.where((F.col("sector") > after[0]) | ((F.col("sector") == after[0]) & (F.col("offset") > after[1])))
    value = F.col("value") if value_capacity is None else F.substring("value", 1, value_capacity)
    return rows.orderBy("sector", "offset").limit(n).select("sector", "offset", F.substring("key", 1, key_capacity - 1).alias("key"), value.alias("value"))


def generation(ops: DataFrame) -> DataFrame:
    """series, generation: the number of changes so far.  An iterator notes it, and is out of date once it has moved."""
    return ops.groupBy("series").agg(F.count(F.lit(1)).alias("generation"))


def next_page(ops: DataFrame, now: DataFrame, noted: int, after: tuple[int, int] | None, n: int, **cut) -> tuple[str, DataFrame]:
    """(status, page) of an iterator that noted a generation: BUSY and no rows if the store has changed since, ITER_END past the last record."""
    row = generation(ops).agg(F.sum("generation").alias("g")).first()
    if (row["g"] or 0) != noted:
        return "BUSY", page(now, after, 0, **cut)
    rows = page(now, after, n, **cut)
    return ("ITER_END" if rows.isEmpty() else "OK"), rows


def sector_bytes(laid: DataFrame) -> DataFrame:
    """live_bytes, garbage_bytes and write_off of each sector of placed versions (with `live`)."""
    size = F.col("record_size")
    return laid.groupBy("series", "sector").agg(F.sum(F.when(F.col("live"), size).otherwise(0)).alias("live_bytes"), F.sum(F.when(~F.col("live"), size).otherwise(0)).alias("garbage_bytes"), F.max(F.col("offset") + size).alias("write_off"))


def space(now: DataFrame, geometry: Geometry = G16) -> DataFrame:
    """total, used and available bytes; used is never above the total."""
    total = geometry.kv_max_live
    used = F.least(F.coalesce(F.sum("record_size"), F.lit(0)), F.lit(total))
    return now.agg(used.cast("long").alias("used")).select(F.lit(total).cast("long").alias("total"), "used", (F.lit(total) - F.col("used")).cast("long").alias("available"))


def wear(sectors: DataFrame) -> DataFrame:
    """Least, greatest and mean (rounded down) erase count, and the spread."""
    e = F.col("erase_cnt")
    return sectors.agg(F.min(e).alias("min_erase"), F.max(e).alias("max_erase"), F.expr("sum(erase_cnt) div count(1)").alias("avg_erase"), (F.max(e) - F.min(e)).alias("spread"))


def admit(ops: DataFrame, geometry: Geometry = G16) -> DataFrame:
    """Status of each operation of a store in order, FULL included: a set is refused if the live bytes would pass the limit.

    Whether one set fits depends on all before it, so a store is one ordered fold; stores run in parallel.
    """
    most, gran = geometry.kv_max_live, geometry.gran
    up = lambda n: -(-n // gran) * gran

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict[bytes, int] = {}
        live, out = 0, []
        for row in pdf.sort_values("seq").itertuples(index=False):
            key = bytes(row.key)
            if row.status != "OK":
                out.append(row.status)
            elif row.op == "delete":
                out.append("OK" if key in held else "NOT_FOUND")
                live -= held.pop(key, 0)
            else:
                need, old = 16 + up(len(key)) + up(len(row.value or b"")), held.get(key, 0)
                if max(live - old, 0) + need > most:
                    out.append("FULL")
                else:
                    out.append("OK")
                    held[key], live = need, live - old + need
        return pd.DataFrame({"series": pdf["series"], "seq": pdf.sort_values("seq")["seq"].to_numpy(), "status": out})

    return validated(ops, geometry).select("series", "seq", "op", "key", "value", "status").groupBy("series").applyInPandas(fold, "series string, seq long, status string")
