"""Structured Streaming forms: timestamp repair with segment packing, and latest-wins upserts.

No watermark anywhere: late rows are re-stamped, not dropped.  Arrival order is carried in the data, since rows of a micro-batch come
in no order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import kv
from ..schema import G16, INVALID32, TIME_MAX, TS_RECORD_HEADER, Geometry

STAMPED = "series string, arrival long, epoch int, time long, sector long, offset long, status string"


def stamp(stream: DataFrame, geometry: Geometry = G16) -> DataFrame:
    """Each operation of a stream of TS_OPS with epoch, repaired time, sector, offset and status.

    The state of a series is its last time, epoch, sector and fill level.
    """
    cap, start, most, gran = geometry.ts_cap, geometry.ts_start, geometry.ts_max_data, geometry.gran

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, epoch, sector, fill = state.get if state.exists else (0, 0, 0, 0)
        rows = pd.concat(list(frames)).sort_values("arrival", kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            if r.op == "reset_epoch":
                last, epoch, sector, fill = 0, epoch + 1, sector + 1, 0
                continue
            n = len(r.data) if r.data is not None else None
            if n is None or not 1 <= n <= most:
                out.append((key[0], r.arrival, epoch, None, None, None, "PARAM" if n is None else "TOO_LARGE"))
                continue
            asked = 0 if pd.isna(r.req_time) else int(r.req_time)
            time = last + 1 if asked in (0, INVALID32) or asked <= last else asked
            if time > TIME_MAX:
                out.append((key[0], r.arrival, epoch, None, None, None, "TIME_EXHAUSTED"))
                continue
            size = TS_RECORD_HEADER + -(-n // gran) * gran
            if fill + size > cap:
                sector, fill = sector + 1, 0
            out.append((key[0], r.arrival, epoch, time, sector, start + fill, "OK"))
            last, fill = time, fill + size
        state.update((last, epoch, sector, fill))
        yield pd.DataFrame(out, columns=["series", "arrival", "epoch", "time", "sector", "offset", "status"]).astype({"time": "Int64", "sector": "Int64", "offset": "Int64"})

    return stream.groupBy("series").applyInPandasWithState(step, STAMPED, "last long, epoch int, sector long, fill long", "append", GroupStateTimeout.NoTimeout)


def upsert(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest operation of each key in generations of a Parquet table under path; each batch merges into the next one.

    A batch that is run again overwrites its own generation, so a restart changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = latest_generation(batch, path, number)
        now = batch if old is None else spark.read.schema(batch.schema).parquet(f"{path}/gen={old}").unionByName(batch)
        kv.newest(now).select(batch.columns).write.mode("overwrite").parquet(f"{path}/gen={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_generation(df: DataFrame, path: str, before: int | None = None) -> int | None:
    """The newest complete generation, older than `before`."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    done = [int(s.getPath().getName()[4:]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("gen=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max((n for n in done if before is None or n < before), default=None)


def read_current(df: DataFrame, path: str) -> DataFrame | None:
    """What readers see: the live keys of the newest generation."""
    n = latest_generation(df, path)
    return None if n is None else df.sparkSession.read.schema(df.schema).parquet(f"{path}/gen={n}").where(F.col("op") == "set")
