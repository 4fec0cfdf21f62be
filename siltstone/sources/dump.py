"""Raw storage images as DataFrames: sectors, records, current state and anomalies.

An image is a file, or a folder of pieces that follow each other by name (`pieces`).  It is read by Spark's binaryFile source, so any path
that Spark reads will do, and is cut into sectors that are dealt to all tasks; records are chained only within a sector.  The one Python step finds where records begin and end (`layout.spans`) and sums
their payloads up; every field, status, check and anomaly is a Column expression over the header's bytes.
"""

from __future__ import annotations

import itertools
import json
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import crc16_many, hex_prefix, little_endian, lower_hex, state_name
from ..schema import INVALID32, VALID, VALUE_MAX
from . import pieces
from .layout import LAYOUTS, TS, Layout, checked, spans

SPANS = "sector int, type string, at int, until int, head binary, first binary, second binary, calc int, blank boolean, base long"

#: Sectors that a task gives on at once.
SECTORS = 256


@dataclass(frozen=True)
class Image:
    """Where an image is and how it is laid out.  base_addr is where the partition begins on its device: offsets do not contain it."""

    path: str
    kind: str = "auto"
    sector_size: int = 4096
    write_gran: int = 0
    base_addr: int = 0
    total_size: int | None = None


def from_manifest(spark: SparkSession, manifest: str, **overrides) -> Image:
    """An image from a JSON manifest (kind, input or input_path, sector_size, write_gran, base_addr, total_size); arguments win.

    A relative input is taken from the manifest's folder.
    """
    fields = json.loads("\n".join(r["value"] for r in spark.read.text(manifest, wholetext=True).collect()))
    number = lambda v: int(v, 0) if isinstance(v, str) else v
    path = fields.get("input") or fields.get("input_path", "")
    if not path and not overrides.get("path"):
        raise ValueError("an image needs an input path")
    if path and "://" not in path and not path.startswith("/"):
        path = f"{manifest.rsplit('/', 1)[0]}/{path}" if "/" in manifest else path
    made = Image(path, str(fields.get("kind", "auto")).lower(), *(number(fields.get(k, d)) for k, d in (("sector_size", 4096), ("write_gran", 0), ("base_addr", 0), ("total_size", None))))
    return replace(made, **{k: v for k, v in overrides.items() if v is not None})


def sectors(spark: SparkSession, image: Image) -> DataFrame:
    """(sector, raw): the image cut into sectors, as many as its total size says, in many tasks.

    Pieces are cut where they are read, a view of their bytes for each sector (a substring in the JVM would copy the piece each time); a
    single file's sectors are dealt to as many tasks as Spark shuffles to.
    """
    held = pieces.lengths(spark, image.path)
    total, size = sum(n for _, n in held) if image.total_size is None else image.total_size, image.sector_size
    if odd := [path for path, n in held[:-1] if n % size]:
        raise ValueError(f"{odd[0]} is not the last piece and does not end with a sector")
    firsts = [*itertools.accumulate((n // size for _, n in held[:-1]), initial=0), total // size]
    firsts = [min(first, total // size) for first in firsts]  # the last piece has what is missing of the total, as short sectors
    places = {path: (first, until) for (path, _), first, until in zip(held, firsts, firsts[1:])}  # a few bytes for each piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                (first, until), raw = places[path], memoryview(content.as_buffer())
                for k in range(first, until, SECTORS):
                    some = range(k, min(k + SECTORS, until))
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([bytes(raw[(i - first) * size : (i - first + 1) * size]) for i in some], pa.binary())], ["sector", "raw"])

    cut = spark.read.format("binaryFile").load(image.path).select("path", "content").mapInArrow(run, "sector int, raw binary")
    return cut if len(held) > 1 else cut.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sector")


def made(rows: DataFrame, payload: tuple[str, ...], build: Callable[[int, list[dict]], bytes]) -> DataFrame:
    """(sector, raw) of records (sector, offset, ...): build makes a sector's bytes from its number and its records by offset.

    Each record also has `crc`, the checksum of its payload columns.  Sectors stream through their tasks one after another.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            held = batch.to_pylist()
            for row, crc in zip(held, crc16_many([b"".join(row[c] for c in payload) for row in held]).tolist()):
                row["crc"] = crc
                yield row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((sector, build(sector, list(group))) for sector, group in itertools.groupby(records(batches), key=lambda row: row["sector"]))
        for some in itertools.batched(each, SECTORS):
            sector, raw = zip(*some)
            yield pa.RecordBatch.from_arrays([pa.array(sector, pa.int32()), pa.array(raw, pa.binary())], ["sector", "raw"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "sector").sortWithinPartitions("sector", "offset").mapInArrow(run, "sector int, raw binary")


def total_size(spark: SparkSession, path: str) -> int:
    """Bytes of an image, all pieces."""
    return spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]  # Spark lists no empty file


def checked_size(spark: SparkSession, image: Image, size: int) -> Image:
    """The image, if it is exactly as large as the partition that it is loaded into; else an error."""
    found = total_size(spark, image.path)
    if found != size:
        raise ValueError(f"{image.path} holds {found} bytes, the partition {size}")
    return image


def save(cut: DataFrame, path: str, sector_size: int = 4096) -> None:
    """Write sectors (sector, raw) as an image in pieces, by all tasks; sectors are numbered from 0 on."""
    each = max(1, pieces.PIECE // sector_size)
    part = F.coalesce(F.expr(f"sector div {each}"), F.lit(0)).cast("long")
    dealt = cut.withColumn("part", part).repartition(int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part", "sector")
    pieces.save(dealt.select("part", "raw"), path)


def kinds(cut: DataFrame) -> DataFrame:
    """One row: how many sectors show each kind's magic number."""
    head = F.substring("raw", 1, 4)
    return cut.agg(*[F.count(F.when(head == F.lit(bytearray(struct.pack("<I", layout.magic))), 1)).alias(kind) for kind, layout in LAYOUTS.items()])


def detect(spark: SparkSession, image: Image) -> str:
    """The kind by the sectors' magic numbers; key-value on a tie; an error if there is none."""
    if image.kind != "auto":
        return image.kind
    votes = kinds(sectors(spark, image)).first().asDict()
    if not any(votes.values()):
        raise ValueError(f"no known sector in {image.path}")
    return max(LAYOUTS, key=lambda kind: votes[kind])


def find_spans(cut: DataFrame, layout: Layout, sector_size: int, gran: int, engine: bool = False) -> DataFrame:
    """SPANS of every sector (sector, raw): its header and what stands in it."""
    wanted = layout.least_header or sector_size
    count_at, end_at, base_at = (layout.positions("header").get(c, (0, 0))[0] for c in ("count", "end_off", "time_base"))

    def of_sector(sector: int, raw: bytes, header_crc: int) -> Iterator[tuple]:
        if len(raw) < wanted:
            yield sector, "short", 0, len(raw), b"", b"", b"", b"", False, None
            return
        base = struct.unpack_from("<I", raw, base_at)[0] if layout is TS else None  # a record's time counts from its sector's
        blank = not raw.strip(b"\xff")
        yield sector, "sector_header", 0, layout.header_size, raw[: layout.header_size], b"", b"", checked(raw, layout), blank, base
        if blank or struct.unpack_from("<I", raw)[0] != layout.magic:
            return
        stop = min(sector_size, len(raw))
        if layout is TS:  # a sealed sector says where it ends
            count, end = (struct.unpack_from("<H", raw, p)[0] for p in (count_at, end_at))
            if header_crc == struct.unpack_from("<H", raw, 18)[0] and 0xFFFF not in (count, end):
                stop = min(stop, end)
        for what, begin, until, parts in spans(raw, layout, gran, sector_size, stop, engine):
            first, second = (*parts, b"", b"")[:2]
            yield sector, what, begin, until, raw[begin:until][: 64 if what != "record" else None], first, second, first + second, False, base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [bytes(r) if r is not None else b"" for r in batch.column("raw").to_pylist()]
            crcs = crc16_many([checked(r, layout) for r in raws])
            rows = [row for sector, raw, crc in zip(batch.column("sector").to_pylist(), raws, crcs) for row in of_sector(sector, raw, int(crc))]
            columns = [list(c) for c in zip(*rows)] or [[] for _ in range(10)]
            columns[7] = crc16_many(columns[7]).tolist()
            kinds_ = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_)], [c.split()[0] for c in SPANS.split(", ")])

    return cut.select("sector", "raw").mapInArrow(run, SPANS)


def parse(cut: DataFrame, kind: str, sector_size: int = 4096, write_gran: int = 0, engine: bool = False) -> DataFrame:
    """A row for every span of sectors (sector, raw), with the fields of its type; the others are null."""
    layout = LAYOUTS[kind]
    found = find_spans(cut, layout, sector_size, 1 << write_gran, engine)
    is_header, is_record = F.col("type") == "sector_header", F.col("type") == "record"
    at = {("header", n): p for n, p in layout.positions("header").items()} | {("record", n): p for n, p in layout.positions("record").items()}

    def field(of: str, name: str, kind_: str = "long") -> Column:
        where = is_header if of == "header" else is_record
        return F.when(where, little_endian(F.col("head"), *at[of, name])).cast(kind_) if (of, name) in at else F.lit(None).cast(kind_)

    header_crc, data_crc, state = field("header", "hdr_crc", "int"), field("record", "data_crc", "int"), field("record", "state", "int")
    magic, calc, base = field("header", "magic"), F.col("calc"), F.when(is_header | is_record, F.col("base"))
    if kind == "kvdb":
        status = F.when(F.col("blank"), "ERASED").when(magic == layout.magic, "KVDB").otherwise("CORRUPT")
        engine_ok = field("record", "key_len").between(1, 32) & (field("record", "value_len") <= VALUE_MAX) & state.isin(0xFF, 0xFE, 0xFC)
    else:
        sealed = (header_crc == calc) & (field("header", "count") != 0xFFFF) & (field("header", "end_off") != 0xFFFF)
        status = F.when(F.col("blank"), "ERASED").when(magic != layout.magic, "CORRUPT").when(sealed, "SEALED").when(base == INVALID32, "ACTIVE_EMPTY").otherwise("ACTIVE")
        engine_ok = field("record", "data_len") >= 1
    only = lambda where, column: F.when(where, column)
    rows = found.select(
        "type", F.lit(kind).alias("kind"), "sector", (F.col("sector").cast("long") * sector_size + F.col("at")).alias("offset"), only(is_header, status).alias("status"), magic.alias("magic"), field("header", "version", "int").alias("version"),
        *[field("header", c).alias(c) for c in ("erase_cnt", "create_seq")], F.coalesce(field("record", "seq"), field("header", "seq")).alias("seq"), base.alias("time_base"), field("header", "count", "int").alias("count"), field("header", "end_off", "int").alias("end_off"),
        header_crc.alias("hdr_crc"), only(is_header, calc).alias("hdr_crc_calc"), only(is_header, header_crc == calc).alias("hdr_crc_ok"),
        state.alias("state"), only(is_record, state_name(state)).alias("state_name"), *[field("record", c, "int").alias(c) for c in ("key_len", "value_len", "key_hash", "data_len")], field("record", "time_delta").alias("time_delta"),
        data_crc.alias("data_crc"), only(is_record, calc).alias("data_crc_calc"), only(is_record, data_crc == calc).alias("crc_ok"),
        *([only(is_record, F.decode("first", "utf-8")).alias("key"), only(is_record, lower_hex(F.col("first"))).alias("key_hex"), only(is_record, lower_hex(F.col("second"))).alias("value_hex"), F.lit(None).cast("string").alias("data_hex")] if kind == "kvdb" else [*[F.lit(None).cast("string").alias(c) for c in ("key", "key_hex", "value_hex")], only(is_record, lower_hex(F.col("first"))).alias("data_hex")]),
        only(is_record, F.col("until") - F.col("at")).alias("record_size"), only(F.col("type") == "erased_tail", (F.col("until") - F.col("at")).cast("long")).alias("length"), only(F.col("type") == "scan_error", F.lit("invalid record header")).alias("reason"), only(is_record, engine_ok).alias("engine_ok"),
        only(F.col("type").isin("sector_header", "record", "scan_error"), hex_prefix(F.substring(F.col("head"), F.lit(1), F.when(F.col("type") == "scan_error", layout.record_size).otherwise(64)), 64)).alias("raw_hex_prefix"),
    )
    if kind == "kvdb":
        return rows.withColumn("time", F.lit(None).cast("long"))
    return rows.withColumn("time", F.when(is_record & (F.col("time_base") != INVALID32), (F.col("time_base") + F.col("time_delta")).bitwiseAND(F.lit(0xFFFFFFFF))))


def anomalies_of(rows: DataFrame, kind: str) -> DataFrame:
    """(severity, message, sector, offset) of what is wrong with parsed rows."""
    label, what = LAYOUTS[kind].label, F.col("type")
    cases = [
        (what == "short", "error", "short sector", False),
        ((what == "sector_header") & (F.col("status") == "CORRUPT"), "warn", f"invalid {label} sector header", False),
        (what == "scan_error", "warn", f"invalid {label} record header", True),
        (what == "overflow", "warn", f"{label} record exceeds sector", True),
        ((F.col("state") == VALID) & ~F.col("crc_ok"), "error", f"{label} VALID record CRC mismatch", True),
    ]
    message = F.coalesce(*[F.when(c, F.struct(F.lit(severity).alias("severity"), F.lit(text).alias("message"), F.lit(placed).alias("placed"))) for c, severity, text, placed in cases])
    found = rows.select("sector", "offset", message.alias("m")).where("m IS NOT NULL")
    return found.select("m.severity", "m.message", "sector", F.when(F.col("m.placed"), F.col("offset")).alias("offset"))


@dataclass(frozen=True)
class Dump:
    """The views of a parsed image."""

    kind: str
    rows: DataFrame

    @property
    def observable(self) -> DataFrame:
        return self.rows.where("type NOT IN ('short', 'overflow')").orderBy("offset")

    @property
    def records(self) -> DataFrame:
        return self.rows.where("type = 'record'")

    @property
    def anomalies(self) -> DataFrame:
        return anomalies_of(self.rows, self.kind)

    @property
    def valid(self) -> DataFrame:
        """Key-value: the newest intact version of each key, by key; time series: intact records by time, sector, offset."""
        good = self.records.where("state = 254 AND crc_ok")
        if self.kind == "kvdb":
            newest = good.groupBy("key_hex").agg(F.max_by(F.struct("key", "value_hex", "value_len", "seq", "sector", "offset"), F.struct("seq", -F.col("sector"), -F.col("offset"))).alias("r"))
            return newest.select("r.*").orderBy("key")
        return good.select("time", "sector", "offset", "data_len", "data_hex", "time_base", "time_delta").orderBy(F.coalesce("time", F.lit(-1)), "sector", "offset")

    @property
    def summary(self) -> DataFrame:
        good = (F.col("type") == "record") & (F.col("state") == VALID) & F.col("crc_ok")
        current = F.countDistinct(F.when(good, F.col("key_hex"))) if self.kind == "kvdb" else F.count(F.when(good, 1))
        wrong = self.anomalies.agg(F.count(F.lit(1)).alias("anomalies"))
        counts = self.rows.agg(F.lit(self.kind).alias("kind"), F.countDistinct("sector").alias("sectors"), F.count(F.when(F.col("type") == "record", 1)).alias("records"), current.alias("valid_current" if self.kind == "kvdb" else "valid_records"))
        return counts.crossJoin(F.broadcast(wrong))  # one row each


def open_image(spark: SparkSession, image: Image) -> Dump:
    kind = detect(spark, image)
    return Dump(kind, parse(sectors(spark, image), kind, image.sector_size, image.write_gran))


def verify(dump: Dump, strict: bool = False) -> str:
    """OK, or FAILED if there is an error (strict: any anomaly)."""
    bad = dump.anomalies if strict else dump.anomalies.where("severity = 'error'")
    return "OK" if bad.isEmpty() else "FAILED"


def engine_scan(dump_rows: DataFrame, recover: bool = False, most: int | None = None) -> DataFrame:
    """Records of a scan: without `recover` cut-off writes are passed over; after `most` records it stops."""
    rows = dump_rows.where("type = 'record'")
    rows = rows if recover else rows.where("state <> 255")
    return rows if most is None else rows.orderBy("offset").limit(most)


def shown(view: DataFrame) -> DataFrame:
    """view with the columns that hold a value anywhere."""
    counts = view.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in view.columns]).first()
    return view.select(*[c for c in view.columns if counts[c]])


def export(dump: Dump, out: str) -> None:
    """Every view as JSON lines, the tables as CSV too (with the columns that occur); one folder for each.

    The image is read and parsed once: its rows are kept as a table beside the views until these are written.
    """
    spark = dump.rows.sparkSession
    held = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/_rows")
    dump.rows.write.mode("overwrite").parquet(held.toString())
    dump = replace(dump, rows=spark.read.parquet(held.toString()))
    views = {"summary": dump.summary, "anomalies": dump.anomalies, "observable_dataset": dump.observable, "valid_dataset": dump.valid, ("kv_records" if dump.kind == "kvdb" else "ts_records"): dump.records}
    if dump.kind == "kvdb":
        views["kv_current"] = dump.valid
    for name, view in views.items():
        if name not in ("kv_records", "ts_records"):
            view.write.mode("overwrite").json(f"{out}/{name}.json")
        if name not in ("summary", "anomalies", "kv_current"):
            shown(view).write.mode("overwrite").csv(f"{out}/{name}.csv", header=True)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).delete(held, True)
