"""Files too large for one writer: a folder of pieces, each written by the task that has its bytes; in order of name they are the file.

Tasks write through Arrow's file systems.  Where Arrow has none for the folder's store, whole pieces pass through the driver one by one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Bytes from which on a piece is closed.
PIECE = 1 << 22


def save(dealt: DataFrame, path: str, head: Callable[[int], bytes] | None = None) -> None:
    """Write dealt (part long, entry binary) as pieces; head makes what a piece begins with from the number of its entries.

    Parts follow each other by number, and a part is in one task, in its order.
    """
    spark = dealt.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    target = files.makeQualified(target)
    if not files.mkdirs(target):
        raise OSError(f"cannot make {path}")
    where = target.toUri().toString()
    begin = head or (lambda n: b"")
    direct = _arrow(where) is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, k, entries in cut(batches):
            name, content = f"part-{part:010d}-{k:06d}", b"".join([begin(len(entries)), *entries])
            if direct:
                put(where, name, content)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([None if direct else content], pa.binary())], ["name", "content"])

    made = dealt.mapInArrow(run, "name string, content binary")
    written = False
    for row in made.select("name").collect() if direct else made.toLocalIterator():
        written = True
        if not direct:
            _put_from_driver(spark, files, target, row["name"], bytes(row["content"]))
    if not written:  # an empty file is one all the same
        _put_from_driver(spark, files, target, f"part-{0:010d}-{0:06d}", begin(0))


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes]]]:
    """(part, number in the part, entries) of each piece."""
    part, k, held, size = None, 0, [], 0
    for batch in batches:
        for p, entry in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and (p != part or size >= PIECE):
                yield part, k, held
                held, size, k = [], 0, k + 1
            if p != part:
                part, k = p, 0
            held.append(entry)
            size += len(entry)
    if held:
        yield part, k, held


def _arrow(where: str) -> tuple[fs.FileSystem, str] | None:
    """The file system and the folder in it; none if Arrow does not reach the store."""
    try:
        return fs.FileSystem.from_uri("file://" + where[5:] if where.startswith("file:/") and not where.startswith("file://") else where)
    except (pa.ArrowException, OSError, ImportError):
        return None


def put(where: str, name: str, content: bytes) -> None:
    """One piece under its name, all at once: a task that is run again writes the same."""
    files, folder = _arrow(where)
    files.create_dir(folder, recursive=True)
    with files.open_output_stream(hidden := f"{folder}/_{name}-{uuid.uuid4().hex}") as out:
        out.write(content)
    try:
        files.move(hidden, f"{folder}/{name}")
    except OSError:  # a store that does not replace: the piece is there from another attempt
        files.delete_file(hidden)
        if files.get_file_info(f"{folder}/{name}").type != fs.FileType.File:
            raise


def _put_from_driver(spark: SparkSession, files, target, name: str, content: bytes) -> None:
    out = files.create(spark._jvm.org.apache.hadoop.fs.Path(target, name), True)
    try:
        out.write(content)
    finally:
        out.close()


def lengths(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of its pieces in order."""
    return sorted(tuple(r) for r in spark.read.format("binaryFile").load(path).select("path", "length").collect())
