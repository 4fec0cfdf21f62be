"""Token-id output (operator 8): Parquet list columns that allow selective reads of tokens and metadata.

`write_tokens` encodes texts, appends an end id and writes them in ascending doc_id order.  The files
are Parquet: `ids` is a list column (dictionary-encoded, or delta-encoded with encoding="delta"), row groups
and pages have a set size, and the writer's page indexes hold the least and greatest doc_id of each page, so a
reader asking for some doc_ids skips other row groups and pages and a reader of the metadata never opens the id
pages.  Column `shard` numbers the ranges of doc_id in ascending order.

`read_tokens` and `token_index` read the files back; the place of a document in the whole id stream is the sum of
the earlier shards' tokens and of the tokens before it in its shard: no task sees more than a shard.

Cases: a null or empty text has only the end id; a null doc_id comes first; rows that share a doc_id are ordered by
a hash of the text and then the text, in the files (column `place`) as in the index, and may lie in several shards; an empty table writes no rows; extra columns are not read.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import WordBpe, encode_batches, loaded
from .common import READ, shared_dir

SCHEMA = "shard int, place long, doc_id long, n_tokens int, ids array<int>"
#: Bytes of input that a shard is meant to take.
SHARD_BYTES = 256 << 20


def encode_with_end(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, ids) in the order of the rows."""

    def rows(_, batch, i, j, ids, upto, __):
        n = j - i
        out = np.insert(ids, upto[1:], np.uint32(end_id)).astype(np.int32)
        bounds = upto + np.arange(n + 1)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, n), pa.array(np.diff(bounds).astype(np.int32)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(out))], ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode_batches(lambda: loaded(WordBpe, path), rows), "doc_id long, n_tokens int, ids array<int>")


def planned_bytes(docs: DataFrame) -> int:
    """What the optimizer takes the input's size to be: of files, their bytes."""
    size = docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return min(int(str(size)), 1 << 50)


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int = 2, *, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_rows: int = 2_000, shards: int | None = None) -> None:
    """Write the token files of docs (doc_id, text) to the folder out."""
    spark = docs.sparkSession
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(planned_bytes(docs) / SHARD_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("text").asc_nulls_first()]
    ordered = docs.select("doc_id", "text").repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)
    options = {"compression": "zstd", "parquet.block.size": str(row_group_bytes), "parquet.page.row.count.limit": str(page_rows), "parquet.enable.dictionary": str(encoding == "dictionary").lower()}
    if encoding == "delta":
        options["parquet.writer.version"] = "PARQUET_2_0"
    encode_with_end(ordered, path, end_id).select(F.spark_partition_id().alias("shard"), F.monotonically_increasing_id().alias("place"), "doc_id", "n_tokens", "ids").write.options(**options).parquet(out)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The files' rows, or those of doc_ids from first to last: other row groups and pages are skipped by their least and greatest id."""
    rows = spark.read.options(**READ).schema(SCHEMA).parquet(path)
    rows = rows if first is None else rows.where(F.col("doc_id") >= first)
    return rows if last is None else rows.where(F.col("doc_id") <= last)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row of the files; the checksum is of the ids as read."""

    def sums(batches):
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            lengths = np.diff(lists.offsets.to_numpy())
            ends = np.cumsum(lengths)
            raw = memoryview(flat.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends - lengths, ends)]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("place"), batch.column("doc_id"), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], ["shard", "place", "doc_id", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).select("shard", "place", "doc_id", "ids").mapInArrow(sums, "shard int, place long, doc_id long, n_tokens long, ids_crc32 long")
    # one row for each shard: as many as partitions were written
    before = read_tokens(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("before"))
    w = W.partitionBy("shard").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = rows.withColumn("inside", F.sum("n_tokens").over(w) - F.col("n_tokens"))
    return inside.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def stored_index(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write the token files into the shared folder and index what they hold."""
    spark = docs.sparkSession
    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, out, path, end_id)
    return token_index(spark, out)


