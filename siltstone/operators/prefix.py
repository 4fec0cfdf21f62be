"""Running sums and maxima over an ordered log without gathering a series in one task.

Rows are cut into chunks of the order column; a chunk is summarised by one row, the summaries (few) are scanned in order, and each
chunk is then finished by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Span of the order column that one task handles at once.
CHUNK = 1 << 16


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, out: str, chunk: int = CHUNK) -> DataFrame:
    """Inclusive running sum of `value` in ascending `order` within keys."""
    df = df.withColumn("_c", F.expr(f"`{order}` div {chunk}"))
    per = df.groupBy(*keys, "_c").agg(F.sum(value).alias("_s"))
    before = per.select(*keys, "_c", (F.sum("_s").over(W.partitionBy(*keys).orderBy("_c")) - F.col("_s")).alias("_before"))
    w = W.partitionBy(*keys, "_c").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w)).join(before, [*keys, "_c"]).withColumn(out, F.col(out) + F.col("_before")).drop("_c", "_before")
