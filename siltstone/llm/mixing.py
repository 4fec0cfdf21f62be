"""Mixing sources to target weights (operator 2) by Pareto order sampling.

Each source gets a target number of words: the total, shared by weight, never above `cap` times what the source
has, the excess reshared among the others.  The water level of that sharing has a closed form over the
sources in the order in which they reach their caps, so no loop is needed.

A document's expected number of copies is its source's target over its source's size; with a column of relative
weights, its weight's share of the target instead, at most `cap`.  The whole part of it is allocated with certainty.  The fraction p is an
inclusion probability: documents are ranked by (u / (1 - u)) / (p / (1 - p)), u a uniform number hashed from
id and text, and taken in that order until the words that are left for the source are filled, so the sample's
size is fixed.  The one further document whose size comes nearest the remaining gap closes it.

Where the boundary falls in a source is found by two histograms of the rank (4,096 buckets, then 4,096
within the boundary bucket); only the rows of that one small bucket are ordered one by one.  A source holding a third of all rows
is thus never gathered in one task.  Everything is DataFrame operations.

Cases: a null text has size 0 and is never repeated beyond whole copies of nothing (taken 0); a null source is a
source, the last; repeated rows are documents of their own (ties are broken by size and a row number given once); an
empty table gives no rows; sources of size 0 have target 0; extra columns, whatever their names, are ignored;
without a usable weight a document is not taken, and where weights meet the cap a source may stay below its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, small, stage

LEVELS = 4096


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in (0, 1) hashed from id and text, so that rows that share an id (or have none) draw their own: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), total: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row for each source: source, source_size, weight, target.  Sources by code point, null last, take the weights in turn."""
    everything = W.orderBy(F.col("source").asc_nulls_last())
    level = W.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = sizes.groupBy("source").agg(F.sum("size").cast("double").alias("source_size"))
    cycle = F.array(*map(F.lit, weights))
    per = per.withColumn("weight", F.element_at(cycle, ((F.row_number().over(everything) - 1) % len(weights) + 1).cast("int")).cast("double")).withColumn("full", F.lit(cap) * F.col("source_size"))
    per = per.withColumn("want", F.lit(total) * F.sum("source_size").over(whole))
    per = per.withColumn("below", F.sum("full").over(level.rowsBetween(W.unboundedPreceding, 0)) - F.col("full"))
    per = per.withColumn("above", F.sum("weight").over(level.rowsBetween(0, W.unboundedFollowing))).withColumn("place", F.row_number().over(level))
    per = per.withColumn("level", (F.col("want") - F.col("below")) / F.col("above"))
    # the first source that stays under its cap sets the level for all after it
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("full"), F.struct("place", "level"))).over(whole)
    per = per.withColumn("first", first)
    return per.select("source", F.col("source_size").cast("long").alias("source_size"), "weight", F.when(F.col("first").isNull() | (F.col("place") < F.col("first.place")), F.col("full")).otherwise(F.col("first.level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (3.0, 1.0, 2.0), total: float = 1.5, cap: float = 2.0, seed: str = "mix", number: str | None = None, weight: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row for each row of docs.

    number: a column that numbers the rows, returned under its name.  weight: a column of relative weights (none or below 0: 0).
    """
    own = F.lit(1.0) if weight is None else F.greatest(F.coalesce(F.nanvl(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    sizes = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), uniform(F.col("doc_id"), F.col("text"), seed).alias("u"), own.alias("weight"), (F.col(number) if number else F.monotonically_increasing_id()).alias("row"))
    sizes = stage(sizes, "sizes")
    shares = sizes.groupBy("source").agg(F.sum(F.col("weight") * F.col("size")).alias("heavy")).withColumnRenamed("source", "weighed")
    per = targets(sizes, weights, total, cap).withColumnRenamed("weight", "share")
    facts = stage(per.join(shares, F.col("source").eqNullSafe(F.col("weighed"))).select(F.col("source").alias("of"), "source_size", "target", "heavy"), "targets")
    # the copies expected of a row; with equal weights the source's target over its size
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    if weight is not None:
        expected = F.when(F.col("heavy") > 0, F.least(F.col("target") * F.col("weight") / F.col("heavy"), F.lit(float(cap)))).otherwise(0.0)
    rows = sizes.join(small(facts), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("ratio", expected).drop("heavy", "weight")
    rows = rows.withColumn("whole", F.floor("ratio")).withColumn("p", F.col("ratio") - F.col("whole"))
    u = F.col("u")
    odds = F.when((F.col("p") > 0) & (F.col("p") < 1), (u / (1 - u)) / (F.col("p") / (1 - F.col("p"))))
    rows = rows.withColumn("odds", odds).withColumn("v", F.col("odds") / (1 + F.col("odds")))
    rows = stage(rows.withColumn("b1", F.floor(F.col("v") * LEVELS)).withColumn("b2", F.floor((F.col("v") * LEVELS - F.col("b1")) * LEVELS)).drop("u", "ratio", "p", "v"), "ranked")
    # what the whole copies leave open of each source's target
    open_ = rows.groupBy("source").agg((F.max("target") - F.sum(F.col("whole") * F.col("size"))).alias("need")).withColumnRenamed("source", "of")
    drawn = rows.where("odds IS NOT NULL").join(small(stage(open_, "open")), F.col("source").eqNullSafe(F.col("of"))).drop("of").where("need > 0")

    def crossing(histogram: DataFrame, bucket: str) -> DataFrame:
        """For each source the bucket in which the words reach the need, and the words before it."""
        w = W.partitionBy("source").orderBy(bucket)
        upto = histogram.withColumn("upto", F.sum("words").over(w))
        return upto.where(F.col("upto") > F.col("need")).groupBy("source").agg(F.min(F.struct(bucket, (F.col("upto") - F.col("words")).alias("before"))).alias("at"))

    first = crossing(drawn.groupBy("source", "need", "b1").agg(F.sum("size").alias("words")), "b1").select(F.col("source").alias("s1"), F.col("at.b1").alias("edge1"), F.col("at.before").alias("before1"))
    first = small(stage(first, "edge1"))
    marked = drawn.join(first, F.col("source").eqNullSafe(F.col("s1")), "left").drop("s1")
    inner = marked.where("b1 = edge1").withColumn("need", F.col("need") - F.col("before1"))
    second = crossing(inner.groupBy("source", "need", "b2").agg(F.sum("size").alias("words")), "b2").select(F.col("source").alias("s2"), F.col("at.b2").alias("edge2"), F.col("at.before").alias("before2"))
    second = small(stage(second, "edge2"))
    marked = marked.join(second, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2")
    boundary = marked.where("b1 = edge1 AND b2 = edge2")
    w = W.partitionBy("source").orderBy("odds", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, 0)
    boundary = boundary.withColumn("upto", F.col("before1") + F.col("before2") + F.sum("size").over(w))
    boundary = stage(boundary.select("source", "row", "size", "upto", "need", "odds", "doc_id", (F.col("upto") <= F.col("need")).alias("fits")), "boundary")
    # what the fitting ones leave open, and the one other document that comes nearest to it
    gap = boundary.groupBy("source").agg(F.min(F.col("need")).alias("need"), F.max(F.when(F.col("fits"), F.col("upto"))).alias("filled"), F.min(F.col("upto") - F.col("size")).alias("start"))
    gap = small(stage(gap.select(F.col("source").alias("s3"), (F.col("need") - F.coalesce("filled", "start")).alias("gap")), "gap"))
    late = "(b1 > edge1 OR (b1 = edge1 AND b2 > edge2))"
    rest = marked.where(late).select("source", "row", "size", "odds", "doc_id").unionByName(boundary.where("NOT fits").select("source", "row", "size", "odds", "doc_id"))
    rest = rest.join(gap, F.col("source").eqNullSafe(F.col("s3"))).where(F.abs(F.col("gap") - F.col("size")) < F.col("gap"))
    closer = rest.groupBy("source").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("miss"), "odds", "doc_id", "size", "row")).alias("best")).select(F.col("best.row").alias("row"))
    early = marked.where(f"edge1 IS NULL OR NOT ({late} OR (b1 = edge1 AND b2 = edge2))").select("row")
    chosen = early.unionByName(boundary.where("fits").select("row")).unionByName(closer).withColumn("drawn", F.lit(1))
    out = rows.join(chosen, "row", "left").withColumn("copies", F.col("whole") + F.coalesce("drawn", F.lit(0)))
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("copies").cast("int").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken"), *([F.col("row").alias(number)] if number else []))
