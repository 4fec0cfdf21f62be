"""A corpus in five stages: toxic documents go, one of each group of near copies stays, repeated passages go, sources are
mixed to target weights, and what is left is encoded by byte-level BPE.

Each stage takes the documents that the one before kept, decides on all of them, and all but the last return the columns of
documents.  Stages are written as Parquet in the shared folder and read again.

Cases: rows are told apart by a number of their own, so null and shared ids, repeated rows and columns of any further name pass
through every stage; an empty table passes through as one; ties are settled by id and then by row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, mixing, neardup, repeats, toxicity
from siltstone.llm.common import ROW, drop_path, numbered, scope, shared_dir, stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text the toxicity score rejects go; rows without a text are judged as empty ones."""
    rows = numbered(docs)
    bad = toxicity.score(rows, table(spark, sf_dir, "labels"), keep=(ROW,)).where("predicted = 1").select(ROW)
    return rows.join(bad, ROW, "left_anti").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: that with the smallest id, null ids last, then the first row.  A row without words
    is a copy only of rows without words that share its id, and of none without an id."""
    rows = numbered(docs)
    classes = neardup.classes(rows.select(F.col(ROW).alias("doc_id"), "text")).withColumnRenamed("doc_id", ROW)
    members = classes.join(rows.select(ROW, "doc_id"), ROW)
    empty = F.when(F.col("n_shingles") == 0, F.col("doc_id"))
    kept = members.groupBy((F.col("n_shingles") == 0).alias("none"), empty.alias("empty"), F.when((F.col("n_shingles") > 0) | F.col("doc_id").isNull(), F.col("component_id")).alias("class"))
    kept = kept.agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", ROW)).alias("least")).select(f"least.{ROW}")
    return rows.join(kept, ROW, "left_semi").select(docs.columns)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows go.  A text that loses words becomes the kept words joined by one space, n_chars its new
    length; the others stay as they are, and a document that loses every word goes."""
    rest = f"{ROW}_rest"  # the other columns travel as one
    rows = numbered(docs.withColumn(rest, F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])).select("doc_id", "text", rest))
    cut = repeats.dedup(rows, repeats.WORDS, keep_text=True, number=ROW, keep=(rest,)).where("n_removed = 0 OR n_removed < n")
    text = F.col("kept").cast("string")
    changed = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col(f"{rest}.n_chars")) if "n_chars" in docs.columns else None}
    return cut.select(*[changed[c].alias(c) if c in changed else F.col(rest)[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    rows = numbered(docs)
    taken = mixing.mix(rows, number=ROW).where("copies > 0").select(ROW, F.col("copies").alias(f"{ROW}_copies"))
    return rows.join(taken, ROW).withColumn(f"{ROW}_copy", F.explode(F.sequence(F.lit(1), F.col(f"{ROW}_copies")))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every copy."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("n_bytes")


_TABLES: list[str] = []


def staged(name: str, function):
    """The stage, with its tables in a folder of their own.  Those of the stages before go when it begins, as their results have been written;
    they stay if the documents given still read them."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _TABLES else []
        for path in [p for p in _TABLES if not any(p in file for file in read)]:
            drop_path(spark, f"{shared_dir(spark)}/{path}")
            _TABLES.remove(path)
        with scope(f"pipeline-{name}-{uuid.uuid4().hex}") as own:
            _TABLES.append(own)
            return function(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, staged(name, function)) for name, function in (("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("substring_dedup", drop_passages), ("mix", mix_sources), ("encode", encode))]

#: The score, the matching index and the tokenizer have no SQL form: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
