"""The registered queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audio, bpe, mixing, neardup, quality, repeats, tokenfiles, toxicity
from .common import table


def op1_quality_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("n_bytes")


def op4_learned_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(table(spark, sf_dir, "documents"), repeats.WORDS).select("doc_id", F.col("n").alias("n_words"), "n_removed", "kept_sha256")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.stored_digests(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenfiles.stored_index(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(table(spark, sf_dir, "documents"), repeats.BYTES).select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_kn": op1_quality_kn,
    "op2_mix_sources": op2_mix_sources,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_learned_ann": op4_learned_ann,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_telephony_audio": op7_telephony_audio,
    "op8_token_files": op8_token_files,
    "op9_minhash_neardup": op9_minhash_neardup,
    "op10_suffix_dedup": op10_suffix_dedup,
}

#: Pareto order sampling in SQL: the same hash, odds and order; the boundary by a plain running sum.
MIX_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')) AS digest, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::DOUBLE AS s FROM sizes GROUP BY source),
ranked AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0 * s AS full_s FROM src),
placed AS (SELECT *, row_number() OVER o AS place,
  (1.5 * sum(s) OVER () - (sum(full_s) OVER (o ROWS UNBOUNDED PRECEDING) - full_s)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM ranked WINDOW o AS (ORDER BY full_s / w, source NULLS LAST)),
lim AS (SELECT min(place) AS p, arg_min(lvl, place) AS l FROM placed WHERE lvl * w <= full_s),
tgt AS (SELECT source, s::BIGINT AS source_size, CASE WHEN p IS NULL OR place < p THEN full_s ELSE l * w END AS target FROM placed, lim),
facts AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio FROM tgt),
facts2 AS (SELECT *, floor(ratio)::BIGINT AS whole, ratio - floor(ratio) AS p, target - floor(ratio) * source_size AS need FROM facts),
u AS (SELECT z.doc_id, z.source, z.size, f.source_size, f.target, f.whole, f.p, f.need,
  (('0x' || substr(digest, 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS r
  FROM sizes z JOIN facts2 f ON z.source IS NOT DISTINCT FROM f.source),
q AS (SELECT *, CASE WHEN p > 0 AND p < 1 AND need > 0 THEN (r / (1 - r)) / (p / (1 - p)) END AS odds, row_number() OVER () AS row_id FROM u),
run AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id, size, row_id ROWS UNBOUNDED PRECEDING) AS upto FROM q WHERE odds IS NOT NULL),
gap AS (SELECT source, any_value(need) - coalesce(max(CASE WHEN upto <= need THEN upto END), 0) AS gap FROM run GROUP BY source),
best AS (SELECT arg_min(row_id, struct_pack(a := abs(gap - size), b := odds, c := doc_id, d := size, e := row_id)) AS row_id
  FROM run JOIN gap ON run.source IS NOT DISTINCT FROM gap.source WHERE upto > need AND abs(gap - size) < gap GROUP BY run.source)
SELECT doc_id, size, source_size, target,
  ((whole + CASE WHEN row_id IN (SELECT row_id FROM run WHERE upto <= need) OR row_id IN (SELECT row_id FROM best) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM q
"""

ORACLES: dict[str, str] = {"op2_mix_sources": MIX_SQL}
