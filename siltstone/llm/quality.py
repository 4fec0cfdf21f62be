"""Quality by perplexity under an interpolated modified Kneser-Ney model (operator 1).

The model is one of bytes, of order 5, trained on trusted text (labelled quality 1); an n-gram of five bytes packs into an integer.

  1. Texts are compressed and dealt once to blocks of about BLOCK_ROWS rows.  Each block counts the n-grams of its trusted texts;
     the sums over all blocks are the counts.  Lower orders count distinct left neighbours (continuations).
  2. The counts are dealt to shards by the two bytes before the last one: a shard then holds every count and every context of
     orders 5 to 3 that its n-grams need.  Orders 2 and 1 are tables of at most 65,536 and 256 rows, and each order's three
     discounts come from its counts of counts.
  3. Each block asks each shard, in one packed row, for the distinct n-grams of its texts, and gets their log probabilities back
     in that order.  What is moved is the n-grams of a block, not those of every document; shards and groups
     of blocks meet in cells of bounded size.
  4. A document's perplexity is exp(-mean log probability of its bytes).  It is kept if that is at most its language's limit:
     of the quantiles QUANTILES of trusted documents set aside from training (a quarter, by the id's crc32), that with the
     largest sum of trusted rows kept and bad rows (labelled quality 0, never trained on) rejected, as shares.  A language
     with fewer than ENOUGH of either takes the limit of all languages together; if these have too few, the quantile
     QUANTILE of its own set-aside rows (of all languages, where it has none).

What is gathered grows with the corpus: every block sends its n-grams.

Cases: a null or empty text has null perplexity and is not kept; a null language is one of its own; repeated rows get equal
results; without trusted text nothing can be judged, so every document with text is kept; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix64, stage

ORDER, BLOCK_ROWS, SHARD_GRAMS, GROUP, QUANTILE = 5, 4096, 200_000, 256, 0.995
QUANTILES = [k / 200 for k in range(160, 200)]
#: Trusted and bad rows from which a limit is chosen.
ENOUGH = 30
#: Stands before each text; no byte of UTF-8.
PAD = 0xFF


def packed(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, doc_id, lang, blob): each text compressed, dealt to its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            blobs = [press.compress(t.encode()) if t else b"" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "doc_id", "lang")), pa.array(blobs, pa.binary())], ["block", "doc_id", "lang", "blob"])

    block = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(blocks)).cast("int").alias("block")
    return docs.select(block, "doc_id", "lang", "text").mapInArrow(run, "block int, doc_id long, lang string, blob binary").repartition("block")


def grams_of(blobs: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For some rows at a time: first row, end, the n-gram that ends at each byte, and where each row's begin."""
    opens = zstandard.ZstdDecompressor()
    sizes = np.array([zstandard.frame_content_size(b) if b else 0 for b in blobs], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    for i, j in chunks(offsets):
        raw = bytes([PAD] * (ORDER - 1)).join([b"", *(opens.decompress(b) if b else b"" for b in blobs[i:j])])
        data = np.frombuffer(raw, np.uint8).astype(np.int64)
        n = len(data) - ORDER + 1
        g = np.zeros(max(n, 0), np.int64)
        for k in range(ORDER):
            g = (g << 8) | data[k : k + n]
        # the padding of the next row is no byte to predict
        real = data[ORDER - 1 :] != PAD
        yield i, j, g[real], offsets[i : j + 1] - offsets[i]


def shard_of(g: np.ndarray, shards: int) -> np.ndarray:
    """By the two bytes before the last."""
    return (mix64(((g >> 8) & 0xFFFF).astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def distinct_grams(blobs: list[bytes]) -> np.ndarray:
    parts = [np.unique(g) for _, _, g, _ in grams_of(blobs)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def trusted_counts(blocks: DataFrame, trusted: DataFrame) -> DataFrame:
    """(gram, n) over the texts of trusted (block, doc_id)."""

    def run(key, left, right):
        good = set(right.column("doc_id").to_pylist())
        blobs = [b for d, b in zip(left.column("doc_id").to_pylist(), left.column("blob").to_pylist()) if d in good and b]
        parts = [np.unique(g, return_counts=True) for _, _, g, _ in grams_of(blobs)]
        if not parts:
            return pa.table({"gram": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return pa.table({"gram": grams, "n": np.bincount(at, np.concatenate([p[1] for p in parts]), len(grams)).astype(np.int64)})

    return blocks.groupBy("block").cogroup(trusted.groupBy("block")).applyInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame, column: str) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and more, from the counts of counts."""
    seen = {r["c"]: r["k"] for r in counts.where(f"{column} <= 4").groupBy(F.col(column).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("k")).collect()}
    a, b, c, d = (float(seen.get(k, 0)) for k in (1, 2, 3, 4))
    y = a / (a + 2 * b) if a else 0.5
    out = [1 - 2 * y * b / a if a and b else 0.5, 2 - 3 * y * c / b if b and c else 1.0, 3 - 4 * y * d / c if c and d else 1.5]
    return tuple(min(max(v, 0.05), k + 0.95) for k, v in enumerate(out))


class Level:
    """One order of the model: discounted counts by n-gram, totals and left-over mass by context."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, discount: tuple[float, float, float]):
        order = np.argsort(grams, kind="stable")
        self.grams, c = grams[order], counts[order].astype(np.float64)
        cut = np.array([0.0, *discount])[np.minimum(c, 3).astype(np.int64)]
        self.kept = c - cut
        self.contexts, at = np.unique(self.grams >> 8, return_inverse=True)
        self.totals = np.bincount(at, c, len(self.contexts))
        self.left = np.bincount(at, cut, len(self.contexts))

    def __call__(self, g: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """P(last byte | the others) of each n-gram; the lower order's where the context is unknown."""
        if not len(self.grams):
            return lower
        at = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
        kept = np.where(self.grams[at] == g, self.kept[at], 0.0)
        ct = np.minimum(np.searchsorted(self.contexts, g >> 8), len(self.contexts) - 1)
        known = self.contexts[ct] == g >> 8
        return np.where(known, (kept + self.left[ct] * lower) / self.totals[ct], lower)


def continued(grams: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams without their first byte, and how many distinct first bytes each has."""
    return np.unique(grams & ((1 << (8 * keep)) - 1), return_counts=True)


def probabilities(asked: DataFrame, counts: DataFrame, shards: int, groups: int, small: dict) -> DataFrame:
    """(block, shard, values) for packed requests (block, shard, grams): float32 log probabilities in the order asked."""

    def run(key, left, right):
        rows = left.select(["block", "shard", "grams"]).to_pylist()
        g5, c5 = right.column("gram").to_numpy(), right.column("n").to_numpy()
        levels = [Level(g5, c5, small["discounts"][5])]
        g = g5
        for keep in (4, 3):
            g, c = continued(g, keep)
            levels.append(Level(g, c, small["discounts"][keep]))
        levels.append(Level(small["pairs"], small["pair_counts"], small["discounts"][2]))
        values = []
        for r in rows:
            q = np.cumsum(np.frombuffer(zstandard.decompress(r["grams"]), np.int64))
            p = small["bytes"][q & 0xFF]
            for keep, level in zip((2, 3, 4, 5), levels[::-1]):
                p = level(q & ((1 << (8 * keep)) - 1), p)
            values.append(np.log(p).astype(np.float32).tobytes())
        return pa.table({"block": pa.array([r["block"] for r in rows], pa.int32()), "shard": pa.array([r["shard"] for r in rows], pa.int32()), "values": pa.array(values, pa.binary())})

    slices = counts.withColumn("shard", F.lit(0)) if shards == 1 else counts.mapInArrow(_sharded(shards), "gram long, n long, shard int")
    slices = slices.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = asked.withColumn("grp", (F.col("block") / GROUP).cast("int"))
    return asked.groupBy("shard", "grp").cogroup(slices.groupBy("shard", "grp")).applyInArrow(run, "block int, shard int, values binary")


def _sharded(shards: int):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("gram"), batch.column("n"), pa.array(shard_of(batch.column("gram").to_numpy(zero_copy_only=False), shards).astype(np.int32))], ["gram", "n", "shard"])

    return run


def requests(blocks: DataFrame, shards: int) -> DataFrame:
    """(block, shard, grams): the distinct n-grams of a block, one packed row for each shard."""

    def run(key, rows):
        g = distinct_grams(rows.column("blob").to_pylist())
        own = shard_of(g, shards)
        some = np.unique(own)
        return pa.table({"block": pa.array([key[0].as_py()] * len(some), pa.int32()), "shard": pa.array(some.astype(np.int32)), "grams": pa.array([zstandard.compress(np.diff(g[own == s], prepend=0).tobytes(), 3) for s in some], pa.binary())})

    return blocks.groupBy("block").applyInArrow(run, "block int, shard int, grams binary")


def scored(blocks: DataFrame, answers: DataFrame, shards: int) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity) of every row of the blocks."""

    def run(key, left, right):
        blobs = left.column("blob").to_pylist()
        g = distinct_grams(blobs)
        logs, own = np.zeros(len(g), np.float64), shard_of(g, shards)
        for s, v in zip(right.column("shard").to_pylist(), right.column("values").to_pylist()):
            logs[own == s] = np.frombuffer(v, np.float32)
        total, sizes = np.zeros(len(blobs)), np.zeros(len(blobs), np.int64)
        for i, j, grams, offsets in grams_of(blobs):
            upto = np.concatenate([[0.0], np.cumsum(logs[np.searchsorted(g, grams)])])
            total[i:j], sizes[i:j] = upto[offsets[1:]] - upto[offsets[:-1]], np.diff(offsets)
        value = np.exp(-total / np.maximum(sizes, 1))
        return pa.table({"doc_id": left.column("doc_id"), "lang": left.column("lang"), "n_bytes": sizes, "perplexity": pa.array(value, pa.float64(), mask=sizes == 0)})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "doc_id long, lang string, n_bytes long, perplexity double")


def chosen_limits(base: DataFrame) -> DataFrame:
    """(pooled, of, best) of rows (lang, perplexity, quality): the limit of each language, and of all (pooled)."""
    both = base.withColumn("pooled", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("of", F.when(~F.col("pooled"), F.col("lang")))
    good = both.where("quality = 1").groupBy("pooled", "of").agg(F.percentile_approx("perplexity", QUANTILES, 10_000).alias("at"), F.count(F.lit(1)).alias("n_good"))
    good = good.select(F.col("pooled").alias("p"), F.col("of").alias("o"), "at", "n_good").where(F.col("n_good") >= ENOUGH)
    bad = both.where("quality = 0").join(good, (F.col("pooled") == F.col("p")) & F.col("of").eqNullSafe(F.col("o")))
    # of equal sums the larger limit
    sums = [F.struct((F.avg((F.col("perplexity") > F.col("at")[k]).cast("double")) + q).alias("sum"), F.first(F.col("at")[k]).alias("limit")) for k, q in enumerate(QUANTILES)]
    found = bad.groupBy("pooled", "of").agg(F.array_max(F.array(*sums))["limit"].alias("best"), F.count(F.lit(1)).alias("n_bad"))
    return found.where(F.col("n_bad") >= ENOUGH).select("pooled", "of", "best")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold, kept: one row for each row of docs."""
    n = docs.select("doc_id").count()
    blocks = max(1, -(-n // BLOCK_ROWS))
    dealt = packed(docs, blocks)
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    set_aside = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    # the block of a document depends on its length too: every trusted id is sought where its rows are
    trusted = docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(blocks)).cast("int").alias("block")).join(good.where(~set_aside).hint("shuffle_merge"), "doc_id").distinct()
    counts = stage(trusted_counts(dealt, trusted), "grams")
    kinds = counts.count()
    suffix = lambda keep: F.col("gram").bitwiseAND((1 << (8 * keep)) - 1)
    four = counts.groupBy(suffix(4).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
    three = four.groupBy(suffix(3).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
    two = three.groupBy(suffix(2).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
    pairs = two.toPandas()  # 65,536 rows at most
    seen = np.bincount(pairs["gram"].to_numpy(np.int64) & 0xFF, minlength=256).astype(np.float64)
    small = {
        "discounts": {5: discounts(counts, "n"), 4: discounts(four, "c"), 3: discounts(three, "c"), 2: discounts(two, "c")},
        "pairs": pairs["gram"].to_numpy(np.int64), "pair_counts": pairs["c"].to_numpy(np.int64),
        "bytes": (seen + 0.5) / (seen.sum() + 128),
    }
    shards = max(1, -(-kinds // SHARD_GRAMS)) * 4
    answers = probabilities(requests(dealt, shards), counts, shards, -(-blocks // GROUP), small)
    result = stage(scored(dealt, answers, shards), "perplexity")
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality")).where(set_aside | (F.col("quality") == 0))
    base = stage(result.where("perplexity IS NOT NULL").join(known.hint("shuffle_merge"), "doc_id").select("lang", "perplexity", "quality"), "known")
    limits = base.where("quality = 1").groupBy("lang").agg(F.percentile_approx("perplexity", QUANTILE, 10_000).alias("own"))
    overall = base.where("quality = 1").agg(F.percentile_approx("perplexity", QUANTILE, 10_000).alias("all")).first()["all"]
    chosen = stage(chosen_limits(base), "limits")
    pooled = chosen.where("pooled").first()
    out = result.join(limits.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")), "left").drop("of")
    out = out.join(chosen.where("NOT pooled"), F.col("lang").eqNullSafe(F.col("of")), "left")
    limit = F.coalesce("best", F.lit(pooled and pooled["best"]).cast("double"), "own", F.lit(overall).cast("double"))
    return out.select("doc_id", "lang", "n_bytes", "perplexity", limit.alias("threshold"), F.coalesce(F.col("perplexity") <= F.coalesce(limit, F.lit(float("inf"))), F.lit(False)).alias("kept"))
