"""MinHash near-dedup with sequential Bayesian verification (operator 9).

A document's set holds the distinct shingles of five lower-cased words (the whole sequence, if it is shorter).  Documents
with 100 * |A & B| >= 75 * |A | B| are linked; classes are the connected components.

  1. Documents of the same word sequence (128-bit digest) collapse to one node.
  2. Signatures of BANDS x ROWS minima; each band is a bucket.  At similarity 0.75 a pair shares fewer than two buckets with
     probability below 7e-7, and none with 3e-8.
  3. First round: in each bucket every member is paired with the bucket's first member only.
  4. Candidates are compared by batches of 16 minima.  After each batch the posterior probability that the similarity is
     at least 0.75 (uniform prior) is bounded; below MISS the pair is dropped, and at once if the sizes alone forbid the link.
     Survivors are verified on their whole sets, word for word.
  5. Verified links give components.  What may still join two of them is narrowed before any pair is made: a member stays open
     only if it shares two buckets with other components, and if enough of its shingles stand in other components at all
     (an exact bound: a link needs 0.75 / 1.75 of both sizes together in common).  A heavily edited copy falls out here by
     itself, without being held against the thousands of its group.
  6. Second round: in each bucket every open member is paired with the bucket's most central one only, that with the largest
     share of its shingles in other components.  This links most of what the first members, edited themselves, left apart.
  7. Further rounds go by the first common shingle of a pair, rarest first: from there on both must hold enough shingles for a
     link, so a member stands only at the few rare shingles where a member of another component and of a fitting size may begin
     a link with it (exact; members that differ at rare places never meet at the frequent shingles of their group).
     Pairs are made there in cells of at most CELL x CELL members and compared as above, until no untested pair joins two
     components.  So no link between components is lost, and a large group of near copies is linked by about as many pairs
     as it has members.
Classes and links stay in tables; the driver sees counts only.

Cases: a null or empty text has no shingles and is its own class; repeated rows are copies; a null doc_id belongs to the
class of its words, links them as any other and is never kept; an empty table gives no rows; extra columns are not read; sets hold every shingle of a
text, however long; rows that share an id are told apart by their words; a class without any id has a null component_id.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, chunks, gather_ranges, lowered, mix64, range_hashes, small, stage, words_of

SHINGLE, BANDS, ROWS, STEP = 5, 32, 3, 16
#: Minima (16 bits each) of the signatures that open members are compared by.
WIDE = 768
SHARE = 75
MISS = 1e-7
CELL = 512
#: Sizes of sets are taken together in classes of a twentieth of their logarithm.
SIZES = 20
#: Untested pairs that a member proposes at a shingle in the first of the further rounds, and how many times as many in each later one.
PROPOSALS, MORE = 16, 8
#: Pairs of signatures that a worker compares at once.
PAIRS = 50_000


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[0::2] | np.uint64(1), x[1::2]


def shingle_bounds(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and first word of every shingle of rows of so many words."""
    bounds = np.concatenate([[0], np.cumsum(counts)])
    sizes = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    row = np.repeat(np.arange(len(counts)), sizes)
    return row, bounds[:-1][row] + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def distinct(codes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The different codes of each row (rows ascend), sorted, end to end, and where the n rows begin."""
    bounds = np.searchsorted(row, np.arange(n + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        codes[a:b].sort()
    new = np.ones(len(row), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])
    return codes[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within the row, end to end, and where the rows begin."""
    data = lowered(data)
    starts, ends, counts = words_of(data, offsets)
    words = np.concatenate([range_hashes(data, starts, ends), np.zeros(SHINGLE, np.uint64)])
    row, first = shingle_bounds(counts)
    left = np.cumsum(counts)[row] - first  # words from here to the end of the row
    hashes = mix64(words[first])
    short = np.flatnonzero(left < SHINGLE)  # texts of fewer words
    few, least = hashes[short], left[short]
    for k in range(1, SHINGLE):
        hashes = mix64(hashes * np.uint64(0x9E3779B97F4A7C15) + words[first + k])
        few = np.where(least > k, mix64(few * np.uint64(0x9E3779B97F4A7C15) + words[first[short] + k]), few)
    hashes[short] = few
    return distinct(hashes, row, len(counts))


def exact_shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as numbers that are equal only if all their words are."""
    known: dict[bytes, int] = {}
    ids, counts = [], []
    for t in texts:
        words = t.lower().split()
        counts.append(len(words))
        ids += [known.setdefault(w, len(known) + 1) for w in words]
    ids, counts = np.array([*ids, *[0] * SHINGLE], np.int64), np.array(counts, np.int64)
    row, first = shingle_bounds(counts)
    left, base = np.cumsum(counts)[row] - first, len(known) + 1
    codes, most = ids[first], base
    for k in range(1, SHINGLE):
        if most >= (1 << 62) // base:  # name what there is anew
            some, codes = np.unique(codes, return_inverse=True)
            most = len(some)
        codes, most = codes * base + np.where(left > k, ids[first + k], 0), most * base
    return distinct(codes, row, len(texts))


def signatures(hashes: np.ndarray, bounds: np.ndarray, n_minima: int) -> np.ndarray:
    """The first n_minima minima for each row with shingles (others: zeros), the upper 32 bits."""
    n = len(bounds) - 1
    out = np.zeros((n, n_minima), np.uint32)
    some = np.flatnonzero(np.diff(bounds) > 0)
    if len(some):
        at = bounds[:-1][some]
        for k, (a, b) in enumerate(zip(*seeds(n_minima))):
            out[some, k] = (np.minimum.reduceat((hashes ^ b) * a, at) >> np.uint64(32)).astype(np.uint32)
    return out


def digest_of(text: bytes) -> bytes:
    """128 bits of the word sequence."""
    return hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16).digest()


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, words, sig) of every row; `words` is a digest of the word sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            for i, j in chunks(offsets):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                hashes, bounds = shingles(part, own)
                raw = part.tobytes()
                same = [digest_of(raw[a:b]) for a, b in zip(own[:-1], own[1:])]
                sig = signatures(hashes, bounds, BANDS * ROWS)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(bounds).astype(np.int64)), pa.array(same, pa.binary()), pa.array([r.tobytes() for r in sig], pa.binary())], ["doc_id", "n_shingles", "words", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, words binary, sig binary")


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A bucket for each band of each signature."""
    bands = sig[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    mixed = mix64(bands[:, :, 0].astype(np.uint64) + (np.arange(BANDS, dtype=np.uint64) << np.uint64(40)))
    for k in range(1, ROWS):
        mixed = mix64(mixed ^ (bands[:, :, k].astype(np.uint64) + np.uint64(k)))
    return mixed


def buckets(reps: DataFrame) -> DataFrame:
    """(bucket, rep) for each band of each representative."""

    def run(batches):
        for batch in batches:
            keys = band_keys(np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(batch.num_rows, -1))
            ids = batch.column("rep").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, BANDS))], ["bucket", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "bucket long, rep long")


@functools.cache
def least_matches(n_minima: int) -> list[int]:
    """For 16, 32, ... compared minima, the fewest matches at which P(similarity >= 0.75) is at least MISS."""
    out = []
    for n in range(STEP, n_minima + 1, STEP):
        # with a uniform prior the similarity is Beta(m + 1, n - m + 1): its upper tail is a binomial sum
        tails = itertools.accumulate(math.comb(n + 1, k) * 3**k for k in range(n + 1))
        out.append(next(m for m, tail in enumerate(tails) if tail / 4 ** (n + 1) >= MISS))
    return out


def surviving(sig_a: np.ndarray, a: np.ndarray, sig_b: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of signatures (rows a of sig_a and b of sig_b): the indices that survive every batch, and their matches."""
    at, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, least in enumerate(least_matches(sig_a.shape[1])):
        part = slice(k * STEP, (k + 1) * STEP)
        matches = matches + np.count_nonzero(sig_a[:, part][a[at]] == sig_b[:, part][b[at]], axis=1)
        keep = matches >= least
        if not keep.all():
            at, matches = at[keep], matches[keep]
    return at, matches


def possible(na, nb, shared):
    """Whether sets of these sizes with at most so many common shingles may be linked: 100 s >= 75 (na + nb - s)."""
    return (100 + SHARE) * shared >= SHARE * (na + nb)


def among(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) stand among the pairs (c, d)."""
    names, code = np.unique(np.concatenate([a, b, c, d]), return_inverse=True)
    a, b, c, d = np.split(code, np.cumsum([len(a), len(b), len(c)]))
    return np.isin(a * len(names) + b, c * len(names) + d)


def prune(pairs: DataFrame, reps: DataFrame, kind: type = np.uint32) -> DataFrame:
    """Those of pairs (a, b) whose sizes allow a link and whose signatures (minima of that kind) survive."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, PAIRS):
                part = batch.slice(i, PAIRS)
                sigs = [np.frombuffer(b"".join(part.column(c).to_pylist()), kind).reshape(part.num_rows, -1) for c in ("sa", "sb")]
                every = np.arange(part.num_rows)
                at, _ = surviving(sigs[0], every, sigs[1], every)
                yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(at)) for c in ("a", "b")], ["a", "b"])

    of = lambda x: reps.select(F.col("rep").alias(x), F.col("sig").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").where(possible(F.col("na"), F.col("nb"), F.least("na", "nb")))
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def packed(docs: DataFrame) -> DataFrame:
    """(words, blob): texts compressed, to be shipped to where pairs are verified."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([digest_of(t) for t in texts], pa.binary()), pa.array([press.compress(t) for t in texts], pa.binary())], ["words", "blob"])

    return docs.select("text").mapInArrow(run, "words binary, blob binary")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, linked) of pairs (a, b): the exact test on whole sets."""

    def run(batches):
        opens = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                blobs = [*part.column("ta").to_pylist(), *part.column("tb").to_pylist()]
                own = {b: k for k, b in enumerate(dict.fromkeys(blobs))}
                codes, bounds = exact_shingles([opens.decompress(b) if b else b"" for b in own])
                linked, n = [], part.num_rows
                for k in range(n):
                    x, y = (codes[bounds[t] : bounds[t + 1]] for t in (own[blobs[k]], own[blobs[n + k]]))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(100 * both >= SHARE * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(linked)], ["a", "b", "linked"])

    some = small(stage(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "needed", narrow=True))
    texts = texts.join(some, "rep", "left_semi")
    both = pairs.join(texts.select(F.col("rep").alias("a"), F.col("blob").alias("ta")), "a").join(texts.select(F.col("rep").alias("b"), F.col("blob").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, linked boolean")


def judge(pairs: DataFrame, wide: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, linked) of all pairs (a, b), staged ones of open members; those that the long signatures forbid are not linked."""
    sure = verify(stage(prune(pairs, wide, np.uint16), "pruned"), texts)
    return pairs.join(sure, ["a", "b"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b): label is the smallest node reachable.  Alternating large and small stars."""
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars", narrow=True)
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small_ = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = stage(small_, "stars", narrow=True)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == mark:
            break
        mark = (seen["n"], seen["h"])
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()).groupBy("node").agg(F.min("label").alias("label"))


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after further links (a, b): only the components that the links touch are settled anew."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    edges = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    new = stage(components(edges), "relabel", narrow=True)
    moved = labels.join(new.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return moved.unionByName(new.join(labels.select("node"), "node", "left_anti"))


def relabel(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def several(members: DataFrame) -> DataFrame:
    """The buckets in which members of several components stand."""
    return members.groupBy("bucket").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a <> _b").select("bucket")


def open_members(members: DataFrame, texts: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of members (bucket, rep, label): (bucket, rep, n, shared) of those that may be linked across components, their (rep, n, sig), long signatures, and the (rep, shingle) of all looked at."""

    def spread(batches):
        opens = zstandard.ZstdDecompressor()
        for batch in batches:
            raw = [opens.decompress(b) if b else b"" for b in batch.column("blob").to_pylist()]
            upto = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
            data = np.frombuffer(b"".join(raw), np.uint8)
            ids, label = batch.column("rep").to_numpy(), batch.column("label").to_numpy()
            for i, j in chunks(upto):
                hashes, bounds = shingles(data[upto[i] : upto[j]], upto[i : j + 1] - upto[i])
                each = np.diff(bounds)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i:j], each)), pa.array(np.repeat(label[i:j], each)), pa.array(hashes.view(np.int64))], ["rep", "label", "shingle"])

    def widen(batches):
        opens = zstandard.ZstdDecompressor()
        for batch in batches:
            raw = [opens.decompress(b) if b else b"" for b in batch.column("blob").to_pylist()]
            upto = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
            data = np.frombuffer(b"".join(raw), np.uint8)
            for i, j in chunks(upto):
                sig = signatures(*shingles(data[upto[i] : upto[j]], upto[i : j + 1] - upto[i]), WIDE)
                wide = (sig & 0xFFFF).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([batch.column("rep").slice(i, j - i), batch.column("n").slice(i, j - i), pa.array([r.tobytes() for r in wide], pa.binary())], ["rep", "n", "sig"])

    meeting = stage(members.join(several(members), "bucket"), "meeting")
    some = stage(meeting.groupBy("rep", "label").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("rep", "label"), "meet", narrow=True)
    own = stage(texts.join(some, "rep"), "open_texts")
    spread_ = stage(own.select("rep", "label", "blob").mapInArrow(spread, "rep long, label long, shingle long"), "shingles")
    common = spread_.groupBy("shingle").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a <> _b").select("shingle")
    shared = spread_.join(common, "shingle").groupBy("rep").agg(F.count(F.lit(1)).alias("shared"))
    bound = stage(shared.join(reps.select("rep", "n"), "rep").where(100 * F.col("shared") >= SHARE * F.col("n")), "bound")
    left = meeting.join(bound, "rep")
    least = left.groupBy("bucket").agg(F.min("n").alias("least"), F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a <> _b").select("bucket", "least")
    left = stage(left.join(least, "bucket").where(possible(F.col("n"), F.col("least"), F.col("shared"))).select("bucket", "rep", "n", "shared"), "open")
    wide = own.join(left.select("rep", "n").distinct(), "rep").select("rep", "n", "blob").mapInArrow(widen, "rep long, n long, sig binary")
    return left, stage(wide, "wide"), spread_.select("rep", "shingle")


def central(members: DataFrame, tested: DataFrame) -> DataFrame:
    """Untested pairs (a, b) of each of members (bucket, rep, label, n, shared) and the bucket's most central one, if of another component."""
    lead = members.groupBy("bucket").agg(F.max(F.struct((F.col("shared") / F.col("n")).alias("part"), "n", "shared", "rep", "label")).alias("lead"))
    pairs = members.join(lead, "bucket").where(F.col("label") != F.col("lead.label")).where(possible(F.col("n"), F.col("lead.n"), F.least("shared", "lead.shared")))
    return pairs.select(F.least("rep", "lead.rep").alias("a"), F.greatest("rep", "lead.rep").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")


def firsts(shingles_: DataFrame, members: DataFrame) -> DataFrame:
    """(shingle, rep, label, n, rest, fit) of members (rep, label, n): the shingles at which a link may begin, rarest first.

    rest: how many of the member's shingles from there on stand in other components; fit: the largest set that may be linked with so many.
    """
    rows = stage(shingles_.join(members, "rep"), "open_shingles")
    often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"), F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a <> _b").select("shingle", "often")
    rarest_last = Window.partitionBy("rep").orderBy(F.desc("often"), F.desc("shingle"))
    rows = rows.join(often, "shingle").withColumn("rest", F.row_number().over(rarest_last).cast("long"))
    fit = F.floor(((100 + SHARE) * F.col("rest") - SHARE * F.col("n")) / SHARE)
    return rows.withColumn("fit", fit).where(100 * F.col("fit") >= SHARE * F.col("n")).select("shingle", "rep", "label", "n", "rest", "fit")


def meeting_firsts(rows: DataFrame) -> DataFrame:
    """Those of rows (shingle, rep, label, n, rest, fit) at whose shingle another component has a size that fits."""
    kinds = rows.groupBy("shingle", F.floor(F.log("n") * SIZES).alias("size")).agg(F.min("n").alias("least"), F.max("fit").alias("most"), F.min("label").alias("_a"), F.max("label").alias("_b"))
    kinds = kinds.groupBy("shingle").agg(F.collect_list(F.struct("least", "most", "_a", "_b")).alias("kinds"))
    fits = F.exists("kinds", lambda k: ((k["_a"] != F.col("label")) | (k["_b"] != F.col("label"))) & (k["least"] <= F.col("fit")) & (F.col("n") <= k["most"]))
    return rows.join(kinds, "shingle").where(fits).drop("kinds")


def proposals(rows: DataFrame, tested: DataFrame, each: int) -> DataFrame:
    """Untested pairs (a, b) across components that may begin at a shingle, by cells of bounded size; the `each` likeliest of each member in a cell.

    rows: (shingle, rep, label, n, rest).
    """

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Proposals of whole cells, sorted by cell and then role: pairs of many cells are compared together."""
        column = lambda c: rows.column(c).to_numpy()
        role, rep, label, n, rest = (column(c) for c in ("role", "rep", "label", "n", "rest"))
        cell = np.cumsum(np.concatenate([[True], (column("shingle")[1:] != column("shingle")[:-1]) | (column("i")[1:] != column("i")[:-1]) | (column("j")[1:] != column("j")[:-1])])) - 1
        lines = np.flatnonzero(role == 0)
        begin = np.searchsorted(2 * cell + role, 2 * cell[lines] + 1)
        count = np.searchsorted(2 * cell + role, 2 * cell[lines] + 2) - begin
        done = rows.column("tested").combine_chunks() if isinstance(rows.column("tested"), pa.ChunkedArray) else rows.column("tested")
        for x, y in chunks(np.concatenate([[0], np.cumsum(count)]), PAIRS):
            a, b = np.repeat(lines[x:y], count[x:y]), gather_ranges(begin[x:y], count[x:y])
            some = (label[a] != label[b]) & possible(n[a], n[b], np.minimum(rest[a], rest[b]))
            a, b = a[some], b[some]
            own = done.take(pa.array(lines[x:y]))
            if own.null_count < len(own):
                known = own.flatten().to_numpy(zero_copy_only=False)
                by = np.repeat(rep[lines[x:y]], np.diff(own.offsets.to_numpy()))
                fresh = ~among(rep[a], rep[b], by, known)
                a, b = a[fresh], b[fresh]
            order = np.lexsort((b, -np.minimum(rest[a], rest[b]), a))
            a, b = a[order], b[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            a, b = rep[a[place < each]], rep[b[place < each]]
            if len(a):
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            keys = [held.column(c).to_numpy() for c in ("shingle", "i", "j")]
            # the last cell may go on in the next batch
            whole = int(np.flatnonzero(np.logical_and.reduce([k == k[-1] for k in keys]))[0]) if held.num_rows else 0
            if whole:
                yield from settle(held.slice(0, whole).combine_chunks())
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from settle(held.combine_chunks())

    sizes = rows.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("c"))
    per = sizes.groupBy("shingle").agg(F.sum("c").alias("all"), F.max(F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    per = per.select("shingle", F.col("top.label").alias("most"), F.ceil(F.col("all") / CELL).cast("int").alias("columns"), F.ceil((F.col("all") - F.col("top.c")) / CELL).cast("int").alias("lines"))
    open_ = rows.join(per, "shingle").withColumn("h", F.xxhash64("rep"))
    # a column cell for every member; a line for those outside the shingle's largest component
    columns = open_.select("shingle", "rep", "label", "n", "rest", F.lit(1).alias("role"), F.pmod("h", "columns").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("lines") - 1)).alias("j"))
    lines = open_.where("label <> most").select("shingle", "rep", "label", "n", "rest", F.lit(0).alias("role"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("i"), F.pmod("h", "lines").cast("int").alias("j"))
    done = tested.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(tested.select(F.col("b").alias("rep"), F.col("a").alias("other"))).groupBy("rep").agg(F.collect_set("other").alias("tested"))
    lines = lines.join(done, "rep", "left")
    cells = columns.withColumn("tested", F.lit(None).cast("array<bigint>")).unionByName(lines)
    dealt = cells.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j", "role").select("shingle", "i", "j", "role", "rep", "label", "n", "rest", "tested")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    described = stage(describe(docs), "sets")
    # a node for each word sequence, numbered once: rows may share an id, or have none
    nodes = described.where("n_shingles > 0").groupBy("words").agg(F.min("doc_id").alias("least"), F.min("sig").alias("sig"), F.min("n_shingles").alias("n"))
    reps = stage(nodes.withColumn("rep", F.monotonically_increasing_id()), "reps")
    bands = buckets(reps)
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("lead")).where("c > 1").drop("c")
    members = stage(bands.join(shared, "bucket"), "members")
    known = reps.select("words", "rep").join(members.select("rep").distinct(), "rep", "left_semi")
    texts = stage(packed(docs).join(known, "words").groupBy("rep").agg(F.min("blob").alias("blob")), "texts")
    pairs = members.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    tested = stage(verify(stage(prune(pairs, reps), "pruned"), texts), "tested")
    labels = stage(components(tested.where("linked").select("a", "b")), "labels", narrow=True)
    left, wide, shingles_ = open_members(relabel(members.select("bucket", "rep"), labels), texts, reps)

    def learn(pairs: DataFrame) -> None:
        nonlocal tested, labels
        new = stage(judge(pairs, wide, texts), "tested")
        links = new.where("linked").select("a", "b")
        if not links.isEmpty():
            labels = stage(joined(labels, links), "labels", narrow=True)
        tested = tested.unionByName(new)

    learn(stage(central(relabel(left, labels), tested.select("a", "b")), "central"))
    rows = stage(firsts(shingles_, relabel(wide.select("rep", "n"), labels)), "firsts")
    rows = stage(meeting_firsts(rows), "firsts")
    each = PROPOSALS
    while True:
        rows = stage(meeting_firsts(relabel(rows.drop("label"), labels)), "firsts")
        more = stage(proposals(rows, tested.select("a", "b"), each), "proposed")
        each *= MORE
        if more.isEmpty():
            break
        learn(more)
    named = relabel(reps.select("words", "rep", "least"), labels)
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    out = described.select("doc_id", "n_shingles", "words").join(named.select("words", "label").join(least, "label"), "words", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
