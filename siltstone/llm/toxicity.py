"""Toxicity by noisy-channel deobfuscation (operator 6).

1. A character model (4-grams over 28 classes: a-z, any other letter, and the word boundary) is counted over every text.
2. Spans that may hide a word - letters mixed with digits or symbols, with the words beside them, three or more single
   characters with gaps, letters repeated three times or more - become lattices: each symbol may be one of the letters
   it is used for or nothing, each repetition one letter or two, each gap nothing or a word boundary.  Viterbi decoding
   under the character model picks the likeliest words.  Restored words are scored beside the words as written.
3. A word's evidence is that of its most telling form (the word, or its first 4, 5 or 6 bytes).  Forms that LEAST toxic documents hold
   are counted, each by itself, over all labelled documents.  The weight of a form is the log odds of the Wilson lower bound of
   its toxic share, so rare forms say little.
4. A document is described by its strongest word, the sum over its telling words and their number; a logistic fit on
   labelled rows that the word weights have not seen turns these into a score.

Labels: rows whose crc32 of the id modulo 4 is 0 or 1 teach the weights, 3 the fit, 2 are held out.  The fit uses at most
FIT_ROWS of its rows (those with the smallest hash of the id); the weights and the character counts use all.  What is
broadcast is bounded: CLASSES^4 numbers, and FORMS forms (those that the most toxic documents hold).

Cases: a null or empty text has no words and gets the score of no evidence; repeated rows get equal scores; without
labels, or with labels of one kind, the score is the share of toxic rows (0 without labels); several labels of a
document count as the highest; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, as_bytes, chunks, mix64, range_hashes, stage

CLASSES = 28
#: Toxic documents that must hold a form, and the forms that are weighed at most.
LEAST, FORMS = 3, 1 << 20
FIT_ROWS = 20_000
THRESHOLD = 0.3
#: The letters that symbols stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
#: Log probabilities of the channel: a symbol for a letter, a symbol for nothing, a letter doubled or repeated.
SWAP, DROP, DOUBLE = -1.0, -4.0, -2.0
#: The same of a gap that joins and one that parts: between single characters, without white space, and others.
GAPS = ((-0.5, -1.0), (-1.0, -0.5), (-3.0, -0.05))
#: So many words on either side of a disguised one may be pieces of it.
REACH = 2
#: What is neither a letter nor a symbol for one.
GAP = re.compile("([^a-z\x80-\U0010ffff" + re.escape("".join(LEET)) + "]+)")

_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_IS_LEET = np.zeros(256, bool)
_IS_LEET[[ord(c) for c in LEET]] = True
_CLASS = np.zeros(256, np.int64)
_CLASS[0x61:0x7B] = np.arange(1, 27)
_CLASS[0x80:] = 27


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters in UTF-8."""
    out = data.copy()
    upper = (out >= 0x41) & (out <= 0x5A)
    if len(out) > 1:
        upper[1:] |= (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
    out[upper] += 0x20
    return out


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of True that stays within a row."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = offsets[:-1][offsets[:-1] < len(mask)]
    opens = mask.copy()
    opens[1:] &= ~mask[:-1]
    opens[first] = mask[first]
    closes = mask.copy()
    closes[:-1] &= ~mask[1:]
    inner = first[first > 0] - 1
    closes[inner] = mask[inner]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of 4-grams of classes; a run of other characters is one boundary."""
    starts, ends = runs(_IS_LETTER[data], offsets)
    if not len(starts):
        return np.zeros(CLASSES**4, np.int64)
    keep = _IS_LETTER[data]
    place = np.cumsum(keep) - 1
    # each word is followed by one boundary
    classes = np.zeros(int(keep.sum()) + len(starts) + 3, np.int64)
    word = np.zeros(len(data), np.int64)
    word[starts] = 1
    word = np.cumsum(word)
    at = place[keep] + word[keep] - 1 + 3
    classes[at] = _CLASS[data[keep]]
    grams = ((classes[:-3] * CLASSES + classes[1:-2]) * CLASSES + classes[2:-1]) * CLASSES + classes[3:]
    return np.bincount(grams, minlength=CLASSES**4)


def count_grams(docs: DataFrame) -> DataFrame:
    """(gram, n) over every text, summed within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**4, np.int64)
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            for i, j in chunks(offsets):
                total += gram_counts(fold(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def log_model(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log P(class | three classes before), each order smoothed with the one below (Witten-Bell)."""
    c = np.zeros(CLASSES**4, np.float64)
    c[grams] = counts
    p = np.full(CLASSES, 1.0 / CLASSES)
    for order in range(1, 5):
        own = c.reshape(-1, CLASSES**order).sum(0).reshape(-1, CLASSES)
        total, kinds = own.sum(1, keepdims=True), (own > 0).sum(1, keepdims=True)
        # the context without its first class: the rows of the order below, again for each first class
        lower = np.tile(p.reshape(-1, CLASSES), (own.shape[0] // p.reshape(-1, CLASSES).shape[0], 1))
        weight = total + np.maximum(kinds, 1)
        p = (own + np.maximum(kinds, 1) * lower) / weight
    return np.log(p).astype(np.float32).reshape(-1)


class Decoder:
    """Viterbi over the lattice of a span; the state is the last three classes."""

    def __init__(self, model: np.ndarray):
        self.model, self.known = model, {}

    def options(self, span: str) -> Iterator[list[tuple[str, float]]]:
        """The readings of each symbol, repetition or gap; a blank is a word boundary."""
        parts = GAP.split(span)
        for i, part in enumerate(parts):
            if i % 2:
                alone = len(parts[i - 1]) == len(parts[i + 1]) == 1
                join, split = GAPS[0 if alone else 2 if re.search(r"[\t-\r ]", part) else 1]
                yield [("", join), (" ", split)]
                continue
            for m in re.finditer(r"(.)\1*", part, re.DOTALL):
                c, n = m[1], len(m[0])
                if "a" <= c <= "z":
                    yield [(c, 0.0)] if n == 1 else [(c + c, 0.0 if n == 2 else DOUBLE), (c, DOUBLE)]
                elif c in LEET:
                    yield [("", DROP)] + [(x * k, SWAP + (k == 2) * DOUBLE * (n != 2)) for x in LEET[c] for k in ((1,) if n == 1 else (2, 1))]
                else:
                    yield [(c * min(n, 2), 0.0)]

    def __call__(self, span: str) -> list[str]:
        """The words of the likeliest reading that are not written so in the span."""
        if (got := self.known.get(span)) is not None:
            return got
        model, beam = self.model, {(0, 0, 0): (0.0, None)}
        for own in self.options(span):
            after: dict = {}
            for (a, b, c), (score, path) in beam.items():
                for add, cost in own:
                    s, x, y, z = score + cost, a, b, c
                    for letter in add.encode():
                        k = int(_CLASS[letter])
                        if k or z:
                            s += float(model[((x * CLASSES + y) * CLASSES + z) * CLASSES + k])
                            x, y, z = y, z, k
                    if (x, y, z) not in after or after[x, y, z][0] < s:
                        after[x, y, z] = (s, (path, add) if add else path)
            beam = after
        end = lambda e: e[1][0] + (float(model[((e[0][0] * CLASSES + e[0][1]) * CLASSES + e[0][2]) * CLASSES]) if e[0][2] else 0.0)
        path, text = max(beam.items(), key=end)[1][1], []
        while path is not None:
            path, add = path
            text.append(add)
        best = sorted({*"".join(reversed(text)).split(" ")} - {*GAP.split(span), ""})
        if len(self.known) < 200_000:
            self.known[span] = best
        return best


def hidden_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a disguised word may stand, as start and end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter, leet = _IS_LETTER[data], _IS_LEET[data]
    # a symbol beside a letter, within a run of non-space
    hint = np.zeros(len(data), bool)
    hint[:-1] = leet[:-1] & letter[1:]
    hint[1:] |= leet[1:] & letter[:-1]
    # the third of three equal letters
    hint[2:] |= letter[2:] & (data[2:] < 0x80) & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    tokens, token_ends = runs(~IS_SPACE[data], offsets)
    upto = np.concatenate([[0], np.cumsum(hint)])
    odd = upto[token_ends] > upto[tokens]
    # with its neighbours, which may be pieces of the same word
    same = np.diff(np.searchsorted(offsets, tokens, side="right")) == 0
    near = odd.copy()
    for _ in range(REACH):
        some = near.copy()
        near[1:] |= some[:-1] & same
        near[:-1] |= some[1:] & same
    linked = near[1:] & near[:-1] & same
    first, last = near.copy(), near.copy()
    first[1:] &= ~linked
    last[:-1] &= ~linked
    # three or more single characters with gaps
    starts, ends = runs(letter | leet, offsets)
    joined = np.zeros(len(starts), bool)
    rows = np.searchsorted(offsets, starts, side="right")
    if len(starts) > 1:
        begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        single = begun[ends] - begun[starts] == 1
        joined[1:] = single[1:] & single[:-1] & (rows[1:] == rows[:-1])
    opens, closes = runs(joined, np.array([0, len(joined)]))
    long = closes - opens >= 2
    return np.concatenate([tokens[first], starts[opens[long] - 1]]), np.concatenate([token_ends[last], ends[closes[long] - 1]])


def word_forms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the forms of each word, shape (4, words); the word's own again where it is too short for a form."""
    out = np.empty((4, len(starts)), np.uint64)
    out[:] = range_hashes(data, starts, ends)
    for row, k in enumerate((4, 5, 6), 1):
        enough = ends - starts > k
        out[row, enough] = mix64(range_hashes(data, starts[enough], starts[enough] + k) + np.uint64(k))
    return out.view(np.int64)


def words_with_restored(data: np.ndarray, offsets: np.ndarray, decoder: Decoder) -> tuple[np.ndarray, np.ndarray]:
    """(rows, forms) of every word as written and as restored."""
    starts, ends = runs(_IS_LETTER[data], offsets)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    forms = word_forms(data, starts, ends)
    a, b = hidden_spans(data, offsets)
    if len(a):
        raw, texts, own = data.tobytes(), [], []
        for x, y, row in zip(a, b, np.searchsorted(offsets, a, side="right") - 1):
            for restored in decoder(raw[x:y].decode("utf-8", "replace")):
                texts.append(restored.encode())
                own.append(row)
        if texts:
            sizes = np.array([len(t) for t in texts], np.int64)
            begin = np.cumsum(sizes) - sizes
            rows = np.concatenate([rows, np.array(own, np.int64)])
            forms = np.concatenate([forms, word_forms(np.frombuffer(b"".join(texts), np.uint8), begin, begin + sizes)], axis=1)
    return rows, forms


def part_of(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def form_counts(rows: DataFrame, model, among=None) -> DataFrame:
    """(form, n): documents that hold a form, over rows of (text); among: a broadcast sorted array of the forms to count."""

    def run(batches):
        decoder = Decoder(model.value)
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            for i, j in chunks(offsets):
                own, forms = words_with_restored(fold(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i], decoder)
                own, forms = np.broadcast_to(own, forms.shape).reshape(-1), forms.reshape(-1)
                if among is not None:
                    hit = found_in(among.value, forms) >= 0
                    own, forms = own[hit], forms[hit]
                order = np.lexsort((own, forms))
                own, forms = own[order], forms[order]
                new = np.ones(len(forms), bool)
                new[1:] = (forms[1:] != forms[:-1]) | (own[1:] != own[:-1])
                kinds, n = np.unique(forms[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n.astype(np.int64))], ["form", "n"])

    return rows.select("text").mapInArrow(run, "form long, n long").groupBy("form").agg(F.sum("n").alias("n"))


def found_in(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where each value stands in a sorted table of hashes, or -1; most values fail at a look at their low bits."""
    out = np.full(values.size, -1, np.int64)
    if len(table):
        low, flat = np.int64((1 << 22) - 1), values.reshape(-1)
        bits = np.zeros(1 << 22, bool)
        bits[table & low] = True
        some = np.flatnonzero(bits[flat & low])
        at = np.minimum(np.searchsorted(table, flat[some]), len(table) - 1)
        out[some] = np.where(table[at] == flat[some], at, -1)
    return out.reshape(values.shape)


def weights_of(toxic: np.ndarray, clean: np.ndarray, share: float, z: float = 3.0) -> np.ndarray:
    """Log odds of the Wilson lower bound of the toxic share, above those of the overall share; 0 if not above."""
    n = toxic + clean
    p = toxic / n
    low = (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    low, share = np.clip(low, 1e-9, 1 - 1e-9), min(max(share, 1e-6), 1 - 1e-6)
    return np.maximum(0.0, np.log(low / (1 - low)) - np.log(share / (1 - share)))


def digests(docs: DataFrame, model, weights, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, top, total, telling, and what to keep): each text's strongest word, the sum over its distinct telling words, their number."""

    def run(batches):
        (known, w_of), decoder = weights.value, Decoder(model.value)
        w_of = np.append(w_of, 0.0)
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            for i, j in chunks(offsets):
                n = j - i
                rows, forms = words_with_restored(fold(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i], decoder)
                w = w_of[found_in(known, forms)].max(0) if forms.shape[1] else np.zeros(0)
                some = w > 0
                rows, words, w = rows[some], forms[0, some], w[some]
                order = np.lexsort((words, rows))
                rows, words, w = rows[order], words[order], w[order]
                first = np.ones(len(rows), bool)
                first[1:] = (rows[1:] != rows[:-1]) | (words[1:] != words[:-1])
                rows, w = rows[first], w[first]
                top = np.zeros(n)
                np.maximum.at(top, rows, w)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, n), pa.array(top), pa.array(np.bincount(rows, w, n).astype(np.float64)), pa.array(np.bincount(rows, minlength=n).astype(np.int64)), *(batch.column(c).slice(i, n) for c in keep)], ["doc_id", "top", "total", "telling", *keep])

    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select("doc_id", "text", *keep).mapInArrow(run, "doc_id long, top double, total double, telling long" + kept)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps; the last coefficient is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def score(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, telling, and the columns to keep: one row for each row of docs."""
    spark = docs.sparkSession
    grams = count_grams(docs).toPandas()  # CLASSES^4 rows at most
    model = spark.sparkContext.broadcast(log_model(grams["gram"].to_numpy(np.int64), grams["n"].to_numpy(np.float64)))
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("part", part_of(F.col("doc_id")))
    taught = docs.select("doc_id", "text").where(part_of(F.col("doc_id")) < 2).join(known.where("part < 2").hint("shuffle_merge"), "doc_id")
    kinds = {r["toxic"] > 0: r["n"] for r in known.where("part <> 2").groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    share = kinds.get(True, 0) / max(1, sum(kinds.values()))
    known_forms, weights = np.zeros(0, np.int64), np.zeros(0)
    if kinds.get(True) and kinds.get(False):
        often = form_counts(taught.where("toxic > 0"), model).where(F.col("n") >= LEAST)
        often = often.orderBy(F.desc("n"), "form").limit(FORMS).toPandas().sort_values("form")  # FORMS rows at most
        known_forms, toxic = often["form"].to_numpy(np.int64), often["n"].to_numpy(np.float64)
        rest = form_counts(taught.where("toxic <= 0"), model, spark.sparkContext.broadcast(known_forms)).toPandas()
        clean = np.zeros(len(known_forms))
        clean[found_in(known_forms, rest["form"].to_numpy(np.int64))] = rest["n"].to_numpy(np.float64)
        weights = weights_of(toxic, clean, share) if len(toxic) else weights
        known_forms, weights = known_forms[weights > 0], weights[weights > 0]
    described = stage(digests(docs, model, spark.sparkContext.broadcast((known_forms, weights)), keep), "digests")
    x = [F.col("top"), F.log1p("total"), F.log1p("telling")]
    sample = described.where(part_of(F.col("doc_id")) == 3).join(known.where("part = 3"), "doc_id").select(F.xxhash64("doc_id").alias("h"), "doc_id", *[c.alias(f"x{k}") for k, c in enumerate(x)], (F.col("toxic") > 0).cast("int").alias("y")).orderBy("h", "doc_id").limit(FIT_ROWS).toPandas()
    if sample["y"].nunique() == 2:
        b = fit(sample[["x0", "x1", "x2"]].to_numpy(), sample["y"].to_numpy(np.float64))
    else:
        b = np.array([0, 0, 0, np.log(max(share, 1e-9) / max(1 - share, 1e-9))])
    logit = F.lit(float(b[3])) + F.lit(float(b[0])) * x[0] + F.lit(float(b[1])) * x[1] + F.lit(float(b[2])) * x[2]
    value = (1 / (1 + F.exp(-F.least(F.greatest(logit, F.lit(-30.0)), F.lit(30.0))))) if kinds else F.lit(0.0)
    return described.select("doc_id", (part_of(F.col("doc_id")) == 2).alias("held_out"), value.alias("score"), "telling", *keep).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
