"""Removing repeated passages: substring dedup over words (operator 5) and suffix-array dedup over bytes (operator 10).

A window is L consecutive symbols of one text (35 words, or 400 bytes).  A symbol goes if some window that covers it
also starts anywhere else.  Windows are judged on the input.

Plan
  1. Each window is keyed by the least hash of the k-symbol strings in it (its anchor): equal windows have equal anchors.
     Neighbouring windows with one anchor form a fragment, kept as (anchor, 128-bit digest of the fragment, place).
  2. Anchors that occur once in all texts hold no repeated window and go.  Equal fragments collapse to one text with a weight.
  3. The texts are dealt to shards by anchor, so every pair of equal windows meets in one shard.  A shard builds an
     index of its texts and streams the texts through it for their matching statistics; where these reach L with
     two occurrences (weights count), the window is reported.
       words: an FM-index whose Burrows-Wheeler transform is a wavelet matrix of bit vectors with popcount ranks;
       backward search and, where it fails, the parent interval.
       bytes: a run-length Burrows-Wheeler transform with the suffixes sampled at run ends, which give the statistics.
  4. Reported intervals go back to every occurrence of the fragment, and the texts are cut.
A text that equals another as a whole needs no search: its weight says that each of its windows is elsewhere.

Equality is never left to a hash that can be made to collide: fragments are equal by a cryptographic digest of 128 bits (of
the bytes, or of the words with one space between), in an index words are numbered by their bytes and common prefixes are compared symbol by symbol.

Nothing is capped: a shard works through its anchors in batches of about BATCH symbols.  An anchor with more than LARGEST times that (a
passage that very many documents share, each in its own surroundings) is settled exactly by its windows, one by one, in all tasks.

Cases: null and empty texts, and texts shorter than a window, lose nothing; repeated rows are documents of their own, so
a repeated text of at least L symbols goes whole; rows that share a doc_id are kept apart by their text or number; an
empty table gives no rows; extra columns are not read; words stay as written, the kept ones joined by one space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, chunks, load8, mix64, powers, range_hashes, single_spaced, stage, word_numbers, words_of

WORDS, BYTES = ("words", 35, 8), ("bytes", 400, 200)
#: Symbols that a shard indexes at once, at least.
BATCH = {"words": 1_000_000, "bytes": 2_000_000}
#: An anchor whose different texts hold more than so many batches is not indexed at once but settled window by window.
LARGEST = 2
#: Bytes of text whose hashes are worked out at once: their arrays stay near the processor.
NEAR = 500_000
#: Windows of a fragment, at most.
RUN = 1024


# ---- step 1: anchors


def layout(unit: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each text's symbols begin, and from which byte to which each symbol stands (words only)."""
    if unit == "bytes":
        return offsets, np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends, counts = words_of(data, offsets)
    return np.concatenate([[0], np.cumsum(counts)]), starts, ends


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - have :]) if w > have else out


def fragments(values: np.ndarray, bounds: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, first symbol, one past the last, times the anchor stands in it) of each fragment.

    Anchors come from sums that may collide: then different windows meet under one anchor, which costs time and changes nothing.
    """
    n = len(values)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    grams = mix64((total[k:] - total[:-k]) * down[: n - k + 1])
    least = sliding_min(grams, length - k + 1)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = row[: n - length + 1] == row[length - 1 :]
    first = inside.copy()
    first[1:] &= ~(inside[:-1] & (least[1:] == least[:-1]))
    last = inside.copy()
    last[:-1] &= ~(inside[1:] & (least[1:] == least[:-1]))
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + length
    # runs of more than RUN windows (periodic text) are cut, so that no fragment is long
    pieces = -(-(end - begin - length + 1) // RUN)
    if pieces.max(initial=1) > 1:
        begin, stop = np.repeat(begin, pieces) + RUN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)), np.repeat(end, pieces)
        end = np.minimum(begin + RUN + length - 1, stop)
    # How often the least string stands in the fragment: two equal windows of one fragment show it first in their
    # left one, where it begins a window, and last in their right one, where it ends a window.
    w = length - k + 1
    opening, closing = grams[: len(least)] == least, grams[w - 1 :] == least
    upto = lambda m: np.concatenate([[0], np.cumsum(m)])
    both = opening.copy()
    both[: w - 1] = False
    both[w - 1 :] &= closing[: max(0, len(least) - w + 1)]
    a, b, c = upto(opening), upto(closing), upto(both)
    stop = end - length + 1
    seen = a[stop] - a[begin] + b[stop] - b[begin] - (c[stop] - c[np.minimum(begin + w - 1, stop)])
    return row[begin], least[begin].view(np.int64), begin, end, np.maximum(seen, 1)


def digests_of(content: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits, as two integers, of each content[begin:end]."""
    view = memoryview(content)
    return np.frombuffer(b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist())]), "<i8").reshape(-1, 2)


def anchors(docs: DataFrame, unit: str, length: int, k: int) -> DataFrame:
    """(key, anchor, f1, f2, start, size, seen) of every fragment of docs (doc_id, key, text); f1, f2: the digest of its symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for i, j in chunks(offsets, NEAR):
                part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                if unit == "bytes":
                    values, content = part, part.tobytes()
                else:
                    bounds, starts, ends = layout(unit, part, bounds)
                    values = range_hashes(part, starts, ends)
                    content, starts, ends = single_spaced(part, starts, ends)
                row, anchor, begin, end, seen = fragments(values, bounds, length, k)
                if len(row):
                    frag = digests_of(content, begin, end) if unit == "bytes" else digests_of(content, starts[begin], ends[end - 1])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i:j][row]), pa.array(anchor), pa.array(frag[:, 0]), pa.array(frag[:, 1]), pa.array((begin - bounds[row]).astype(np.int32)), pa.array((end - begin).astype(np.int32)), pa.array(np.minimum(seen, 2).astype(np.int32))], ["key", "anchor", "f1", "f2", "start", "size", "seen"])

    return docs.mapInArrow(run, "key long, anchor long, f1 long, f2 long, start int, size int, seen int")


# ---- step 3: the index


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by doubling of symbols from 1 on; each 0 is a separator of its own, in order of place, and the last symbol is one.

    The first round sorts by several symbols packed into one integer; later ones sort only suffixes that are still tied.
    """
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    packed, h = text.astype(np.int64), 1
    low = (np.int64(1) << bits) - 1
    while 2 * h * bits <= 62:
        following = np.concatenate([packed[h:], np.zeros(min(h, n), np.int64)])[:n]
        packed = (packed << (h * bits)) | np.where(packed & low, following, 0)
        h *= 2
    ended = (packed & low) == 0
    order = np.argsort(packed)
    same = packed[order]
    new = np.concatenate([[True], same[1:] != same[:-1]])
    # equal strings that end with their text stand by place
    some = np.flatnonzero(ended[order])
    order[some] = order[some][np.lexsort((order[some], same[some]))]
    new |= ended[order]
    del packed, same
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    at = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
    while len(at):
        pos = order[at]
        # groups are contiguous in `at`, so one sort of (group, rank h symbols on) orders them in place
        key = rank[pos] * np.int64(n) + rank[pos + h]
        sub = np.argsort(key)
        pos, key = pos[sub], key[sub]
        order[at] = pos
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[pos] = np.maximum.accumulate(np.where(fresh, at, 0))
        at = at[~(fresh & np.concatenate([fresh[1:], [True]]))]
        h *= 2
    return order


def common_prefixes(values: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many symbols of values agree from a and from b on, at most limit: the symbols themselves are compared, bytes by eights."""
    out = np.zeros(len(a), np.int64)
    eights = values.dtype == np.uint8
    at = load8(values) if eights else values
    todo = np.flatnonzero(limit > 0)
    while len(todo):
        x, y = at[a[todo] + out[todo]], at[b[todo] + out[todo]]
        if eights:
            odd = x ^ y
            step = np.where(odd == 0, 8, np.bitwise_count((odd & (~odd + np.uint64(1))) - np.uint64(1)) >> 3)
            out[todo] += step
            todo = todo[(step == 8) & (out[todo] < limit[todo])]
        else:
            out[todo] += x == y
            todo = todo[(x == y) & (out[todo] < limit[todo])]
    return np.minimum(out, limit)


class Wavelet:
    """A wavelet matrix: one bit vector for each bit of the symbols, with counts for each 64-bit word."""

    def __init__(self, bwt: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        n, now = len(bwt), bwt.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = ((now >> level) & 1).astype(np.uint8)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            packed[: (n + 7) // 8] = np.packbits(bit, bitorder="little")
            words = packed.view(np.uint64)
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int32))]).astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.base = self._walk(np.arange(sigma + 1), np.zeros(sigma + 1, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        i = i.copy()
        for step, level in enumerate(range(self.levels - 1, -1, -1)):
            word = i >> 6
            mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[step][word] + np.bitwise_count(self.words[step][word] & mask)
            i = np.where((c >> level) & 1, self.zeros[step] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands among the first i symbols."""
        return self._walk(c, i) - self.base[c]


class RunLength:
    """A run-length Burrows-Wheeler transform with the suffix sampled at both ends of each run.

    A separator counts as a run of its own.  At a border between two runs the last suffix of the one and the first of the next are
    neighbours, and their common prefix is read off the text at these two places.  Everywhere else a suffix and its neighbour both go
    on from the suffixes one place to the left (their symbol before is the same), so the common prefix is one less.  The samples
    alone thus give each place's matching statistic: the longest prefix that also starts elsewhere.
    """

    def __init__(self, bwt: np.ndarray, order: np.ndarray):
        border = np.concatenate([[True], (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)])
        first = np.flatnonzero(border)
        last = np.concatenate([first[1:], [len(bwt)]]) - 1
        self.n = len(bwt)
        self.symbol, self.size = bwt[first], last - first + 1
        self.first, self.last = order[first], order[last]

    def border_prefixes(self, values: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The common prefix at each border: the end of a run, and the start of the next."""
        a, b = self.last[:-1], self.first[1:]
        return common_prefixes(values, a, b, np.minimum(limit[a], limit[b]))

    def matching(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place, the common prefix with the suffix before it in order, and with the one after it; shared: border_prefixes."""
        sides = []
        for places, known in ((self.first, np.concatenate([[0], shared])), (self.last, np.concatenate([shared, [0]]))):
            at_sample = np.full(self.n, -1, np.int64)
            at_sample[places] = known
            sampled = np.maximum.accumulate(np.where(at_sample >= 0, np.arange(self.n), 0))
            sides.append(np.maximum(at_sample[sampled] - (np.arange(self.n) - sampled), 0))
        return sides[0], sides[1]


class Minima:
    """Sparse table over LCP values: where the run of values >= d around a place ends."""

    def __init__(self, lcp: np.ndarray):
        self.tables, k = [lcp.astype(np.uint16)], 1
        while 2 * k <= len(lcp):
            last = self.tables[-1]
            self.tables.append(np.minimum(last[:-k], last[k:]))
            k *= 2

    def left(self, i: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Largest j <= i with lcp[j] < d."""
        i = i.copy()
        for k in range(len(self.tables) - 1, -1, -1):
            table, span = self.tables[k], 1 << k
            at = i - span + 1
            go = (at >= 0) & (table[np.maximum(at, 0)] >= d)
            i = np.where(go, i - span, i)
        return i

    def right(self, i: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Smallest j >= i with lcp[j] < d."""
        i = i.copy()
        for k in range(len(self.tables) - 1, -1, -1):
            table, span = self.tables[k], 1 << k
            go = (i < len(table)) & (table[np.minimum(i, len(table) - 1)] >= d)
            i = np.where(go, i + span, i)
        return i


def repeated_windows(values: np.ndarray, bounds: np.ndarray, weights: np.ndarray, length: int, run_length: bool) -> np.ndarray:
    """For each symbol place, whether the window that starts there occurs twice: in another place, or in a text of weight 2 or more.

    values: symbols of all texts; bounds: where each text begins; weights: how often each text occurs.
    """
    n, texts = len(values), len(bounds) - 1
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(texts), sizes)
    found = np.zeros(n, bool)
    left = bounds[1:][row] - np.arange(n)
    heavy = weights >= 2
    found[heavy[row] & (left >= length)] = True
    light = ~heavy & (sizes >= length)
    if not light.any():
        return found
    # the indexed text: a separator after each text, below all symbols
    if values.dtype == np.uint8:
        used = np.bincount(values, minlength=256) > 0
        dense, sigma = np.cumsum(used)[values] - 1, int(used.sum())
    else:
        distinct, dense = np.unique(values, return_inverse=True)
        sigma = len(distinct)
    at = np.arange(n) + row
    text = np.zeros(n + texts, np.int64)
    text[at] = dense + 1
    limit = np.zeros(n + texts, np.int64)
    limit[at] = left
    order = suffix_array(text)
    bwt = text[order - 1]
    runs = RunLength(bwt, order)
    plain = np.zeros(n + texts, values.dtype)
    plain[at] = values
    before_, after_ = runs.matching(runs.border_prefixes(plain, limit))
    if run_length:
        # the texts that stand once are streamed: a window is repeated if the match from its place on is as long
        found |= (np.maximum(before_, after_)[at] >= length) & light[row]
        return found
    lcp = np.concatenate([np.minimum(before_[order], length), [0]])
    index, minima = Wavelet(bwt, sigma), Minima(lcp)
    counts = np.bincount(text, minlength=sigma + 1)
    before = np.cumsum(counts) - counts
    # stream the texts that stand once, all together, from their ends
    walk = np.flatnonzero(light)
    walk = walk[np.argsort(-sizes[walk], kind="stable")]
    many = len(text)
    lo, hi, got = np.zeros(len(walk), np.int64), np.full(len(walk), many, np.int64), np.zeros(len(walk), np.int64)
    end = bounds[1:][walk]
    for step in range(int(sizes[walk[0]])):
        live = int(np.searchsorted(-sizes[walk], -step, side="left"))
        if not live:
            break
        todo = np.arange(live)
        c = dense[end[:live] - step - 1] + 1
        while len(todo):
            a, b = lo[todo], hi[todo]
            x, y = before[c[todo]] + index.rank(c[todo], a), before[c[todo]] + index.rank(c[todo], b)
            ok = y - x >= 2
            fits = todo[ok]
            lo[fits], hi[fits], got[fits] = x[ok], y[ok], got[fits] + 1
            fail = todo[~ok]
            fail = fail[got[fail] > 0]
            if len(fail):  # a shorter prefix of what matched: the parent interval
                d = np.maximum(lcp[lo[fail]], lcp[hi[fail]])
                top = d == 0
                lo[fail] = np.where(top, 0, minima.left(lo[fail], np.maximum(d, 1)))
                hi[fail] = np.where(top, many, minima.right(hi[fail], np.maximum(d, 1)))
                got[fail] = d
            todo = fail
        long = np.flatnonzero(got[:live] > length)
        if len(long):  # only the first L symbols matter
            d = np.full(len(long), length)
            lo[long], hi[long] = minima.left(lo[long], d), minima.right(hi[long], d)
            got[long] = length
        full = np.flatnonzero(got[:live] >= length)
        if len(full):
            found[end[full] - step - 1] = True
    return found


def spans(found: np.ndarray, bounds: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text, (start, end) of the runs that its reported windows cover, flattened."""
    cover = np.zeros(len(found) + length + 1, np.int32)
    at = np.flatnonzero(found)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + length, -1)
    inside = np.cumsum(cover[: len(found)]) > 0
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    opens, closes = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # runs of neighbouring texts may touch: cut them at the bounds
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(found))]
    cuts = cuts[inside[cuts - 1] & inside[cuts]] if len(cuts) else cuts
    opens, closes = np.sort(np.concatenate([opens, cuts])), np.sort(np.concatenate([closes, cuts]))
    own = np.searchsorted(bounds, opens, side="right") - 1
    first = np.searchsorted(own, np.arange(len(bounds) - 1))
    last = np.searchsorted(own, np.arange(len(bounds) - 1), side="right")
    return [np.column_stack([opens[a:b], closes[a:b]]).reshape(-1) - bounds[t] for t, (a, b) in enumerate(zip(first, last))]


def search_shards(texts: DataFrame, unit: str, length: int) -> DataFrame:
    """(anchor, f1, f2, spans) of fragments (anchor, f1, f2, n, text, size): what of each fragment is repeated."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])]).astype(np.int64)
        if unit == "bytes":
            values, bounds = data, offsets
        else:
            values, counts = word_numbers(data, offsets)
            bounds = np.concatenate([[0], np.cumsum(counts)])
        found = repeated_windows(values, bounds, np.array([r[4] for r in rows]), length, unit == "bytes")
        some = [(*r[:3], s.tolist()) for r, s in zip(rows, spans(found, bounds, length)) if len(s)]
        return pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in some], pa.int64()) for k in range(3)), pa.array([x[3] for x in some], pa.list_(pa.int32()))], ["anchor", "f1", "f2", "spans"])

    def run(batches):
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("anchor", "f1", "f2", "text", "n", "size")]
            for anchor, f1, f2, text, n, size in zip(*columns):
                if rows and rows[-1][:3] == (anchor, f1, f2):
                    continue  # rows that repeat id and text share a key, and each of them gave the text
                if held >= BATCH[unit] and rows[-1][0] != anchor:
                    yield settle(rows)
                    rows, held = [], 0
                rows.append((anchor, f1, f2, text, n))
                held += size
        if rows:
            yield settle(rows)

    return texts.mapInArrow(run, "anchor long, f1 long, f2 long, spans array<int>")


def window_spans(texts: DataFrame, unit: str, length: int) -> DataFrame:
    """The same as search_shards for anchors that are too large for an index: each window by itself, by its digest.

    A window is a row, so an anchor of any size is dealt to all tasks, and equal windows are counted before they are moved.
    """

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("anchor", "f1", "f2", "n", "text")]
            last = None
            for anchor, f1, f2, n, text in zip(*columns):
                if (anchor, f1, f2) == last:
                    continue  # see search_shards
                last = (anchor, f1, f2)
                data = np.frombuffer(text, np.uint8)
                if unit == "bytes":
                    content, starts = text, np.arange(len(data) - length + 1)
                    ends = starts + length
                else:
                    _, starts, ends = layout(unit, data, np.array([0, len(data)]))
                    content, starts, ends = single_spaced(data, starts, ends)
                    starts, ends = starts[: len(starts) - length + 1], ends[length - 1 :]
                d, k = digests_of(content, starts, ends), len(starts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, v, np.int64)) for v in (anchor, f1, f2, n)] + [pa.array(np.arange(k, dtype=np.int32)), pa.array(d[:, 0]), pa.array(d[:, 1])], ["anchor", "f1", "f2", "n", "at", "d1", "d2"])

    rows = stage(texts.mapInArrow(run, "anchor long, f1 long, f2 long, n long, at int, d1 long, d2 long"), "windows")
    twice = rows.groupBy("d1", "d2").agg(F.sum("n").alias("c")).where("c > 1").select("d1", "d2")
    found = rows.join(twice, ["d1", "d2"]).groupBy("anchor", "f1", "f2").agg(F.array_sort(F.collect_list("at")).alias("at"))
    return found.select("anchor", "f1", "f2", F.flatten(F.transform("at", lambda x: F.array(x, x + F.lit(length)))).alias("spans"))


# ---- the whole plan


def cut_texts(docs: DataFrame, wanted: DataFrame, unit: str) -> DataFrame:
    """(anchor, f1, f2, n, text, size): the bytes of the wanted fragments (key, list of anchor, f1, f2, n, start, size)."""

    def run(batches):
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            lists = batch.column("wanted")
            for i, j in chunks(offsets):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                bounds, starts, ends = layout(unit, part, own)
                own_lists = lists.slice(i, j - i)
                flat, ranges = own_lists.flatten(), np.diff(own_lists.offsets.to_numpy())
                if not len(flat):
                    continue
                start, size = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "size"))
                first = np.repeat(bounds[:-1], ranges) + start
                a, b = (first, first + size) if unit == "bytes" else (starts[first], ends[first + size - 1])
                raw = part.tobytes()
                yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in ("anchor", "f1", "f2", "n")), pa.array([raw[x:y] for x, y in zip(a, b)], pa.binary()), pa.array(size.astype(np.int32))], ["anchor", "f1", "f2", "n", "text", "size"])

    # every column goes on, so that Spark deals the texts once for this and for `remove`
    return docs.join(wanted, "key").mapInArrow(run, "anchor long, f1 long, f2 long, n long, text binary, size int")


def remove(docs: DataFrame, spans_of: DataFrame, unit: str, keep_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n, n_removed, n_spans, kept_sha256 of docs (doc_id, key, text) without the spans, and the columns to keep.

    keep_text: also `kept`, the text that is left as bytes: as it was (null included) where nothing goes.
    """

    def run(batches):
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            lists = batch.column("spans")
            for i, j in chunks(offsets):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                bounds, starts, ends = layout(unit, part, own)
                total = int(bounds[-1])
                mark = np.zeros(total + 1, np.int32)
                own_lists = lists.slice(i, j - i).to_pylist()
                for t, pairs in enumerate(own_lists):
                    if pairs:
                        flat = np.concatenate([np.array(p, np.int64) for p in pairs]) + bounds[t]
                        np.add.at(mark, flat[0::2], 1)
                        np.add.at(mark, flat[1::2], -1)
                gone = np.cumsum(mark[:total]) > 0
                upto = np.concatenate([[0], np.cumsum(gone)])
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                begin = bounds[:-1][bounds[:-1] < total]
                opens[begin] = gone[begin]
                runs = np.concatenate([[0], np.cumsum(opens)])
                kept, raw = [], part.tobytes()
                for t in range(j - i):
                    x, y = bounds[t], bounds[t + 1]
                    if unit == "bytes":
                        kept.append(part[x:y][~gone[x:y]].tobytes() if upto[y] > upto[x] else raw[x:y])
                    else:
                        stay = np.flatnonzero(~gone[x:y]) + x
                        kept.append(b" ".join([raw[a:b] for a, b in zip(starts[stay], ends[stay])]))
                columns = [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(bounds).astype(np.int64)), pa.array((upto[bounds[1:]] - upto[bounds[:-1]]).astype(np.int64)), pa.array((runs[bounds[1:]] - runs[bounds[:-1]]).astype(np.int64)), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
                names = ["doc_id", "n", "n_removed", "n_spans", "kept_sha256"]
                if keep_text:
                    gone_in = upto[bounds[1:]] > upto[bounds[:-1]]
                    was = batch.column("text").slice(i, j - i)
                    left = [k if g else raw[a:b] if v else None for k, g, a, b, v in zip(kept, gone_in, own[:-1].tolist(), own[1:].tolist(), was.is_valid().to_pylist())]
                    columns, names = [*columns, pa.array(left, pa.binary())], [*names, "kept"]
                columns, names = [*columns, *(batch.column(c).slice(i, j - i) for c in keep)], [*names, *keep]
                yield pa.RecordBatch.from_arrays(columns, names)

    joined = docs.join(spans_of, "key", "left").select("doc_id", "key", "text", "spans", *keep)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])
    schema = schema.add("kept", T.BinaryType()) if keep_text else schema
    return joined.mapInArrow(run, T.StructType([*schema.fields, *(docs.schema[c] for c in keep)]))


def keyed(docs: DataFrame, number: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, key, text, and what to keep): the key is the row's number, or made of the id and a digest of the text."""
    key = F.col(number) if number else F.xxhash64("doc_id", F.sha2("text", 256))
    return docs.select("doc_id", key.alias("key"), "text", *keep)


def repeated_spans(docs: DataFrame, own: DataFrame, kind: tuple[str, int, int]) -> DataFrame:
    """(key, spans): the repeated parts of each text, as lists of flat (start, end) pairs; own: keyed docs, dealt by key."""
    unit, length, k = kind
    fragments_ = anchors(docs, unit, length, k)
    twice = fragments_.groupBy("anchor").agg(F.sum("seen").alias("c")).where("c > 1").select("anchor")
    live = stage(fragments_.select("key", "anchor", "f1", "f2", "start", "size").join(twice, "anchor"), "live")
    each = live.groupBy("anchor", "f1", "f2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "start", "size")).alias("at"))
    kinds = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("at.size").alias("held"))
    each = stage(each.join(kinds, "anchor"), "texts")
    # an anchor with one text: its weight alone says that all of it is repeated
    whole = (F.col("kinds") == 1) & (F.col("n") > 1)
    huge = F.col("held") > LARGEST * BATCH[unit]

    def texts_of(some) -> DataFrame:
        wanted = each.where(~whole & some).groupBy(F.col("at.key").alias("key")).agg(F.collect_list(F.struct("anchor", "f1", "f2", "n", F.col("at.start").alias("start"), F.col("at.size").alias("size"))).alias("wanted"))
        return cut_texts(own, wanted, unit)

    reported = search_shards(texts_of(~huge).repartition("anchor").sortWithinPartitions("anchor", "f1", "f2"), unit, length)
    if not each.where(~whole & huge).isEmpty():
        rest = texts_of(huge).repartition("anchor", "f1", "f2").sortWithinPartitions("anchor", "f1", "f2")
        reported = reported.unionByName(window_spans(rest, unit, length))
    reported = reported.unionByName(each.where(whole).select("anchor", "f1", "f2", F.array(F.lit(0), F.col("at.size")).alias("spans")))
    hits = live.select("key", "anchor", "f1", "f2", "start").join(reported, ["anchor", "f1", "f2"])
    return hits.select("key", F.transform("spans", lambda s: s + F.col("start")).alias("spans")).groupBy("key").agg(F.collect_list("spans").alias("spans"))


def dedup(docs: DataFrame, kind: tuple[str, int, int], keep_text: bool = False, number: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n, n_removed, n_spans, kept_sha256 of every row (see `remove`); number: a column that numbers the rows."""
    own = keyed(docs, number, keep).repartition("key")  # every later use reads these columns, so Spark deals them once
    return remove(own, repeated_spans(keyed(docs, number), own, kind), kind[0], keep_text, keep)
