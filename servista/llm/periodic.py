"""Runs of words that repeat with a period, found on a harmonic grid (operator 12).

A run is a stretch of words with smallest period q (words q apart are identical) of at least max(12, 2 * q) words that no
neighbouring word extends with that period. For each period p the grid has the places 0, p, 2p, ...: a run with period p is at
least 2p long, so it holds two neighbours jp and (j + 1)p of the grid. How far the texts from both agree forward and backward
gives the run's end and start. Over all periods these are n * ln(n) pairs; a pair whose words differ lies in no run.

1. Words become numbers that no two documents of a step share, so nothing that agrees reaches over a document's bounds.
2. Agreement comes from a suffix array of the step's words (ranks by doubling, sorting only what is still equal), the common prefix
   of neighbours in it, and range minima of these (Index); the same over the words backwards.
3. A run with smallest period q also shows at 2q, 3q, ...: of equal stretches the smallest period counts.

repeats() can first put a run into a text: each word from a on becomes word a + (i - a) mod p. Words are compared by 64-bit hashes.

Edge cases: null, empty and wordless texts have no words, no runs and an empty collapsed text; a null doc_id is hashed as
the empty string; rows that repeat, and rows of equal doc_id, are each treated; an empty table gives no rows. Only doc_id and text are read.
A text is indexed whole in one task: about 100 bytes a word. Words are taken as they are, without lower-casing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common

#: Words that the shortest run has.
LEAST = 12
#: Pairs of the grid, or LCE queries, that are handled at once.
PAIRS = 1 << 19
#: Neighbours in the suffix array of which the range minima keep only the least.
_BLOCK = 16

FIELDS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Index:
    """Longest common extensions of suffixes of a sequence of numbers."""

    def __init__(self, symbols: np.ndarray):
        n = self.n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        rank, live = self._ranks(symbols[order], order, np.zeros(n, np.int64))
        levels, step = [rank], 1  # levels[k][i]: order of the 2**k numbers from i
        while len(live):
            rank = np.append(levels[-1], np.int32(-1))
            key = (rank[live].astype(np.int64) << 32) | (rank[np.minimum(live + step, n)].astype(np.int64) + 1)
            order = np.argsort(key, kind="stable")
            new, still = self._ranks(key[order], live[order], rank[live[order]])
            rank = rank[:-1].copy()
            rank[live] = new[live]
            levels.append(rank)
            live, step = still, 2 * step
        self.rank = levels[-1]
        suffix = np.empty(n, np.int64)
        suffix[self.rank] = np.arange(n)
        self.common = self._neighbours(suffix, levels)
        blocks = self.common.reshape(-1, _BLOCK).min(axis=1)
        self.minima = [blocks]  # sparse table: minima of 1, 2, 4, ... blocks
        while 2 ** len(self.minima) <= len(blocks):
            last, half = self.minima[-1], 2 ** (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def _ranks(self, keys: np.ndarray, at: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the places `at` in the order of keys within those of equal base, by place; and the places that are still equal.

        A rank is the number of suffixes that are less, so it stays as it is for a place that no other equals.
        """
        m = len(keys)
        fresh, opens = np.ones(m, bool), np.ones(m, bool)
        np.not_equal(keys[1:], keys[:-1], out=fresh[1:])
        np.not_equal(base[1:], base[:-1], out=opens[1:])
        here = np.arange(m)
        own, group = (np.maximum.accumulate(np.where(x, here, 0)) for x in (fresh | opens, opens))
        rank = np.zeros(self.n, np.int32)
        rank[at] = base + own - group
        alone = fresh & np.append(fresh[1:], True)
        return rank, np.sort(at[~alone])

    def _neighbours(self, suffix: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Numbers that each suffix shares with the next one in order, up to a whole number of blocks."""
        n = self.n
        shared = np.zeros(-(-max(n, 1) // _BLOCK) * _BLOCK, np.int32)
        near = np.flatnonzero(levels[0][suffix[1:]] == levels[0][suffix[:-1]])  # others share nothing
        a, b = suffix[near], suffix[near + 1]
        h = np.zeros(len(near), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + h, b + h
            inside = np.maximum(x, y) < n
            same = inside & (levels[k][np.where(inside, x, 0)] == levels[k][np.where(inside, y, 0)])
            h += same.astype(np.int64) << k
        shared[near] = h
        return shared

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and at j, i != j; 0 where a place is outside."""
        out = np.zeros(len(i), np.int64)
        ok = np.flatnonzero((np.minimum(i, j) >= 0) & (np.maximum(i, j) < self.n))
        for a in range(0, len(ok), PAIRS):
            some = ok[a : a + PAIRS]
            x, y = self.rank[i[some]], self.rank[j[some]]
            out[some] = self._least(np.minimum(x, y).astype(np.int64), np.maximum(x, y).astype(np.int64))
        return out

    def _least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of common[lo:hi], lo < hi: the two blocks at the ends number by number, the whole ones between by the table."""
        first, last = lo // _BLOCK, (hi - 1) // _BLOCK
        rows = self.common.reshape(-1, _BLOCK)
        place = np.arange(_BLOCK)
        top = np.iinfo(np.int32).max
        head = np.where((place >= (lo - first * _BLOCK)[:, None]) & (place < (hi - first * _BLOCK)[:, None]), rows[first], top).min(axis=1)
        tail = np.where((place < (hi - last * _BLOCK)[:, None]) & (last > first)[:, None], rows[last], top).min(axis=1)
        least = np.minimum(head, tail)
        between = last - first - 1
        for k, table in enumerate(self.minima):
            some = np.flatnonzero((between >= 2**k) & (between < 2 ** (k + 1)))
            if len(some):
                least[some] = np.minimum(least[some], np.minimum(table[first[some] + 1], table[last[some] - 2**k]))
        return least


def grid(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of neighbouring places of the grid, as (sequence, p, jp), about PAIRS at a time: all p up to half a length."""
    half = lengths // 2
    ends = np.cumsum(half)
    step = PAIRS // 4
    for a in range(0, int(ends[-1]) if len(ends) else 0, step):
        which = np.arange(a, min(a + step, int(ends[-1])))
        seq = np.searchsorted(ends, which, side="right")
        p = which - (ends[seq] - half[seq]) + 1
        pairs = np.maximum((lengths[seq] - 1) // p, 0)
        upto = np.cumsum(pairs)
        i = 0
        while i < len(which):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PAIRS, side="right")))
            n = pairs[i:j]
            yield np.repeat(seq[i:j], n), np.repeat(p[i:j], n), common.ranges(np.zeros(j - i, np.int64), n) * np.repeat(p[i:j], n)
            i = j


def find(symbols: np.ndarray, at: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Runs of sequences that lie in a row (n + 1 offsets) and share no number: rows (sequence, start, length, period), in this order."""
    none = np.empty((0, 4), np.int64)
    if not len(symbols):
        return none
    ahead = back = None
    out = [none]
    for seq, p, start in grid(np.diff(at)):
        i = at[seq] + start
        same = symbols[i] == symbols[i + p]
        seq, p, i = seq[same], p[same], i[same]
        if not len(i):
            continue
        if ahead is None or back is None:
            ahead, back = Index(symbols), Index(symbols[::-1])
        f = ahead.lce(i, i + p)
        b = back.lce(len(symbols) - i, len(symbols) - (i + p))
        long = p + f + b >= np.maximum(least, 2 * p)
        out.append(np.unique(np.stack([seq, i - b - at[seq], p + f + b, p], axis=1)[long], axis=0))
    runs = np.unique(np.concatenate(out), axis=0)
    fresh = np.ones(len(runs), bool)  # the same stretch again, with a larger period
    fresh[1:] = (runs[1:, :3] != runs[:-1, :3]).any(axis=1)
    runs = runs[fresh]
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def put_in(at: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """For each word of texts with word offsets `at`, the word that stands there after a run is put in where crc % 10 = 0."""
    src = np.arange(at[-1])
    for t in np.flatnonzero((crc % 10 == 0) & (np.diff(at) > 0)).tolist():
        n, g = int(at[t + 1] - at[t]), int(crc[t]) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        src[at[t] + a : at[t + 1]] = at[t] + a + np.arange(n - a) % p
    return src


def repeats(docs: DataFrame, seeded: bool = False) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed (the text without what a run repeats) for each row.

    seeded: put_in() a run by the crc32 of doc_id first, a known answer for every tenth document or so.
    """
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = common.text_only(docs).select("doc_id", "text", crc.alias("crc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            data, offs = common.text_arrays(b.column(1))
            starts, ends, at = common.words(data, offs)
            texts = np.repeat(np.arange(b.num_rows), np.diff(at))
            if seeded:
                src = put_in(at, b.column(2).to_numpy())
                starts, ends = starts[src], ends[src]
            word = common.span_hash(common.prefix_hash(data), starts, ends)
            own = common.mix(texts.astype(np.uint64) + np.uint64(1))
            runs = find(np.unique(common.mix(word ^ own), return_inverse=True)[1].astype(np.int32), at)
            seq, first, length, period = runs.T
            cover = np.zeros(len(starts) + 1, np.int64)  # +1 where what a run repeats begins, -1 where it ends
            np.add.at(cover, at[seq] + first + period, 1)
            np.add.at(cover, at[seq] + first + length, -1)
            kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
            size = ends[kept] - starts[kept] + 1
            joined = np.append(data, np.uint8(0x20))[common.ranges(starts[kept], size)]
            until = np.cumsum(size)
            joined[until - 1] = 0x20
            last = np.append(0, until)[np.searchsorted(texts[kept], np.arange(b.num_rows + 1))]  # bytes of all texts before
            raw = joined.tobytes()
            collapsed = [raw[a : max(a, z - 1)] for a, z in zip(last[:-1].tolist(), last[1:].tolist(), strict=True)]
            of = np.searchsorted(seq, np.arange(b.num_rows + 1)).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(of), pa.StructArray.from_arrays([pa.array(x) for x in (first, length, period)], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at)), listed, pa.array(collapsed, pa.binary()).view(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, FIELDS)


def longest(runs: Column) -> Column:
    """The run of greatest length, of these the one with the smallest start, then period."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r.length.alias("length"), (-r.start).alias("before"), (-r.period).alias("less"))))


def digest(docs: DataFrame) -> DataFrame:
    """repeats()'s rows, with a run put into every tenth text: their number, the longest run, and SHA-256 of all runs and of the collapsed text."""
    made = repeats(docs, seeded=True).withColumn("best", longest(F.col("runs")))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))))
    length, period = F.col("best.length"), -F.col("best.less")
    return made.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.before")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("1000 * best.length div -best.less").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
