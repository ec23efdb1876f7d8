"""Hierarchical Pitman-Yor language model, seated by Gibbs sampling, over all training documents (operator 7).

A text is its words and one end token. The restaurant of a context, which is the whole word before or the text's begin,
serves words. Contexts that end alike (in the same two bytes) share a parent restaurant, these parents share a root, and
the root's base is uniform over the V known words and one unknown word. Each customer sits at a table, each table sends
a customer to the restaurant above. With customers c, tables t, discount d and strength s

    P(w | u) = (c_uw - d t_uw + (s + d t_u) P(w | parent of u)) / (s + c_u).

Sampling: the customers of a cell (restaurant, word) leave and come back one after another, given all other cells. With
t tables of its own so far, the next one opens a table with weight (s + d (t_others + t)) P(w | parent), in which the
cell's own tables count as customers of the parent, and sits at one there is with weight j - d t after j customers.
After BURN sweeps the predictive probabilities of KEEP more are averaged.

Where things are: cells are dealt into buckets by word, so a word's cells of all three levels are together; a word with
more tokens than SPREAD buckets hold is dealt on by the class of its contexts, and the driver keeps its root cell. What
a bucket knows of the others are the totals of each restaurant. Totals of contexts are summed in tasks of their
own, by ranges of contexts, and sent back to the buckets that have the context, before the first sweep, after BURN and
after the last; own changes count at once. The seatings between are kept as a table. To the driver come the totals of classes (65,536 at most) and of the words dealt on
(65,536 at most, as each is at least HOT_SHARE of all tokens).

Nothing is cut off: every training word of every text is a customer. Texts are dealt into batches; a batch sends each
bucket its distinct cells with counts, and gets one probability a cell back in the same order, to 2**-27 in log10. Rows
of packed cells, and of packed totals, are never more than the cells they hold. Words and contexts are known by hashes
of 64 and 48 bits.

Edge cases: null and empty texts are the end token alone; words never seen in training have c = 0 and the unknown
word's probability; without training documents N = V = 0 and both scores are finite; a null doc_id counts as training;
rows that repeat count each time; a text longer than a batch is a batch; an empty table gives no rows. Only doc_id and
text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from . import common

#: Of the root, classes and contexts.
DISCOUNT, STRENGTH = (0.8, 0.7, 0.6), (1.0, 2.0, 0.5)
BURN, KEEP = 2, 3
#: Text bytes of a batch and of a bucket (both about); buckets' worth of tokens beyond which a word is dealt on.
BATCH_BYTES, BUCKET_BYTES, SPREAD = 12 << 20, 8 << 20, 2
#: Least share of a batch's tokens, and of all tokens, of a word that is dealt on.
HOT_SHARE = 2**-16
CLASSES = 1 << 16
#: Tasks that buckets, ranges of contexts or batches are dealt over at most.
TASKS = 50_000
#: The class and the context of the begin of a text, which no UTF-8 text has.
BEGIN_CLASS = 0xFFFF
BEGIN = np.uint64(BEGIN_CLASS << 32)
#: The end token's hash; words hash to other values but for one chance in 2**64.
END = np.uint64(0x5BD1E9955BD1E995)
#: Fixed-point log10 probabilities.
SCALE = 1 << 27


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and contexts (class << 32 | hash of the word before) of texts in a row, an end token after each, and n+1
    token offsets."""
    data = common.lower_ascii(data)
    starts, ends, at = common.words(data, offs)
    n_texts = len(offs) - 1
    upto = at + np.arange(n_texts + 1)
    words = np.empty(len(starts) + n_texts, np.uint64)
    context = np.empty(len(words), np.uint64)
    is_end = np.zeros(len(words), bool)
    is_end[upto[1:] - 1] = True
    words[is_end] = END
    if len(starts):
        own = common.span_hash(common.prefix_hash(data), starts, ends)
        words[~is_end] = own
        before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
        context[np.flatnonzero(~is_end) + 1] = (before << np.uint64(40)) | (data[ends - 1].astype(np.uint64) << np.uint64(32)) | (own >> np.uint64(32))
    context[upto[:-1]] = BEGIN
    return words, context, upto


def _class(context: np.ndarray) -> np.ndarray:
    return (context >> np.uint64(32)).astype(np.int64)


def _cells(words: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by word and context, and where in it each distinct cell begins."""
    order = np.argsort(context, kind="stable")
    order = order[np.argsort(words[order], kind="stable")]
    w, u = words[order], context[order]
    return order, np.flatnonzero(_fresh(w) | _fresh(u))


def _fresh(x: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays under zstd, each with its first bytes first, its second bytes next and so on."""
    return zstandard.compress(b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays), 1)


def _unpack(data: bytes, n: int, *kinds) -> list[np.ndarray]:
    raw, out, at = zstandard.decompress(data), [], 0
    for k in kinds:
        width = np.dtype(k).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(k).reshape(n))
        at += n * width
    return out


def _steps(w: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers, the first one whole."""
    return np.diff(w, prepend=np.zeros(1, w.dtype))


def deal(docs: DataFrame) -> DataFrame:
    """A row for each batch of about BATCH_BYTES of texts that lie together: batch, doc_ids, held_out, sizes, packed, bytes,
    and its tokens and frequent words with their counts.

    A batch is a stretch of an input partition, so texts aren't shuffled to make it.
    """
    schema = pa.schema([("batch", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("packed", pa.binary()), ("bytes", pa.int64()), ("tokens", pa.int64()), ("word", pa.list_(pa.int64())), ("count", pa.list_(pa.int64()))])

    def flush(part: int, k: int, held: list) -> pa.RecordBatch:
        ids, out, sizes = ([x for h in held for x in h[i]] for i in range(3))
        raw = b"".join(h[3] for h in held)
        w, _, upto = _batch_tokens(sizes, raw)
        slot = (w >> np.uint64(48)).astype(np.int64)  # only words of slots with so many tokens are counted one by one
        w, c = np.unique(w[np.bincount(slot, minlength=1 << 16)[slot] >= HOT_SHARE * len(w)], return_counts=True)
        often = c >= HOT_SHARE * upto[-1]
        row = {"batch": (part << 20) | k, "doc_ids": ids, "held_out": out, "sizes": sizes, "packed": zstandard.compress(raw, 1), "bytes": len(raw), "tokens": int(upto[-1]), "word": w[often].view(np.int64).tolist(), "count": c[often].tolist()}
        return pa.RecordBatch.from_pylist([row], schema)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean_memory(8)  # its arrays are large and many
        held, size, k, part = [], 0, 0, 0
        for b in common.slices(rows):
            data, offs = common.text_arrays(b.column(1))
            part = b.column(3)[0].as_py()
            held.append((b.column(0).to_pylist(), b.column(2).to_pylist(), np.diff(offs).tolist(), data.tobytes()))
            size += len(data)
            if size >= BATCH_BYTES:
                yield flush(part, k, held)
                held, size, k = [], 0, k + 1
        if held:
            yield flush(part, k, held)

    rows = common.text_only(docs, "held_out").withColumn("part", F.spark_partition_id())
    return rows.mapInArrow(run, "batch long, doc_ids array<long>, held_out array<boolean>, sizes array<long>, packed binary, bytes long, tokens long, word array<long>, count array<long>")


def _batch_tokens(sizes: list[int], raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """tokens() of a whole batch, made in steps."""
    data, offs = np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    w, u, upto, i, n = [], [], [np.zeros(1, np.int64)], 0, 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + common.STEP_BYTES, "right")) - 1)
        a, b, c = tokens(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        w, u, upto, i, n = [*w, a], [*u, b], [*upto, c[1:] + n], j, n + len(a)
    return np.concatenate(w), np.concatenate(u), np.concatenate(upto)


class Deal:
    """Which bucket a cell is in: by its word's top bits, or, for words dealt on, by word and the context's class."""

    def __init__(self, buckets: int, hot: dict[int, int], batches: int = 1):
        self.buckets, self.batches = buckets, batches
        self.words = np.array(sorted(hot), np.uint64)
        self.parts = np.array([hot[w] for w in sorted(hot)], np.int64)
        self.first = buckets + np.cumsum(self.parts) - self.parts

    def group(self, df: DataFrame, key: str):
        """df's groups of a key, about one a task."""
        n = self.batches if key == "batch" else self.buckets + int(self.parts.sum())
        return df.repartition(max(1, min(n, TASKS)), key).groupBy(key)

    def range(self, context: np.ndarray) -> np.ndarray:
        """Which of as many ranges as there are buckets a context's totals are summed in."""
        return (common.mix(context * common.BASE) % np.uint64(self.buckets)).astype(np.int64)

    def place(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether words are dealt on, and their places among those that are."""
        if not len(self.words):
            return np.zeros(len(words), bool), np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return self.words[at] == words, at

    def bucket(self, words: np.ndarray, context: np.ndarray) -> np.ndarray:
        out = (((words >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)).astype(np.int64)
        is_hot, at = self.place(words)
        if is_hot.any():
            spread = common.mix((context[is_hot] >> np.uint64(32)) * common.BASE)
            out[is_hot] = self.first[at[is_hot]] + (spread % self.parts[at[is_hot]].astype(np.uint64)).astype(np.int64)
        return out


def gather(dealt: DataFrame, how: Deal) -> DataFrame:
    """(batch, bucket, n, cells): each batch's distinct cells by word and context, with training counts."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for i in range(b.num_rows):
                batch, out, sizes, packed = (b.column(k)[i].as_py() for k in range(4))
                w, u, upto = _batch_tokens(sizes, zstandard.decompress(packed))
                order, at = _cells(w, u)
                train = np.repeat(~np.array(out, bool), np.diff(upto)).astype(np.uint32)
                w, u, c = w[order[at]], u[order[at]], np.add.reduceat(train[order], at)
                bucket = how.bucket(w, u)
                if len(how.words):
                    order = np.argsort(bucket, kind="stable")
                    w, u, c, bucket = w[order], u[order], c[order], bucket[order]
                a = np.flatnonzero(_fresh(bucket)).tolist()
                cut = [*zip(a, [*a[1:], len(bucket)], strict=True)]
                blobs = [_pack(_steps(w[a:z]), u[a:z], c[a:z]) for a, z in cut]
                yield pa.RecordBatch.from_arrays([pa.array([batch] * len(cut), pa.int64()), pa.array(bucket[a], pa.int64()), pa.array([z - a for a, z in cut], pa.int64()), pa.array(blobs, pa.binary())], ["batch", "bucket", "n", "cells"])

    return dealt.select("batch", "held_out", "sizes", "packed").mapInArrow(run, "batch long, bucket long, n long, cells binary")


_TABLE = pa.schema([("bucket", pa.int64()), ("n", pa.int64()), ("n_contexts", pa.int64()), ("words", pa.binary()), ("cells", pa.binary()), ("contexts", pa.binary()), ("asked", pa.list_(pa.struct([("batch", pa.int64()), ("n", pa.int64()), ("index", pa.binary())])))])
_TABLE_DDL = "bucket long, n long, n_contexts long, words binary, cells binary, contexts binary, asked array<struct<batch: long, n: long, index: binary>>"


def tabulate(requests: DataFrame, how: Deal) -> DataFrame:
    """A row for each bucket: its cells by word and context, its distinct contexts, and for each batch the places of the cells
    it asks for."""

    def run(key, t):
        ns, got = t["n"].to_pylist(), []
        for n, blob in zip(ns, t["cells"].to_pylist(), strict=True):
            w, u, c = _unpack(blob, n, np.uint64, np.uint64, np.uint32)
            got.append((np.cumsum(w, dtype=np.uint64), u, c))
        w, u, c = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        order, at = _cells(w, u)
        place = np.empty(len(w), np.uint32)
        place[order] = np.repeat(np.arange(len(at), dtype=np.uint32), np.diff(np.append(at, len(w))))
        w, u, c = w[order[at]], u[order[at]], np.add.reduceat(c[order].astype(np.int64), at)
        asked = [{"batch": b, "n": n, "index": _pack(_steps(place[z - n : z]))} for b, n, z in zip(t["batch"].to_pylist(), ns, np.cumsum(ns).tolist(), strict=True)]
        contexts, nth = np.unique(u, return_inverse=True)
        row = {"bucket": key[0].as_py(), "n": len(w), "n_contexts": len(contexts), "words": _pack(_steps(w)), "cells": _pack(nth.astype(np.uint32), c.astype(np.uint32)), "contexts": _pack(_steps(contexts)), "asked": asked}
        return pa.Table.from_pylist([row], _TABLE)

    return how.group(requests, "bucket").applyInArrow(run, _TABLE_DDL)


def seat(customers: np.ndarray, strength: np.ndarray, d: float, above: tuple, rng: np.random.Generator) -> np.ndarray:
    """Tables of cells whose customers come one after another.

    strength is s + d * (tables of the others in the restaurant); above is (x, y, n): while a cell has t tables, the parent's
    probability of its word is (x + y t) / (n + y t). Customers come one by one up to 64; from there in runs of a 64th of those
    seated, whose openings are binomial at the chance in the middle of the run.
    """
    out = np.minimum(customers, 1).astype(np.int64)
    some = np.flatnonzero(customers > 1)
    some = some[np.argsort(-customers[some], kind="stable")]
    left, tables = customers[some], np.ones(len(some))
    x, y, n, strength = (np.broadcast_to(np.asarray(a, np.float64), len(customers))[some] for a in (*above, strength))
    j, most = 1, int(left[0]) if len(left) else 0

    def chance(k: int, j: np.ndarray | int, t: np.ndarray) -> np.ndarray:
        own = y[:k] * t
        w = (strength[:k] + d * t) * (x[:k] + own) / (n[:k] + own)
        return w / (w + np.maximum(j - d * t, 1e-12))

    while j < most:
        step = max(1, j // 64)
        k = int(np.searchsorted(-left, -j, "left"))  # cells with more than j customers
        p = chance(k, j, tables[:k])
        if step == 1:
            tables[:k] += rng.random(k) < p
        else:
            more = np.minimum(left[:k] - j, step)
            tables[:k] += rng.binomial(more, chance(k, j + more / 2, tables[:k] + p * more / 2))
        j += step
    out[some] = tables.astype(np.int64)
    return out


class Totals:
    """What the driver knows after an exchange: customers and tables of each class and of the root, of each kept seating, v
    distinct words, n tokens, and counts, customers and tables of the words dealt on. Own sums of a bucket have the same form."""

    def __init__(self, v: int, n: int, c2: np.ndarray, t2: np.ndarray, c3: int, t3: int, hot_c3: np.ndarray, hot_t3: np.ndarray, hot_count: np.ndarray):
        self.v, self.n, self.c2, self.t2, self.c3, self.t3 = v, n, c2, t2, c3, t3
        self.hot_c3, self.hot_t3, self.hot_count = hot_c3, hot_t3, hot_count


class Bucket:
    """The cells of a bucket at all three levels, and their tables; cells without customers have none.

    total is what the last exchange told of all buckets, tables the same of contexts; own sums at that time are kept,
    so that the others' are known.
    """

    def __init__(self, words: np.ndarray, nth: np.ndarray, contexts: np.ndarray, count: np.ndarray, how: Deal):
        self.contexts, self.nth, self.c = contexts, nth.astype(np.int64), count.astype(np.int64)
        self.group = _class(contexts)  # of each context
        group = self.group[self.nth]
        fresh_word = _fresh(words)
        fresh = fresh_word | _fresh(group)
        self.of = np.cumsum(fresh) - 1  # class cell of a cell
        self.cell_group = group[fresh]
        self.word_of = (np.cumsum(fresh_word) - 1)[fresh]  # word of a class cell
        self.words = words[fresh_word]
        self.n_words, self.n_cells = len(self.words), len(self.cell_group)
        self.word_c = np.bincount(self.word_of[self.of], self.c, minlength=self.n_words).astype(np.int64)
        self.hot, self.hot_at = how.place(self.words)
        self.t = np.minimum(self.c, 1 + (self.c > 3) + (self.c > 30))
        self.some = np.flatnonzero(self.c > 1)  # a single customer has a table
        self.t2 = np.minimum(self.c2(), 1)
        self.t3 = np.where(self.hot, 0, np.minimum(self.c3(), 1))

    def c2(self) -> np.ndarray:
        """Customers of each class cell: its contexts' tables."""
        return np.bincount(self.of, self.t, minlength=self.n_cells).astype(np.int64)

    def c3(self) -> np.ndarray:
        """Customers of each word in the root."""
        return np.bincount(self.word_of, self.t2, minlength=self.n_words).astype(np.int64)

    def context_sums(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.nth, x, minlength=len(self.contexts)).astype(np.int64)

    def class_sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each class."""
        return (np.bincount(self.cell_group, x, minlength=CLASSES).astype(np.int64) for x in (self.c2(), self.t2))

    def state(self) -> list[bytes]:
        return [_pack(x.astype(np.uint32)) for x in (self.t, self.t2, self.t3)]

    def restore(self, state: list[bytes]) -> None:
        self.t, self.t2, self.t3 = (_unpack(x, n, np.uint32)[0].astype(np.int64) for x, n in zip(state, (len(self.c), self.n_cells, self.n_words), strict=True))

    def told(self, total: Totals, customers: np.ndarray, tables: np.ndarray) -> None:
        """The totals after an exchange, from which own later changes are counted."""
        self.total, self.customers, self.tables = total, customers, tables
        self.then = self.context_sums(self.t), *self.class_sums(), self.c3().sum(), self.t3.sum()

    def sweep(self, rng: np.random.Generator) -> None:
        """Draw the tables of each context's cell, then of each class's, then of each word in the root, given all others."""
        total, then = self.total, self.then
        some, of = self.some, self.of[self.some]
        own2, own_t2 = self.class_sums()
        t2_all, c2_all = total.t2 - then[2] + own_t2, total.c2 - then[1] + own2
        c2, group = self.c2(), self.cell_group
        root = self.root()
        # contexts: the parent without the cell's own tables
        others = (self.tables - then[0] + self.context_sums(self.t))[self.nth[some]] - self.t[some]
        rest = c2[of] - self.t[some]
        d, s = DISCOUNT[1], STRENGTH[1]
        x = rest - d * np.minimum(self.t2[of], rest) + (s + d * np.maximum(t2_all[group[of]], 0)) * root[self.word_of[of]]
        n = s + np.maximum(c2_all[group[of]] - self.t[some], rest)
        self.t[some] = seat(self.c[some], STRENGTH[2] + DISCOUNT[2] * np.maximum(others, 0), DISCOUNT[2], (x, 1, n), rng)
        # classes
        c2, c3 = self.c2(), self.c3()
        rest, d, s = c3[self.word_of] - self.t2, DISCOUNT[0], STRENGTH[0]
        c3_all, t3_all = total.c3 - then[3] + c3.sum(), total.t3 - then[4] + self.t3.sum()
        x = rest - d * np.minimum(self.t3[self.word_of], rest) + (s + d * max(t3_all, 0)) / (total.v + 1)
        n = s + np.maximum(c3_all - self.t2, rest)
        is_hot = self.hot[self.word_of]
        if is_hot.any():  # their root cells are the driver's
            at = self.hot_at[self.word_of[is_hot]]
            x[is_hot], n[is_hot] = total.hot_c3[at] - d * total.hot_t3[at] + (s + d * t3_all) / (total.v + 1), s + c3_all
        self.t2 = seat(c2, STRENGTH[1] + DISCOUNT[1] * np.maximum(t2_all[group] - self.t2, 0), DISCOUNT[1], (x, ~is_hot, n), rng)
        # the root
        c3 = np.where(self.hot, 0, self.c3())
        self.t3 = seat(c3, STRENGTH[0] + DISCOUNT[0] * np.maximum(t3_all - self.t3, 0), DISCOUNT[0], (1.0, 0, float(total.v + 1)), rng)

    def root(self, total: Totals | None = None) -> np.ndarray:
        """P(w) for each word: as things are here, or with the totals given."""
        d, s = DISCOUNT[0], STRENGTH[0]
        c3, t3 = self.c3(), self.t3
        if total is None:
            total, then = self.total, self.then
            c3_all, t3_all = total.c3 - then[3] + c3.sum(), total.t3 - then[4] + t3.sum()
        else:
            c3_all, t3_all = total.c3, total.t3
        if self.hot.any():
            c3, t3 = np.where(self.hot, total.hot_c3[self.hot_at], c3), np.where(self.hot, total.hot_t3[self.hot_at], t3)
        return (c3 - d * t3 + (s + d * t3_all) / (total.v + 1)) / (s + c3_all)

    def predictive(self, total: Totals, tables: np.ndarray) -> np.ndarray:
        """P(w | u) for each cell, given the totals of this seating and the tables of its contexts."""
        d, s = DISCOUNT[1], STRENGTH[1]
        g = self.cell_group
        parent = (self.c2() - d * self.t2 + (s + d * total.t2[g]) * self.root(total)[self.word_of]) / (s + total.c2[g])
        d, s = DISCOUNT[2], STRENGTH[2]
        return (self.c - d * self.t + (s + d * tables[self.nth]) * parent[self.of]) / (s + self.customers[self.nth])

    def counts(self, total: Totals) -> np.ndarray:
        """Training tokens of each word."""
        return np.where(self.hot, total.hot_count[self.hot_at], self.word_c) if self.hot.any() else self.word_c


def _bucket(n: int, n_contexts: int, words: bytes, cells: bytes, contexts: bytes, how: Deal) -> Bucket:
    w, (nth, c), u = _unpack(words, n, np.uint64)[0], _unpack(cells, n, np.uint32, np.uint32), _unpack(contexts, n_contexts, np.uint64)[0]
    return Bucket(np.cumsum(w, dtype=np.uint64), nth, np.cumsum(u, dtype=np.uint64), c, how)


def _seatings(b: Bucket, number: int, totals: list[list[Totals]], told: list[list[np.ndarray]], state: list[bytes]) -> Iterator[None]:
    """Goes through the seatings up to the next exchange: the one at the start, after BURN, then each kept one.

    totals[r] and told[r] are what exchange r told, state the seating at the last one.
    """
    done = len(totals)
    if done:
        b.restore(state)
        b.told(totals[-1][0], told[0][0], told[-1][-1])
        for k in range(BURN if done == 1 else KEEP):
            b.sweep(np.random.default_rng([done, k, number]))
            if done == 2:
                yield
    if done < 2:
        yield


#: What a pass over the buckets gives: for ranges of contexts their sums, and sums for the driver by key: class (of the
#: k-th seating, k * CLASSES on), the root (-1 - k), and words dealt on (negative of CLASSES and more: count and customers).
_OUT = pa.schema([("bucket", pa.int64()), ("out", pa.list_(pa.struct([("range", pa.int64()), ("n", pa.int64()), ("sums", pa.binary())]))), ("key", pa.list_(pa.int64())), ("c", pa.list_(pa.int64())), ("t", pa.list_(pa.int64())), ("words", pa.int64()), ("tokens", pa.int64()), ("state", pa.list_(pa.binary()))])
_OUT_DDL = "bucket long, out array<struct<range: long, n: long, sums: binary>>, key array<long>, c array<long>, t array<long>, words long, tokens long, state array<binary>"


#: Columns of sums of each exchange: customers and tables, tables, tables of each kept seating.
_COLUMNS = (2, 1, KEEP)


_INBOX = "bucket long, round int, range long, n long, sums binary, state array<binary>"


def _inbox(inbox: pa.Table, rounds: int, b: Bucket, how: Deal) -> tuple[list[list[np.ndarray]], list[bytes]]:
    """For each exchange so far its columns over the bucket's contexts; the state, which has round -1."""
    state: list[bytes] = []
    out = [[np.zeros(len(b.contexts), np.int64) for _ in range(_COLUMNS[r])] for r in range(rounds)]
    at = how.range(b.contexts)
    order = np.argsort(at, kind="stable")
    at = at[order]
    for r, k, n, sums, own_state in zip(*(inbox[c].to_pylist() for c in ("round", "range", "n", "sums", "state")), strict=True):
        if r < 0:
            state = own_state
            continue
        place = order[np.searchsorted(at, k) :][:n]
        for own, col in zip(out[r], _unpack(sums, n, *[np.uint32] * _COLUMNS[r]), strict=True):
            own[place] = col
    return out, state


def advance(table: DataFrame, told: DataFrame | None, totals: list[list[Totals]], how: Deal) -> DataFrame:
    """Each bucket's seatings up to the next exchange, and their sums."""
    rounds = len(totals)

    def work(number, n, n_contexts, words, cells, contexts, inbox) -> pa.Table:
        b = _bucket(n, n_contexts, words, cells, contexts, how)
        got, state = _inbox(inbox, rounds, b, how) if rounds else ([], [])
        columns, key, cs, ts, states = [b.context_sums(b.c)] if rounds == 0 else [], [], [], [], []
        for k, _ in enumerate(_seatings(b, number, totals, got, state)):
            states += b.state()
            columns.append(b.context_sums(b.t))
            c2, t2 = b.class_sums()
            used = np.flatnonzero(c2)
            key += [*(used + k * CLASSES).tolist(), -1 - k]
            cs += [*c2[used].tolist(), int(b.c3().sum())]
            ts += [*t2[used].tolist(), int(b.t3.sum())]
            is_hot = np.flatnonzero(b.hot)
            c3 = b.c3()
            key += (-(1 + k) * CLASSES - b.hot_at[is_hot]).tolist()
            cs += (b.word_c[is_hot] if rounds == 0 else np.zeros(len(is_hot), np.int64)).tolist()
            ts += c3[is_hot].tolist()
        at = how.range(b.contexts)
        order = np.argsort(at, kind="stable")
        cut = np.flatnonzero(_fresh(at[order])) if len(at) else np.zeros(0, np.int64)
        out = [{"range": int(at[order[a]]), "n": int(z - a), "sums": _pack(_steps(b.contexts[order[a:z]]), *[x[order[a:z]].astype(np.uint32) for x in columns])} for a, z in zip(cut, np.append(cut[1:], len(at)), strict=True)]
        return pa.Table.from_pylist([{"bucket": number, "out": out, "key": key, "c": cs, "t": ts, "words": int(((b.word_c > 0) & ~b.hot).sum()), "tokens": int(b.c.sum()), "state": states}], _OUT)

    static = table.select("bucket", "n", "n_contexts", "words", "cells", "contexts")
    if told is None:

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common.lean_memory(8)
            for rows in batches:
                for i in range(rows.num_rows):
                    yield from work(*(rows.column(k)[i].as_py() for k in range(6)), None).to_batches()

        return static.mapInArrow(alone, _OUT_DDL)

    def both(key, left, right):
        common.lean_memory(8)
        return work(*(left[c][0].as_py() for c in ("bucket", "n", "n_contexts", "words", "cells", "contexts")), right)

    return how.group(static, "bucket").cogroup(how.group(told, "bucket")).applyInArrow(both, _OUT_DDL)


def exchange(sums: DataFrame, number: int, how: Deal) -> DataFrame:
    """For the inbox: for each bucket's contexts of a range, in its order, the sums over all buckets."""
    columns = _COLUMNS[number]

    def run(key, t):
        ns, got = t["n"].to_pylist(), []
        for n, blob in zip(ns, t["sums"].to_pylist(), strict=True):
            u, *cols = _unpack(blob, n, np.uint64, *[np.uint32] * columns)
            got.append((np.cumsum(u, dtype=np.uint64), *cols))
        u, *cols = (np.concatenate(x) for x in zip(*got, strict=True))
        _, nth = np.unique(u, return_inverse=True)
        cols = [np.bincount(nth, x).astype(np.uint32)[nth] for x in cols]
        ends = np.cumsum(ns).tolist()
        back = [_pack(*[x[z - n : z] for x in cols]) for n, z in zip(ns, ends, strict=True)]
        return pa.table({"bucket": t["bucket"], "round": pa.array([number] * len(ns), pa.int32()), "range": t["range"], "n": t["n"], "sums": pa.array(back, pa.binary()), "state": pa.nulls(len(ns), pa.list_(pa.binary()))})

    each = sums.select("bucket", F.inline("out"))
    return how.group(each, "range").applyInArrow(run, _INBOX)


def summed(sums: DataFrame, how: Deal, before: list[list[Totals]], seed: int) -> list[Totals]:
    """The driver's totals of each seating: at most one row a class, and one a word dealt on."""
    seatings = KEEP if len(before) == 2 else 1
    c2, t2 = np.zeros((seatings, CLASSES), np.int64), np.zeros((seatings, CLASSES), np.int64)
    c3, t3 = [0] * seatings, [0] * seatings
    hot_c3, hot_count = np.zeros((seatings, len(how.words)), np.int64), np.zeros(len(how.words), np.int64)
    v = n = 0
    for r in sums.select("words", "tokens", F.inline(F.arrays_zip("key", "c", "t"))).groupBy("key").agg(F.sum("c").alias("c"), F.sum("t").alias("t"), F.sum("words").alias("v"), F.sum("tokens").alias("n")).collect():
        k = r["key"]
        if k >= 0:
            c2[k // CLASSES, k % CLASSES], t2[k // CLASSES, k % CLASSES] = r["c"], r["t"]
        elif k > -CLASSES:
            c3[-1 - k], t3[-1 - k], v, n = r["c"], r["t"], r["v"], r["n"]
        else:
            seating, at = divmod(-k - CLASSES, CLASSES)
            hot_c3[seating, at] = r["t"]
            if not before:
                hot_count[at] = r["c"]
    if before:
        hot_count, v, n = before[0][0].hot_count, before[0][0].v, before[0][0].n
    else:
        v += int((hot_count > 0).sum())
    out, last = [], before[-1][-1].hot_t3 if before else np.minimum(hot_c3[0], 1)
    for k in range(seatings):
        if before:
            tables = STRENGTH[0] + DISCOUNT[0] * np.maximum(t3[k] + last.sum() - last, 0)
            last = seat(hot_c3[k], tables, DISCOUNT[0], (1.0, 0, float(v + 1)), np.random.default_rng([seed, k]))
        out.append(Totals(v, n, c2[k], t2[k], c3[k], t3[k] + int(last.sum()), hot_c3[k], last, hot_count))
    return out


def answer(table: DataFrame, told: DataFrame, totals: list[list[Totals]], how: Deal) -> DataFrame:
    """(batch, bucket, n, words): for the cells a batch asked for, in its order, the word's training count and log10 of the
    averaged P(w | u)."""
    schema = pa.schema([("batch", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("words", pa.binary())])

    def run(key, left, right):
        common.lean_memory(8)
        number, n, n_contexts, words, cells, contexts, asked = (left[c][0].as_py() for c in ("bucket", "n", "n_contexts", "words", "cells", "contexts", "asked"))
        b = _bucket(n, n_contexts, words, cells, contexts, how)
        got, states = _inbox(right, 3, b, how)
        b.customers = got[0][0]
        p = np.zeros(n)
        for k in range(KEEP):
            b.restore(states[3 * k : 3 * k + 3])
            p += b.predictive(totals[2][k], got[2][k])
        p = np.rint(-np.log10(p / KEEP) * SCALE).astype(np.uint32)
        count = b.counts(totals[0][0])[b.word_of[b.of]].astype(np.uint32)
        out = []
        for x in asked:
            at = np.cumsum(_unpack(x["index"], x["n"], np.uint32)[0], dtype=np.uint32)
            out.append({"batch": x["batch"], "bucket": number, "n": x["n"], "words": _pack(count[at], p[at])})
        return pa.Table.from_pylist(out, schema)

    return how.group(table, "bucket").cogroup(how.group(told, "bucket")).applyInArrow(run, "batch long, bucket long, n long, words binary")


FIELDS = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def plan(dealt: DataFrame) -> Deal:
    """How cells are dealt; only the place of the work depends on it, and that sums from other buckets are of the last exchange."""
    size = dealt.agg(F.sum("bytes").alias("b"), F.sum("tokens").alias("n"), F.count("*").alias("batches")).first()
    buckets = max(8, (size["b"] or 0) // BUCKET_BYTES)
    n = size["n"] or 0
    most = max(SPREAD * n // buckets, HOT_SHARE * n, 1)
    often = dealt.select(F.inline(F.arrays_zip("word", "count"))).groupBy("word").agg(F.sum("count").alias("n")).filter(F.col("n") > most)
    return Deal(buckets, {r["word"] % 2**64: math.ceil(r["n"] / most) for r in often.collect()}, size["batches"])


def train(table: DataFrame, how: Deal) -> tuple[list[list[Totals]], DataFrame]:
    """The driver's totals of all three exchanges, and the buckets' inbox after them: what they told, and the kept seatings."""
    totals: list[list[Totals]] = []
    told = inbox = None
    for number in range(len(_COLUMNS)):
        with common.scratch(advance(table, inbox, totals, how), "sums") as sums:
            new = common.materialise(exchange(sums, number, how), "totals")
            kept = sums.select("bucket", F.lit(-1).alias("round"), F.lit(0).cast("long").alias("range"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("sums"), "state")
            kept = common.materialise(kept, "seatings")
            totals = [*totals, summed(sums, how, totals, number)]
        told = new if told is None else told.union(new)
        inbox = told.union(kept)
    return totals, inbox


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity for each row of docs."""
    dealt = common.materialise(deal(docs.select("doc_id", "text", held_out.alias("held_out"))), "batches")
    how = plan(dealt)
    with common.scratch(tabulate(gather(dealt, how), how), "cells") as table:
        totals, inbox = train(table, how)
        answers = common.materialise(answer(table, inbox, totals, how), "answers")
    n, v = totals[0][0].n, totals[0][0].v
    base_all = math.log10(n + 0.1 * (v + 1))

    def run(key, batch, told):
        common.lean_memory(8)
        order = np.argsort(told["bucket"].to_numpy())
        ns, blobs = told["n"].to_pylist(), told["words"].to_pylist()
        c, p = (np.concatenate(x) for x in zip(*[_unpack(blobs[i], ns[i], np.uint32, np.uint32) for i in order.tolist()], strict=True))
        out = []
        for i in range(batch.num_rows):
            w, u, upto = _batch_tokens(batch["sizes"][i].as_py(), zstandard.decompress(batch["packed"][i].as_py()))
            sort, at = _cells(w, u)
            if len(how.words):  # answers come by bucket
                by = np.argsort(how.bucket(w[sort[at]], u[sort[at]]), kind="stable")
                back = np.empty(len(by), np.int64)
                back[by] = np.arange(len(by))
            else:
                back = np.arange(len(at))
            cell = np.empty(len(w), np.int64)
            cell[sort] = np.repeat(back, np.diff(np.append(at, len(w))))
            begin, n_tokens = upto[:-1], np.diff(upto)
            known, base, fixed = (np.add.reduceat(x[cell], begin) for x in ((c > 0).astype(np.int64), np.log10(c + 0.1) - base_all, p.astype(np.int64)))
            logs = -fixed / SCALE
            out.append(pa.RecordBatch.from_arrays([batch["doc_ids"].combine_chunks()[i].values, batch["held_out"].combine_chunks()[i].values, pa.array(n_tokens), pa.array(known), pa.array(np.full(len(begin), n, np.int64)), pa.array(base), pa.array(logs), pa.array(10 ** (-logs / n_tokens))], NAMES))
        return pa.Table.from_batches(out)

    return how.group(dealt.select("batch", "doc_ids", "held_out", "sizes", "packed"), "batch").cogroup(how.group(answers, "batch")).applyInArrow(run, FIELDS)
