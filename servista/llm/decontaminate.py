"""Benchmark decontamination by spaced-seed hashing (operator 1).

Texts are sequences of words (lower-cased, without leading and trailing punctuation). A mask looks at some positions
of a window and ignores the others, so the hash of what it sees survives substitutions in between. The hashes of
benchmark windows under all masks are joined with those of the documents' windows. Around each hit the item's own
words are laid along the document at that offset, and the longest stretch with enough equal words is kept: a match needs at
least MIN_WORDS words (or the whole item, if it is shorter), at least MIN_SHARE of them equal, and it must cover
MIN_COVER of the item or WINDOW_WORDS words. Where none does, EXACT_WORDS equal words in a row are a match too. Together the masks hit every stretch that
the rule allows: those of MASKS every one of 17 to 21 words, whichever quarter of them is replaced, and with MIDDLE_MASKS, which items of
8 to 26 words have too, every one of 8 to 16 (a test tries all). Items of fewer than 8 words have masks of their own, which find them with any
one word replaced; of fewer than MIN_ITEM words they are too common inside texts, and match texts that are nothing else.

The seeds of the benchmark are searched as a sorted array in each task where there are at most BROADCAST_SEEDS of them
(16 bytes each); beyond that the documents' seeds are joined with them by a shuffle. Both ways give the same rows.

Edge cases: null, empty and wordless texts match nothing; items with equal text are reported separately; equal doc_ids give rows that may repeat; an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

# Spaced seeds, weight 4 to 6, spans 4 to 11, and those for short items.
MASKS = ("111111", "1101011001", "11100101001", "1100101101", "101100111", "11011")
MIDDLE_MASKS = ("1111", "1100011")
SHORT_MASKS = ("11110", "11101", "10111", "01111")
#: Items from SHORT words on have MASKS, below MIDDLE words MIDDLE_MASKS too; a match of longer ones has over 16 words.
SHORT, MIDDLE = 8, 27
MIN_ITEM, MIN_WORDS, MIN_SHARE, MIN_COVER, WINDOW_WORDS, EXACT_WORDS = 5, 8, 0.75, 0.6, 20, 13
BROADCAST_SEEDS = 2_000_000
#: Items that a document is compared with in one go where the benchmark isn't broadcast.
TOGETHER = 1000
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of texts in a row, their byte starts and ends, and n+1 word offsets; words of punctuation alone go."""
    data = common.lower_letters(data)
    starts, ends, _ = common.words(data, offs)
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends, np.zeros(len(offs), np.int64)
    good = np.concatenate([[0], np.cumsum(_ALNUM[data])])
    first, last = np.searchsorted(good, good[starts] + 1, "left") - 1, np.searchsorted(good, good[ends], "left")
    keep = last > first
    keep &= good[ends] > good[starts]
    starts, ends = first[keep], last[keep]
    return common.span_hash(common.prefix_hash(data), starts, ends), starts, ends, np.searchsorted(starts, offs, "left")


def seeds(words: np.ndarray, offs: np.ndarray, masks: tuple[int, ...] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each mask: its number, hashes of all windows that lie within one text, and the places of their first words.

    The last number stands for texts of fewer than MIN_ITEM words as a whole. masks chooses numbers; None: all.
    """
    n = np.diff(offs)
    for k, mask in enumerate((*MASKS, *MIDDLE_MASKS, *SHORT_MASKS)):
        if masks is not None and k not in masks:
            continue
        at = common.ranges(offs[:-1], np.maximum(n - len(mask) + 1, 0))
        h = np.full(len(at), k + 1, np.uint64)
        for j, bit in enumerate(mask):
            if bit == "1":
                h *= common.BASE
                h += words[at + j]
        yield k, common.mix(h), at
    if masks is None or WHOLE in masks:
        few = np.flatnonzero((n > 0) & (n < MIN_ITEM))
        h = n[few].astype(np.uint64) + np.uint64(1000)
        for j in range(MIN_ITEM - 1):
            here = n[few] > j
            h[here] = h[here] * common.BASE + words[offs[few][here] + j]
        yield WHOLE, common.mix(h), offs[few]


WHOLE = len(MASKS) + len(MIDDLE_MASKS) + len(SHORT_MASKS)


def _serves(mask: int, length: np.ndarray) -> np.ndarray:
    """Whether items of so many words have seeds of a mask."""
    if mask == WHOLE:
        return length < MIN_ITEM
    if mask < len(MASKS):
        return length >= MIN_ITEM
    if mask < len(MASKS) + len(MIDDLE_MASKS):
        return (length >= SHORT) & (length < MIDDLE)
    return (length >= MIN_ITEM) & (length < SHORT)


class Items:
    """Benchmark items' words and sorted seeds."""

    def __init__(self, ids: list[int | None], texts: list[str]):
        data, offs = common.text_arrays(pa.array([t or "" for t in texts], pa.string()))
        self.ids = ids
        self.words, _, _, self.offs = word_hashes(data, offs)
        n = np.diff(self.offs)
        hashes, places, items, used = [], [], [], []
        for k, h, place in seeds(self.words, self.offs):
            item = np.searchsorted(self.offs, place, "right") - 1
            use = _serves(k, n[item])
            if use.any():
                used.append(k)
            hashes, places, items = [*hashes, h[use]], [*places, place[use]], [*items, item[use]]
        self.masks = tuple(used)
        self.hash, self.place, self.item = (np.concatenate(x) for x in (hashes, places, items))
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.place, self.item = (x[order] for x in (self.hash, self.place, self.item))
        # by a seed's top bits, so that few seeds of documents are searched for
        bits = min(max(len(self.hash).bit_length() + 4, 8), 22)
        self.shift, self.maybe = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.maybe[self.hash >> self.shift] = True


def stretch(equal: np.ndarray) -> tuple[int, int]:
    """The longest run [a, b) of an equal/unequal sequence with 3 of 4 equal at least; of these the one with most equal, then the first.

    An equal word counts 1, another -3, so a run may be taken where its sum is not negative. No run passes confirm()'s
    other tests where the longest one doesn't.
    """
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -3))])
    first = np.searchsorted(-np.minimum.accumulate(total), -total, "left")  # the first start from which the sum up to here is not negative
    n = np.arange(len(total)) - first
    ends = np.flatnonzero(n == n.max())
    b = int(ends[np.argmax(total[ends] - total[first[ends]])])
    return int(first[b]), b


def confirm(item_words: np.ndarray, doc_words: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(first, end, equal) in words of the item laid with its start at word `shift` of the document, if it is a leak there."""
    lo, hi = max(0, -shift), min(len(item_words), len(doc_words) - shift)
    if hi <= lo:
        return None
    equal = item_words[lo:hi] == doc_words[lo + shift : hi + shift]
    a, b = stretch(equal)
    n, same = b - a, int(equal[a:b].sum())
    whole = len(item_words)
    if n < min(MIN_WORDS, whole) or same < MIN_SHARE * n or (n < MIN_COVER * whole and n < WINDOW_WORDS):
        last = np.maximum.accumulate(np.where(equal, -1, np.arange(len(equal))))  # the unequal word before
        run = np.arange(len(equal)) - last
        b = int(run.argmax()) + 1
        a = b - int(run[b - 1])
        if b - a < EXACT_WORDS:
            return None
        same = b - a
    return lo + a, lo + b, same


FIELDS = "doc_id long, item_id long, item_start int, doc_start long, doc_end long, n_words int, n_equal int"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each stretch of a document that copies an item: doc_id, item_id, first word in the item, bytes of the
    document from doc_start to doc_end, words and equal words of the stretch."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("text <> ''")
    size = items.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"] or 0
    if size * (len(MASKS) + len(MIDDLE_MASKS)) > BROADCAST_SEEDS:
        return _leaks_by_join(docs, items)
    held = [(r["item_id"], r["text"]) for r in items.collect()]  # at most BROADCAST_SEEDS / masks words
    rows = common.text_only(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.no_resident()
        known = Items([i for i, _ in held], [t for _, t in held])
        for b in common.slices(batches):
            yield _search(known, b)

    return rows.mapInArrow(run, FIELDS)


def _search(known: Items, b: pa.RecordBatch) -> pa.RecordBatch:
    data, offs = common.text_arrays(b.column(1))
    words, starts, ends, at = word_hashes(data, offs)
    tries: set[tuple[int, int, int]] = set()
    if len(known.hash) and len(words):
        for mask, h, place in seeds(words, at, known.masks):
            some = np.flatnonzero(known.maybe[h >> known.shift])
            lo, hi = (np.searchsorted(known.hash, h[some], side) for side in ("left", "right"))
            seed, here = common.ranges(lo, hi - lo), np.repeat(place[some], hi - lo)
            doc = np.searchsorted(at, here, "right") - 1
            item = known.item[seed]
            if mask == WHOLE:  # seeds of whole texts and of windows never meet but for one chance in 2**64
                fits = np.diff(at)[doc] == np.diff(known.offs)[item]
                here, doc, item, seed = here[fits], doc[fits], item[fits], seed[fits]
            shift = (here - at[doc]) - (known.place[seed] - known.offs[item])
            tries.update(zip(doc.tolist(), item.tolist(), shift.tolist(), strict=True))
    out = []
    for doc, item, shift in sorted(tries):
        own, its = words[at[doc] : at[doc + 1]], known.words[known.offs[item] : known.offs[item + 1]]
        if found := confirm(its, own, shift):
            a, z, same = found
            first, last = at[doc] + a + shift, at[doc] + z + shift - 1
            out.append((doc, known.ids[item], a, int(starts[first] - offs[doc]), int(ends[last] - offs[doc]), z - a, same))
    cols = [*zip(*out, strict=True)] if out else [()] * 7
    return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int32()), pa.array(cols[6], pa.int32())], [f.split()[0] for f in FIELDS.split(", ")])


def _leaks_by_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """leaks() for a benchmark of any size: seeds meet in a shuffle, then each document meets the items that hit it.

    A seed that many items share joins all of them, as in the other way. Texts go by a hash of their own, not by ids, which
    may be null or repeat; what a collision of hashes brings together is searched like any other hit.
    """

    def seed_rows(key: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in common.slices(batches):
                data, offs = common.text_arrays(b.column(1))
                words, _, _, at = word_hashes(data, offs)
                for mask, h, place in seeds(words, at):
                    of = np.searchsorted(at, place, "right") - 1
                    use = _serves(mask, np.diff(at)[of]) if key == "item_key" else np.ones(len(of), bool)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of[use])), pa.array(h[use].view(np.int64))], [key, "seed"])

        return run

    key = F.xxhash64("text")
    table = common.text_only(docs)
    in_items = items.select(key.alias("item_key"), "text").mapInArrow(seed_rows("item_key"), "item_key long, seed long").distinct()
    in_docs = table.select(key.alias("doc_key"), "text").mapInArrow(seed_rows("doc_key"), "doc_key long, seed long").distinct()
    hits = in_docs.join(in_items, "seed").select("doc_key", "item_key").distinct()
    its, own = items.select(key.alias("item_key"), "item_id", F.col("text").alias("item")), table.withColumn("doc_key", key)
    # a text is sent once for every TOGETHER items that it may hold (about)
    hits = hits.join(hits.groupBy("doc_key").agg(F.ceil(F.count("*") / TOGETHER).alias("parts")), "doc_key").withColumn("part", F.pmod(F.xxhash64("item_key"), F.col("parts")))
    tried = hits.join(its, "item_key").groupBy("doc_key", "part").agg(F.collect_list(F.struct("item_id", "item")).alias("items"))
    each = tried.join(own, "doc_key").select("doc_id", "text", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                some = b.column(2)[i].as_py()
                known = Items([x["item_id"] for x in some], [x["item"] for x in some])
                yield _search(known, pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1)], ["doc_id", "text"]))

    return each.mapInArrow(run, FIELDS)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document that holds a leak: doc_id, item_ids (ascending), n_spans, and the longest stretch's words."""
    return leaks(docs, benchmark).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.count("*").alias("n_spans"), F.max("n_words").cast("long").alias("longest"))
