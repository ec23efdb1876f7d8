"""Repeated byte strings by a depth-limited radix sort of suffixes (operator 3).

Suffixes count only through their first DEPTH bytes (a window). Most-significant-digit passes order suffixes by one
digit of BYTES bytes after the other, within the groups that are equal so far, and drop groups of one; what is left after
the last digit is exactly what repeats.

Sorting every suffix of every text would shuffle many times the input, so suffixes are dealt out before they are sorted,
and neighbouring ones travel together. Each window has an anchor, the DIGIT bytes in it with the least hash (the first of equals), which depends on
the window's bytes alone; windows in a row with one anchor form a run. Equal windows have equal anchors at equal
places in them. About one run starts in every 75 bytes.

1. Runs are dealt by their anchor's hash. Anchors that occur once drop out with all their windows.
2. Runs of one anchor are dealt by a hash of all bytes that their windows cover together. Runs that are equal as a whole
   repeat as a whole; one of them stands for all from here on.
3. The windows of the remaining runs of an anchor go through the radix passes, in one task. An anchor with more than GROUP
   different runs (a phrase in very many contexts) is divided first (see divide): its windows by halves of the places that the anchor has in
   them, each half by the bytes that all its windows have in common around the anchor, longer with every pass. Parts that
   are equal as a whole repeat, and one of them goes on; groups that are small enough go through the radix passes.

Runs that are equal as a whole are found by a hash of 64 bits; everything else is compared by its bytes.

Edge cases: null and empty texts, and texts shorter than DEPTH, lose nothing; windows of rows with equal text or equal
doc_id count as separate places; a string that repeats within one text (also overlapping itself) is removed; an
empty table gives no rows. Only doc_id and text are read. Bytes are removed, so a character may lose some of its bytes;
the text returned by cleaned() drops such broken characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import common

DEPTH, DIGIT = 200, 50
#: Runs of one anchor, or parts of them, that are compared in one task.
GROUP = 2000
#: Bytes of a digit.
BYTES = 8
#: Equal runs, and share of all runs, beyond which they are found without a shuffle: 10,000 kinds of them at most.
HOT_RUNS, HOT_SHARE = 50_000, 1e-4


def runs(data: np.ndarray, offs: np.ndarray, depth: int = DEPTH, digit: int = DIGIT) -> tuple[np.ndarray, ...]:
    """For each run of windows with one anchor: text, first digit's hash, whole hash, first window (in its text), windows."""
    n_texts, width = len(offs) - 1, depth - digit + 1
    none = tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    n_win = np.maximum(np.diff(offs) - depth + 1, 0)
    if not n_win.any():
        return none
    prefix = common.prefix_hash(data)
    n = len(data) - digit + 1
    _, inv = common.powers(len(prefix))
    h = common.mix((prefix[digit:] - prefix[:n]) * inv[:n])
    blocks = -(-n // width)
    key = np.full(blocks * width, 2**64 - 1, np.uint64)
    key[:n] = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    square = key.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    total = len(data) - depth + 1
    least = np.minimum(behind[:total], ahead[width - 1 : width - 1 + total])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(len(data) + 1, np.int8)
    has = n_win > 0
    np.add.at(valid, offs[:-1][has], 1)
    np.add.at(valid, offs[:-1][has] + n_win[has], -1)
    valid = np.cumsum(valid[:total], dtype=np.int8).astype(bool)
    fresh = valid.copy()
    fresh[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    starts_of = offs[:-1][has]
    fresh[starts_of] = True
    lo = np.flatnonzero(fresh)
    text = np.searchsorted(offs, lo, "right") - 1
    end = np.minimum(np.append(lo[1:], total), offs[text] + n_win[text])
    p = at[lo]
    whole = common.span_hash(prefix, lo, end - 1 + depth) + (p - lo).astype(np.uint64) * common.BASE
    return text, h[p], common.mix(whole), lo - offs[text], end - lo


def scan(docs: DataFrame, depth: int, digit: int, whole: bool = False) -> DataFrame:
    """A row for each text: row (a number), doc_id, n_bytes, sha256, packed (zstd; null if too short), and its runs as arrays
    anchor, whole, first, windows. With whole, packed has short texts too, and other the remaining columns of docs."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *[_other(docs)] * whole)
    names = ["row", "doc_id", "n_bytes", "sha256", "packed", "anchor", "whole", "first", "windows", *["other"] * whole]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.no_resident()
        press = zstandard.ZstdCompressor(level=1)
        for b in common.slices(batches):
            data, offs = common.text_arrays(b.column(2))
            text, anchor, union, first, windows = runs(data, offs, depth, digit)
            at = pa.array(np.searchsorted(text, np.arange(b.num_rows + 1)).astype(np.int32))
            cols = [pa.ListArray.from_arrays(at, pa.array(c)) for c in (anchor.view(np.int64), union.view(np.int64), first.astype(np.int32), windows.astype(np.int32))]
            raw = memoryview(data.tobytes())
            spans = [*zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            packed = [press.compress(raw[s:e]) if whole or e - s >= depth else None for s, e in spans]
            sha = [hashlib.sha256(raw[s:e]).hexdigest() for s, e in spans]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(offs)), pa.array(sha), pa.array(packed, pa.binary()), *cols, *b.columns[3:]], names)

    schema = T.StructType.fromDDL("row long, doc_id long, n_bytes long, sha256 string, packed binary, anchor array<long>, whole array<long>, first array<int>, windows array<int>")
    return rows.mapInArrow(run, schema.add(rows.schema["other"]) if whole else schema)


def _other(docs: DataFrame) -> Column:
    """The columns but text, and whether text is null."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.col("text").isNull().alias("__null")).alias("other")


def _with_text(df: DataFrame, texts: DataFrame) -> DataFrame:
    """df, one row for each `row`, with the packed texts; few rows pick their texts by broadcast before the join."""
    ids = df.select("row")
    if ids.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS:
        texts = texts.join(F.broadcast(ids), "row", "left_semi")
    return df.join(texts, "row")


def _bytes_of(df: DataFrame, texts: DataFrame, depth: int) -> DataFrame:
    """Runs (anchor, whole, row, first, windows, hot, alone) with the bytes they cover."""
    fields = ("anchor", "whole", "first", "windows", "hot", "alone")
    each = _with_text(df.groupBy("row").agg(F.collect_list(F.struct(*fields)).alias("runs")), texts).select("row", "packed", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(b.num_rows):
                text = open_.decompress(b.column(1)[i].as_py())
                flat = b.column(2).slice(i, 1).flatten()
                col = [flat.field(k) for k in range(len(fields))]
                span = [text[s : s + w - 1 + depth] for s, w in zip(col[2].to_pylist(), col[3].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(span), pa.int64()), *col, pa.array(span, pa.binary())], ["row", *fields, "bytes"])

    return each.mapInArrow(run, "row long, anchor long, whole long, first int, windows int, hot boolean, alone boolean, bytes binary")


def _intervals(row: np.ndarray, first: np.ndarray, of: np.ndarray, place: np.ndarray, depth: int) -> pa.RecordBatch:
    """Runs of neighbouring windows, given in order, as (row, start, end) in bytes."""
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (place[1:] != place[:-1] + 1)
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(of)) - 1
    return pa.RecordBatch.from_arrays([pa.array(row[of[a]]), pa.array(first[of[a]] + place[a]), pa.array(first[of[z]] + place[z] + depth)], ["row", "start", "end"]) if len(of) else pa.RecordBatch.from_pydict({k: pa.array([], pa.int64()) for k in ("row", "start", "end")})


def radix(data: np.ndarray, start: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Which of the suffixes from start on equal another one of their group in their first depth bytes: a radix sort, most
    significant digit first, of what is still equal to something. The suffixes left, in their order."""
    alive = np.arange(len(start))
    for at in range(0, depth, BYTES):
        if not len(alive):
            break
        place, digit = start[alive] + at, np.zeros(len(alive), np.uint64)
        for k in range(min(BYTES, depth - at)):
            digit = (digit << np.uint64(8)) | data[place + k]
        order = np.argsort(digit, kind="stable")
        order = order[np.argsort(group[order], kind="stable")]
        group, digit = group[order], digit[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        group = np.cumsum(fresh) - 1
        several = np.bincount(group)[group] > 1
        alive, group = alive[order[several]], group[several]
    return alive


def _compare(found: DataFrame, depth: int) -> DataFrame:
    """(row, start, end) of windows that repeat among runs of one anchor, for runs that are alone."""

    def work(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        data, offs = common.text_arrays(t["bytes"].chunk(0))
        n = np.diff(offs) - depth + 1
        of = np.repeat(np.arange(len(n)), n)
        start = common.ranges(offs[:-1], n)
        _, group = np.unique(t["anchor"].to_numpy(), return_inverse=True)
        left = np.sort(radix(data, start, group[of], depth))
        left = left[t["alone"].to_numpy(zero_copy_only=False)[of[left]]]
        return _intervals(t["row"].to_numpy(), t["first"].to_numpy().astype(np.int64), of[left], (start - offs[of])[left], depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= 2 * GROUP:
                t = pa.Table.from_batches(held)
                anchor = t["anchor"].to_numpy()
                cut = int(np.searchsorted(anchor, anchor[-1], "left"))
                if cut:
                    yield work(t.slice(0, cut))
                    held, n = t.slice(cut).to_batches(), t.num_rows - cut
        if n:
            yield work(pa.Table.from_batches(held))

    return found.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "row long, start long, end long")


_PART = "anchor long, context binary, row long, first int, windows int, alone boolean, at int, low int, high int, bytes binary"


def _halves(parts: DataFrame, depth: int, digit: int) -> DataFrame:
    """Each part (of runs of one anchor: the windows in which the anchor's place is from low to high) cut into two halves of these places, with
    the bytes around the anchor that all windows of such a half have in common. `at` is the anchor's place in bytes, null if not known yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                raw, at = r["bytes"], r["at"]
                if at is None:
                    p = common.prefix_hash(np.frombuffer(raw, np.uint8))
                    _, inv = common.powers(len(p))
                    n = depth - digit + 1
                    h = common.mix((p[digit : digit + n] - p[:n]) * inv[:n])
                    at = int((h.view(np.int64) == r["anchor"]).argmax())
                middle = (r["low"] + r["high"]) // 2
                for low, high in ((r["low"], middle), (middle, r["high"])):
                    a, z = max(0, at - high + 1), min(r["windows"] - 1, at - low)
                    if a <= z:
                        out.append((r["anchor"], raw[at - low : at + depth - high + 1], r["row"], r["first"] + a, z - a + 1, r["alone"], at - a, low, high, raw[a : z + depth]))
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            cols = [*zip(*out, strict=True)] if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in _PART.split(", ")])

    return parts.mapInArrow(run, _PART)


def divide(found: DataFrame, depth: int, digit: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """For runs of anchors with many: intervals (row, start, end) that repeat, and parts (as found) of groups of at most GROUP.

    Windows are equal only if they have the anchor at the same place and agree around it, so each pass deals what is left by one more half
    of the places and more common bytes, until one place is left and the common bytes are the window itself.
    """
    parts = found.select("anchor", "row", "first", "windows", "alone", "bytes", F.lit(None).cast("int").alias("at"), F.lit(0).alias("low"), F.lit(depth - digit + 1).alias("high"))
    intervals, small = [], []
    while parts.limit(1).count():
        dealt = _halves(parts, depth, digit)
        dealt = common.materialise(dealt.withColumn("anchor", F.xxhash64("anchor", "low", "context")).drop("context"), "halves")
        kinds = dealt.groupBy("anchor", "bytes").agg(F.count("*").alias("n"), F.min(F.struct("row", "first", "windows", "alone", "at", "low", "high")).alias("x"))
        kinds = common.materialise(kinds.select("anchor", "bytes", "n", "x.*"), "kinds")
        again = dealt.filter("alone").join(kinds.filter("n > 1").select("anchor", "bytes"), ["anchor", "bytes"], "left_semi")
        again = again.select("row", F.col("first").cast("long").alias("start"), (F.col("first") + F.col("windows") - 1 + depth).cast("long").alias("end"))
        intervals.append(common.materialise(again, "repeated-parts"))
        sizes = common.materialise(kinds.groupBy("anchor").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
        left = kinds.withColumn("alone", F.col("alone") & (F.col("n") == 1)).drop("n").join(common.few(sizes), "anchor")
        small.append(common.materialise(left.filter(F.col("size") <= GROUP).select("anchor", "row", "first", "windows", "alone", "bytes"), "small"))
        parts = common.materialise(left.filter((F.col("size") > GROUP) & (F.col("high") - F.col("low") > 1)).drop("size"), "large")
        common.drop(dealt, kinds, sizes)
    return intervals, small


def repeats(docs: DataFrame, depth: int = DEPTH, digit: int = DIGIT, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """The scanned texts (see scan), and (row, cuts) with the byte intervals (start, end) of a text that are covered by strings
    which occur elsewhere too; they may overlap."""
    common.small_batches(docs.sparkSession)
    texts = common.materialise(scan(docs, depth, digit, whole), "scanned")
    every = texts.select("row", F.inline(F.arrays_zip("anchor", "whole", "first", "windows")))
    again = every.groupBy("anchor").agg(F.count("*").alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b")).filter("n > 1").select("anchor", (F.col("a") != F.col("b")).alias("several"))
    with common.scratch(again, "anchors") as again:
        some = common.materialise(every.join(again, "anchor"), "runs")
    equal = some.filter("several").groupBy("anchor", "whole").agg(F.count("*").alias("n"), F.first("row").alias("row"), F.first("first").alias("first"), F.first("windows").alias("windows"))
    equal = common.materialise(equal, "classes")
    hot = equal.groupBy("anchor").agg((F.count("*") > GROUP).alias("hot"))
    found = _bytes_of(equal.withColumn("alone", F.col("n") == 1).join(hot, "anchor"), texts.select("row", "packed"), depth)
    found = common.materialise(found, "covered")
    # very many equal runs are found by their few kinds, in place; the others by a shuffle
    several, repeated = some.filter("several"), equal.filter("n > 1")
    size = equal.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot_runs = F.broadcast(repeated.filter(F.col("n") > max(HOT_RUNS, HOT_SHARE * size)).select("anchor", "whole"))
    kind = ["anchor", "whole"]
    again = several.join(hot_runs, kind, "left_semi").union(several.join(hot_runs, kind, "left_anti").join(repeated.select(*kind), kind, "left_semi"))
    of_runs = [df.select("row", F.col("first").cast("long").alias("start"), (F.col("first") + F.col("windows") - 1 + depth).cast("long").alias("end")) for df in (some.filter("not several"), again)]
    divided, small = divide(found.filter("hot"), depth, digit)
    fields = ("anchor", "row", "first", "alone", "bytes")
    compared = reduce(DataFrame.union, [df.select(*fields) for df in (found.filter("not hot"), *small)])
    intervals = reduce(DataFrame.union, [*of_runs, *divided, _compare(compared, depth)])
    each = intervals.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    each = common.materialise(each, "intervals")
    common.drop(some, equal, found, *divided, *small)
    return texts, each


def _cut(texts: DataFrame, cuts: DataFrame, keep_text: bool) -> DataFrame:
    """row, doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining text, if asked for) of texts that lose bytes."""
    rows = _with_text(cuts, texts.select("row", "doc_id", "n_bytes", "packed")).select("row", "doc_id", "n_bytes", "packed", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for i in range(b.num_rows):
                text, cuts = open_.decompress(b.column(3)[i].as_py()), b.column(4).slice(i, 1).flatten()
                s, e = (cuts.field(k).to_numpy() for k in (0, 1))
                order = np.argsort(s, kind="stable")
                s, e = s[order], np.maximum.accumulate(e[order])
                new = np.append(True, s[1:] > e[:-1])
                s, e = s[new], e[np.append(np.flatnonzero(new)[1:], len(e)) - 1]
                kept = b"".join(text[a:z] for a, z in zip([0, *e.tolist()], [*s.tolist(), len(text)], strict=True))
                out.append((int((e - s).sum()), len(s), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep_text else None))
            cols = [*zip(*out, strict=True)] if out else [()] * 4
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), *[pa.array(cols[3], pa.string())] * keep_text], ["row", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text])

    return rows.mapInArrow(run, "row long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * keep_text)


def digest(docs: DataFrame, depth: int = DEPTH, digit: int = DIGIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs."""
    texts, cuts = repeats(docs, depth, digit)
    cut = common.materialise(_cut(texts, cuts, False), "cut")
    same = texts.select("row", "doc_id", "n_bytes", "sha256").join(cut.select("row"), "row", "left_anti")
    same = same.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha256").alias("kept_sha256"))
    return cut.drop("row").union(same)


def cleaned(docs: DataFrame, depth: int = DEPTH, digit: int = DIGIT) -> DataFrame:
    """docs with the repeated bytes taken out of text; all rows and columns stay."""
    texts, cuts = repeats(docs, depth, digit, whole=True)
    cut = common.materialise(_cut(texts, cuts, True).select("row", "kept"), "cleaned")
    same = common.by_key(texts.select("row", "packed", "other"), cut.select("row"), "row", "left_anti")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([open_.decompress(x).decode("utf-8", "surrogatepass") for x in b.column(1).to_pylist()], pa.string())], ["other", "kept"])

    schema = T.StructType([texts.schema["other"], T.StructField("kept", T.StringType())])
    new = same.select("other", "packed").mapInArrow(unpack, schema).union(texts.select("row", "other").join(cut, "row").select("other", "kept"))
    columns = [F.when(~F.col("other.__null"), F.col("kept")).alias("text") if c == "text" else F.col(f"other.`{c}`") for c in docs.columns]
    return new.select(*columns)
