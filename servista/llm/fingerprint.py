"""Order MinHash fingerprints of documents (operator 9).

A text's k-mers of characters are numbered by occurrence. For each of `entries` hash functions the `take` smallest
numbered k-mers are put back in text order, and the hash of that tuple is one entry of the signature. Two texts'
likeness is the share of equal entries: it falls when k-mers change and also when they change places.

Edge cases: null is the empty text; an empty text has all entries 0 and is alike only to empty texts; a text
shorter than k is one k-mer; with fewer than `take` k-mers the tuple is all of them. Rows of equal doc_id are
ordered by text, a null doc_id comes first; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common
from .binary import order_bounds, part_of

K, ENTRIES, TAKE = 6, 64, 2
#: Numbers held at once by one step over a long text: entries times k-mers.
_STEP = 1 << 17
_rng = np.random.Generator(np.random.PCG64(9))
_XOR = _rng.integers(0, 2**32, 4096, dtype=np.uint32)
_MUL = _rng.integers(0, 2**31, 4096, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TUPLE = np.uint64(0xC2B2AE3D27D4EB4F)


def _numbered(chars: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's k-mers, and 32-bit hashes of (k-mer, occurrence)."""
    n = max(1, len(chars) - k + 1)
    h = np.full(n, len(chars[:k]), np.uint64)
    for j in range(min(k, len(chars))):
        h *= common.BASE
        h += chars[j : j + n]
    common.mix(h)
    order = np.argsort(h, kind="stable")
    same = h[order]
    fresh = np.ones(n, bool)
    np.not_equal(same[1:], same[:-1], out=fresh[1:])
    if fresh.all():
        nth = np.zeros(n, np.uint64)
    else:
        at = np.arange(n)
        nth = np.empty(n, np.uint64)
        nth[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return h, (common.mix(h + nth * common.BASE) >> np.uint64(32)).astype(np.uint32)


def signature(chars: np.ndarray, k: int = K, entries: int = ENTRIES, take: int = TAKE) -> np.ndarray:
    """The signature (uint16) of a text given as code points."""
    if not len(chars):
        return np.zeros(entries, np.uint16)
    h, x = _numbered(chars, k)
    take = min(take, len(x))
    values, places = [], []
    step = max(take, _STEP // entries)
    for a in range(0, len(x), step):
        y = (x[a : a + step][None, :] ^ _XOR[:entries, None]) * _MUL[:entries, None]
        row = np.arange(entries)
        for _ in range(min(take, y.shape[1])):
            p = y.argmin(axis=1)
            values.append(y[row, p].astype(np.uint64))
            places.append(p + a)
            y[row, p] = np.uint32(0xFFFFFFFF)
    v, p = np.stack(values, axis=1), np.stack(places, axis=1)
    if v.shape[1] > take:
        best = np.argsort(v, axis=1, kind="stable")[:, :take]
        p = np.take_along_axis(p, best, axis=1)
    p.sort(axis=1)
    out = np.zeros(entries, np.uint64)
    for j in range(take):
        out = out * _TUPLE + h[p[:, j]]
    return (common.mix(out) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal entries; an empty text's all-zero signature is like another such only."""
    if not a.any() or not b.any():
        return float(a.any() == b.any())
    return float((a == b).mean())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def edited(text: str, following: str) -> str:
    """text with its last floor(n/2) characters replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_following(docs: DataFrame, shard_bytes: int = 16 << 20) -> tuple[DataFrame, int]:
    """Rows (doc_id, text, shard, ahead), each shard a run of the order by doc_id, with the first row after it as ahead = 1.

    Bounds between shards are ids that occur, so a shard's successor is the rows at its upper bound; these are dealt
    to both. The first row of all is dealt to the last shard too, where it follows the last row.
    """
    total = common.input_bytes(docs)
    bounds = order_bounds(docs, common.parts(docs, max(shard_bytes, min(1 << 30, total // 4096))))
    ends = docs.agg(F.min(F.col("doc_id").cast("long")).alias("low"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    if bounds and not ends["nulls"] and bounds[0] == ends["low"]:
        bounds = bounds[1:]
    rows = common.text_only(docs)
    own = part_of(F.col("doc_id"), bounds)
    first = F.col("doc_id").isNull() if ends["nulls"] or ends["low"] is None else F.col("doc_id") == F.lit(ends["low"])
    before = part_of(F.col("doc_id") - 1, bounds)  # differs from own just at a bound
    to = F.array(F.struct(own.alias("shard"), F.lit(0).alias("ahead")), F.when(before != own, F.struct(before.alias("shard"), F.lit(1).alias("ahead"))), F.when(first, F.struct(F.lit(len(bounds)).alias("shard"), F.lit(1).alias("ahead"))))
    rows = rows.withColumn("to", F.explode(F.filter(to, lambda x: x.isNotNull()))).select("doc_id", "text", F.col("to.shard").cast("int").alias("shard"), "to.ahead")
    return rows.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("ahead", F.asc_nulls_first("doc_id"), "text"), len(bounds) + 1


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, k: int = K, entries: int = ENTRIES, take: int = TAKE) -> DataFrame:
    """Fingerprint of each text and of its edited text (see edited), and their likenesses."""
    rows, _ = with_following(docs)

    def one(doc, text, sig, following, next_sig):
        other = edited(text, following)
        its = signature(code_points(other), k, entries, take)
        return (doc, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), sig.astype(">u2").tobytes().hex(), its.astype(">u2").tobytes().hex(), likeness(sig, its), likeness(sig, next_sig))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, False
        for b in common.slices(batches):
            out = []
            for doc, text, ahead in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if done:
                    break
                sig = signature(code_points(text), k, entries, take)
                if held is not None:
                    out.append(one(*held, text, sig))
                held, done = (doc, text, sig), bool(ahead)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], [f.split()[0] for f in FIELDS.split(", ")])

    return rows.mapInArrow(run, FIELDS)
