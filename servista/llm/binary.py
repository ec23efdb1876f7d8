"""Token ids in binary shard files: patched frame-of-reference blocks (operator 8).

File: MAGIC, then segments, then the documents' index, then a footer. A segment holds up to SEGMENT ids in blocks
of BLOCK ids. For each block the smallest id is subtracted, the rest is packed at the bit width that the
PERCENTILE-th part of the block needs, and ids that need more bits stand in the block's exception list (place and
whole value). A segment's head has each block's minimum, width, number of exceptions and start, so that any block
can be read alone. All numbers are little-endian.

Edge cases: null and empty texts give the end id alone; rows with equal doc_id stay separate, in order of text;
a null doc_id comes first and is kept as null (in the files it is -2**63, so a doc_id of that value is read as null); an empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common
from .tokens import encoder

MAGIC = b"SVPFOR01"
BLOCK = 128
SEGMENT = BLOCK * 4096
PERCENTILE = 0.9
_FOOT = struct.Struct("<QQQ8s")  # index offset, documents, ids, MAGIC
_NULL_ID = -(2**63)


def _widths(delta: np.ndarray) -> np.ndarray:
    """Bits for the PERCENTILE-th value of each row."""
    k = int(np.ceil(PERCENTILE * delta.shape[1])) - 1
    v = np.partition(delta, k, axis=1)[:, k].astype(np.float64)
    return np.where(v > 0, np.floor(np.log2(np.maximum(v, 1))) + 1, 0).astype(np.uint8)


def _pack(values: np.ndarray, w: int) -> np.ndarray:
    """Rows of BLOCK values below 2**w as rows of w * BLOCK / 8 bytes."""
    n, words = len(values), -(-w * BLOCK // 64)
    out = np.zeros((words, n), np.uint64)
    cols = np.ascontiguousarray(values.T).astype(np.uint64)
    for j in range(BLOCK):
        at, shift = divmod(j * w, 64)
        out[at] |= cols[j] << np.uint64(shift)
        if shift + w > 64:
            out[at + 1] |= cols[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).view(np.uint8).reshape(n, words * 8)


def _unpack(rows: np.ndarray, w: int) -> np.ndarray:
    n, words = len(rows), -(-w * BLOCK // 64)
    cols = np.ascontiguousarray(rows.view(np.uint64).reshape(n, words).T)
    out, mask = np.empty((BLOCK, n), np.uint32), np.uint64((1 << w) - 1)
    for j in range(BLOCK):
        at, shift = divmod(j * w, 64)
        x = cols[at] >> np.uint64(shift)
        if shift + w > 64:
            x = x | (cols[at + 1] << np.uint64(64 - shift))
        out[j] = x & mask
    return np.ascontiguousarray(out.T)


def encode_segment(ids: np.ndarray) -> bytes:
    """One segment's bytes, its own length first."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.zeros(blocks * BLOCK, np.uint32)
    full[:n] = ids
    full[n:] = ids[-1] if n else 0
    rows = full.reshape(blocks, BLOCK)
    low = rows.min(axis=1)
    delta = rows - low[:, None]
    width = _widths(delta)
    over = delta >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    n_over = over.sum(axis=1).astype(np.uint8)
    packed = -(-width.astype(np.int64) * BLOCK // 64) * 8
    sizes = packed + 5 * n_over.astype(np.int64)
    starts = np.zeros(blocks + 1, np.int64)
    np.cumsum(sizes, out=starts[1:])
    body = np.zeros(int(starts[-1]), np.uint8)
    kept = np.where(over, np.uint32(0), delta)
    for w in np.unique(width):
        if not w:
            continue
        at = np.flatnonzero(width == w)
        body[starts[at][:, None] + np.arange(packed[at[0]])] = _pack(kept[at], int(w))
    b, place = np.nonzero(over)
    nth = np.arange(len(b)) - np.repeat(np.cumsum(n_over.astype(np.int64)) - n_over, n_over)
    first = starts[b] + packed[b]
    body[first + nth] = place
    body[(first + n_over[b] + 4 * nth)[:, None] + np.arange(4)] = rows[b, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    head = struct.pack("<III", n, blocks, len(body)) + low.astype("<u4").tobytes() + width.tobytes() + n_over.tobytes() + starts[:-1].astype("<u4").tobytes()
    return head + body.tobytes()


def decode_segment(read) -> np.ndarray:
    """The ids of the segment that read(n) stands before."""
    n, blocks, size = struct.unpack("<III", read(12))
    low = np.frombuffer(read(4 * blocks), "<u4")
    width, n_over = np.frombuffer(read(blocks), np.uint8), np.frombuffer(read(blocks), np.uint8).astype(np.int64)
    starts = np.frombuffer(read(4 * blocks), "<u4").astype(np.int64)
    body = np.frombuffer(read(size), np.uint8)
    packed = -(-width.astype(np.int64) * BLOCK // 64) * 8
    rows = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            at = np.flatnonzero(width == w)
            rows[at] = _unpack(np.ascontiguousarray(body[starts[at][:, None] + np.arange(packed[at[0]])]), int(w))
    rows += low[:, None]
    b = np.repeat(np.arange(blocks), n_over)
    nth = np.arange(len(b)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
    first = starts[b] + packed[b]
    if len(b):
        value = np.ascontiguousarray(body[(first + n_over[b] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").ravel()
        rows[b, body[first + nth]] = value
    return rows.ravel()[:n]


class ShardWriter:
    """Ids of documents in order, written segment by segment: memory is bounded by a segment and the index."""

    def __init__(self, path: str):
        self.path, self.file = path, common.open_output(path)
        self.file.write(MAGIC)
        self.at, self.waiting, self.n_waiting = len(MAGIC), [], 0
        self.docs: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.total = 0

    def add(self, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(doc_ids)
        self.counts.append(counts)
        self.total += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= SEGMENT:
            every = np.concatenate(self.waiting)
            whole = len(every) // SEGMENT * SEGMENT
            for k in range(0, whole, SEGMENT):
                self._put(every[k : k + SEGMENT])
            self.waiting, self.n_waiting = [every[whole:]], len(every) - whole

    def _put(self, ids: np.ndarray) -> None:
        data = encode_segment(ids)
        self.file.write(data)
        self.at += len(data)

    def close(self) -> tuple[int, int]:
        if self.n_waiting:
            self._put(np.concatenate(self.waiting))
        docs = np.concatenate(self.docs) if self.docs else np.empty(0, np.int64)
        counts = np.concatenate(self.counts) if self.counts else np.empty(0, np.int64)
        self.file.write(docs.astype("<i8").tobytes() + counts.astype("<i8").tobytes())
        self.file.write(_FOOT.pack(self.at, len(docs), self.total, MAGIC))
        self.file.close()
        return len(docs), self.total


def read_shard(path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, counts, ids) of runs of whole documents, in file order; a run is a segment or one longer document."""
    with common.open_input(path) as f:
        f.seek(f.size() - _FOOT.size)
        index, n_docs, total, magic = _FOOT.unpack(f.read(_FOOT.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a shard of this format")
        f.seek(index)
        docs = np.frombuffer(f.read(8 * n_docs), "<i8")
        counts = np.frombuffer(f.read(8 * n_docs), "<i8")
        f.seek(len(MAGIC))
        ends, held, n_held, d, gone = np.cumsum(counts), [], 0, 0, 0
        while gone + n_held < total or d < n_docs:
            if gone + n_held < total:
                held.append(decode_segment(f.read))
                n_held += len(held[-1])
            e = int(np.searchsorted(ends, gone + n_held, side="right"))
            if e > d:
                every = np.concatenate(held) if held else np.empty(0, np.uint32)
                take = int(ends[e - 1]) - gone
                yield docs[d:e], counts[d:e], every[:take]
                held, n_held, d, gone = [every[take:]], len(every) - take, e, gone + take


def order_bounds(docs: DataFrame, shards: int) -> list[int]:
    """Up to shards-1 values of doc_id that cut the table into about equal runs; only that column is read."""
    if shards <= 1:
        return []
    at = [k / shards for k in range(1, shards)]
    row = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), at, max(1000, 20 * shards)).alias("b")).first()
    return sorted(set(row["b"] or []))


def part_of(column, bounds: list[int]):
    """Number of bounds not above the column (nulls: 0), as a binary search in SQL expressions."""

    def pick(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column >= F.lit(bounds[mid]), pick(mid + 1, hi)).otherwise(pick(lo, mid))

    if len(bounds) <= 512:
        return pick(0, len(bounds))

    import pandas as pd

    @F.pandas_udf("int")
    def by_search(x: pd.Series) -> pd.Series:
        return pd.Series(np.where(x.isna(), 0, np.searchsorted(bounds, x.fillna(_NULL_ID).to_numpy(np.int64), side="right")).astype(np.int32))

    return by_search(column)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shard_bytes: int = 16 << 20) -> list[tuple[int, str, int, int]]:
    """Encode all texts in ascending doc_id order into shard files; (shard, path, documents, ids) in order.

    Range shards come from quantiles of doc_id, one shuffle of the texts, a sort within each shard. A task writes under
    a name of its own, and only the names that finished tasks report are used, so retried tasks do no harm.
    """
    total = common.input_bytes(docs)
    shards = common.parts(docs, max(shard_bytes, min(1 << 30, total // 4096)))
    bounds = order_bounds(docs, shards)
    rows = common.text_only(docs).withColumn("shard", part_of(F.col("doc_id"), bounds).cast("int"))
    rows = rows.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "text")

    def write(batches):
        common.lean_memory(8)
        enc, out, name, shard = None, None, "", None
        for b in common.slices(batches, step=2 * common.STEP_BYTES):
            if out is None:
                shard = b.column(2)[0].as_py()
                name = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.pfor"
                enc, out = encoder(tokenizer), ShardWriter(name)
            ids, n = enc.encode(b.column(1).to_pylist())
            ends = np.cumsum(n)
            ids = np.insert(ids, ends, end_id).astype(np.uint32)
            out.add(b.column(0).fill_null(_NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64), n + 1, ids)
        if out is not None:
            n_docs, n_ids = out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [name], "docs": pa.array([n_docs], pa.int64()), "ids": pa.array([n_ids], pa.int64())})

    got = rows.mapInArrow(write, "shard int, path string, docs long, ids long").collect()
    return sorted((r["shard"], r["path"], r["docs"], r["ids"]) for r in got)


def read_documents(spark: SparkSession, shards: list[tuple[int, str, int, int]]) -> DataFrame:
    """One row a document from the files: doc_id, shard, start (ids before it in all), n_tokens, ids_crc32."""
    rows, before = [], 0
    for shard, path, _, ids in shards:
        rows.append((shard, path, before))
        before += ids
    table = spark.createDataFrame(rows, "shard int, path string, before long").repartitionById(max(1, len(rows)), F.col("shard"))

    def read(batches):
        for b in batches:
            for shard, path, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for docs, n, ids in read_shard(path):
                    raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(n)
                    crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs, pa.int64(), mask=docs == _NULL_ID), pa.array(np.full(len(n), shard, np.int32)), pa.array(at + ends - n), pa.array(n.astype(np.int64)), pa.array(crc, pa.int64())],
                        ["doc_id", "shard", "start", "n_tokens", "ids_crc32"],
                    )
                    at += int(ends[-1])

    return table.mapInArrow(read, "doc_id long, shard int, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write docs as shard files under folder (a fresh shared one by default) and return what the files hold."""
    folder = folder or common.work_dir(spark, "token-ids")
    return read_documents(spark, write_shards(docs, folder, tokenizer, end_id))
