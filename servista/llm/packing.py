"""Best-fit packing of documents into sequences, planned on the histogram of lengths (operator 2).

1. Texts become ids, and each document's pieces of at most `size` ids go to a table without the ids.
2. Pieces are counted by length: at most `size` numbers, whatever the input.
3. Best-fit decreasing runs on these counts: sequences with equal room are handled together, so the plan is a list of
   runs "pieces number a to b of length n go to sequences s, s+1, ... at such offsets", bounded by `size` too.
4. A piece's number within its length is found without gathering a length in one task: pieces are dealt into chunks by
   a hash of their key, counted by (length, chunk), and numbered from the running sum of these counts.
5. Pieces take their slots by joining the plan on length and number.

Edge cases: null and empty texts are the end id alone; a document longer than `size` is cut, all pieces but the last
being full; equal doc_ids stay separate documents; a null doc_id stays null; an empty table gives no rows. Columns
other than doc_id and text play no part.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common
from .tokens import encoder

#: Pieces of one length are numbered in at least so many parts.
CHUNKS = 256
PIECES = "doc_id long, copy long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """One row a piece: doc_id, copy (tells rows of equal doc_id apart), piece, start, length, ids_crc32."""
    rows = common.text_only(docs).withColumn("copy", F.xxhash64("text"))

    def cut(batches):
        enc = encoder(tokenizer)
        for b in common.slices(batches, step=2 * common.STEP_BYTES):
            ids, n = enc.encode(b.column(1).to_pylist())
            ids = np.insert(ids, np.cumsum(n), end_id).astype("<u4")
            n = n + 1
            begin = np.cumsum(n) - n
            k = -(-n // size)
            row = np.repeat(np.arange(len(n)), k)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
            start = piece * size
            length = np.minimum(n[row] - start, size)
            raw, at = memoryview(ids.tobytes()), 4 * (begin[row] + start)
            crc = [zlib.crc32(raw[a : a + w]) for a, w in zip(at.tolist(), (4 * length).tolist(), strict=True)]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(2).take(take), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(crc, pa.int64())],
                ["doc_id", "copy", "piece", "start", "length", "ids_crc32"],
            )

    return rows.mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first number, end number, first sequence, pieces a sequence, offset).

    Pieces numbered first..end-1 of that length fill sequences from the first on, so many each, side by side from the
    offset. Open sequences with equal room form one class, kept as runs of sequence numbers, so the work depends on
    the number of different lengths and not on the number of pieces.
    """
    out, room, rooms, made = [], {}, [], 0  # room: free ids -> runs [first sequence, end]; rooms: its keys in order

    def put(free: int, first: int, end: int) -> None:
        if free <= 0 or first == end:
            return
        if free not in room:
            room[free] = []
            bisect.insort(rooms, free)
        room[free].append((first, end))

    for length in sorted(counts, reverse=True):
        left, number = counts[length], 0
        while left:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                free = rooms[k]
                first, end = room[free].pop()
                if not room[free]:
                    del room[free]
                    rooms.pop(k)
            else:
                free, first = size, made
                end = made = made + -(-left // (size // length))
            each = free // length
            full = min(end - first, left // each)
            if full:
                out.append((length, number, number + full * each, first, each, size - free))
                number, left = number + full * each, left - full * each
                put(free - each * length, first, first + full)
                first += full
            if left and first < end:  # one more sequence takes the rest of this length
                out.append((length, number, number + left, first, each, size - free))
                put(free - left * length, first, first + 1)
                number, left, first = number + left, 0, first + 1
            put(free, first, end)
    return out


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 4096) -> DataFrame:
    """Pieces with sequence_id and offset: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = common.materialise(pieces(docs, tokenizer, end_id, size), "pieces")
    total = common.input_bytes(cut)
    chunks = max(CHUNKS, total // (4 << 20))
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(chunks)))
    by_chunk = cut.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    by_chunk = common.materialise(by_chunk, "lengths")
    counts = {r["length"]: r["n"] for r in by_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    slots = plan(counts, size)
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    by_chunk = by_chunk.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "chunk").orderBy("doc_id", "copy", "piece")
    numbered = cut.withColumn("nth", F.row_number().over(inside) - 1).join(by_chunk, ["length", "chunk"]).withColumn("nth", F.col("nth") + F.col("before"))
    slot = spark.createDataFrame(slots, "length int, lo long, hi long, first long, each long, base long")
    k = F.col("nth") - F.col("lo")
    return numbered.join(F.broadcast(slot), (numbered["length"] == slot["length"]) & (F.col("nth") >= F.col("lo")) & (F.col("nth") < F.col("hi"))).select(
        "doc_id",
        "piece",
        "start",
        numbered["length"].cast("long").alias("length"),
        "ids_crc32",
        (F.col("first") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + (k % F.col("each")) * numbered["length"]).cast("long").alias("offset"),
    )
