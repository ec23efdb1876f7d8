"""Shared plumbing: the shared work folder, batch slicing and byte-level text arrays."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Raw text bytes that one vectorised step handles at once; a longer single text is a step of its own.
STEP_BYTES = 250_000
#: Texts that one step handles at most.
STEP_ROWS = 4096

#: A table of single numbers is broadcast where it has at most so many rows, else it is joined by a shuffle.
BROADCAST_ROWS = 1_000_000

#: Size that a table without an estimate is taken to have.
UNKNOWN_BYTES = 256 << 20
#: Rows, and bytes, that Spark hands to Python at once.
ARROW_ROWS, ARROW_BYTES = 2000, 4 << 20

_made: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent (a local session in tests) a temporary folder of this machine is used.
    Folders are removed when the driver's process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not base:
        base = "file://" + os.path.join(tempfile.gettempdir(), "servista-work")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session may have stopped already
            return


def _write(df: DataFrame, path: str) -> DataFrame:
    """df as a table at path; the shuffles of writing it go at once."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and is safe when executors are lost."""
    return _write(df, work_dir(df.sparkSession, name))


def drop(*tables: DataFrame) -> None:
    """Delete tables that materialise() made, when nothing reads them any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            _delete(df.sparkSession, files[0].rsplit("/", 1)[0])


@contextlib.contextmanager
def scratch(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """materialise()'s table, for this block only."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    try:
        yield _write(df, path)
    finally:
        _delete(spark, path)


def few(df: DataFrame) -> DataFrame:
    """df, a written table of numbers, to be broadcast in a join where it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def by_key(df: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """The rows of df whose column `on` is (left_semi) or isn't (left_anti) the only column of keys; nulls count as equal.

    keys is broadcast where it has at most BROADCAST_ROWS rows, so that df needn't be shuffled; else both are.
    """
    return df.join(few(keys.toDF("__key").distinct()), df[on].eqNullSafe(F.col("__key")), how)


def input_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of the size of df's sources, used to choose numbers of partitions only."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else UNKNOWN_BYTES  # rows that came from no file have no estimate


def parts(df: DataFrame, each: int = 16 << 20, least: int = 1, most: int = 100_000) -> int:
    return max(least, min(most, -(-input_bytes(df) // each)))


def lean_memory(block_mb: int = 1) -> None:
    """In a worker process: give freed blocks from that size on back at once, as an executor's Python workers share its limit
    with the JVM. The first call counts."""
    if _lean:
        return
    _lean.append(True)
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, block_mb << 20)
        libc.mallopt(-1, 2 * block_mb << 20)  # free memory at the end of the heap that goes back
    pa.set_memory_pool(pa.system_memory_pool())


_lean: list[bool] = []


def small_batches(spark: SparkSession) -> None:
    """Have Spark hand long texts to Python in small batches, unless the session asks for smaller ones still."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


_resident: list = [None, None]


def resident(key: object, make: Callable[[], Any]) -> Any:
    """make()'s object, kept for later tasks of this worker process until another key is asked for: one large object at a time."""
    if _resident[0] != key:
        no_resident()
        _resident[:] = [key, make()]
    return _resident[1]


def no_resident() -> None:
    """Let go of the worker's resident object and of free memory."""
    _resident[:] = [None, None]
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_only(docs: DataFrame, *cols: str) -> DataFrame:
    """doc_id as long and text with nulls as empty; other columns only if named. Extra or clashing ones go.

    Also makes Spark hand texts to Python in batches of ARROW_ROWS, as a batch of long texts takes much memory.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *[F.col(c) for c in cols])


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that the texts of each hold about step bytes; a longer text comes alone."""
    lean_memory()
    for b in batches:
        if not b.num_rows:
            continue
        offs = text_arrays(b.column(b.schema.get_field_index(column)))[1]
        i = 0
        while i < b.num_rows:
            j = int(np.searchsorted(offs, offs[i] + step, side="right")) - 1
            j = min(max(j, i + 1), i + STEP_ROWS, b.num_rows)
            yield b.slice(i, j - i)
            i = j


def text_arrays(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and n+1 offsets into them. Nulls are empty."""
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random odd 64-bit number for each byte value, and powers for positional hashes.
BYTE_HASH = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(int(BASE), -1, 2**64))
_pow: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if not _pow or len(_pow[0]) < n:
        m = max(n, STEP_BYTES + 4096)
        one = np.ones(m, np.uint64)
        one[1:] = BASE
        inv = np.ones(m, np.uint64)
        inv[1:] = BASE_INV
        _pow[:] = [np.multiply.accumulate(one), np.multiply.accumulate(inv)]
    return _pow[0][:n], _pow[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit. Works in place on uint64."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of hashes of bytes i..j-1, each times BASE**position."""
    pw, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_HASH[data] * pw, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span stands."""
    _, inv = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` of texts lying in a row, and n+1 word offsets of the texts."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    inner = offs[:-1][offs[:-1] < len(data)]
    before[inner] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offs[1:][offs[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs, side="left")


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def _low_pairs() -> np.ndarray:
    low = np.arange(0x800, dtype=np.uint16)
    for c in range(0x80, 0x800):
        x = chr(c).lower()
        if len(x) == 1 and 0x80 <= ord(x) < 0x800:
            low[c] = ord(x)
    return low


_LOW_PAIRS = _low_pairs()


def lower_letters(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of letters of two UTF-8 bytes (Latin, Greek, Cyrillic and more); places stay."""
    data = _LOWER[data]
    at = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
    if len(at):
        low = _LOW_PAIRS[((data[at].astype(np.uint16) & 0x1F) << 6) | (data[at + 1] & 0x3F)]
        data[at], data[at + 1] = 0xC0 | (low >> 6), 0x80 | (low & 0x3F)
    return data


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + l) for each pair."""
    total = int(lens.sum())
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


def open_output(path: str):
    """A stream to write path on any file system that pyarrow knows; folders are made as needed."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    system.create_dir(os.path.dirname(inner), recursive=True)
    return system.open_output_stream(inner)


def open_input(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)
