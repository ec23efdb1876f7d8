"""Near-duplicate groups by MinHash with sequential Bayesian verification (operator 5).

Documents are sets of distinct two-word shingles (five in the pipeline); two are linked where the Jaccard similarity
of their full sets is at least the threshold, and a group is a connected component of these links.

1. One pass over the texts gives each document's set size, a 64-bit hash of the set, BANDS keys of ROWS MinHash values
   each, and the signature cut to one byte a value. Documents with equal sets are one node from here on (among N different sets, two share a
   hash with probability N**2 / 2**65: 1 in 40 for a thousand million).
2. Nodes that share a band key are candidates. Instead of all pairs of a bucket, each node is paired with the bucket's
   least node, which is random as hashes are: pairs are linear in the number of nodes.
3. Pairs are compared STEP signature values at a time. After each step a pair goes when, given the matches so far and
   a uniform prior, the posterior probability of reaching the threshold is below MISS. What is left is verified exactly.
4. Components of verified pairs. Buckets that hold several components still hide untested pairs: nodes outside a bucket's
   largest component are compared exactly with all nodes of such buckets, part against part, each part with an
   inverted index of its shingles. Nothing is emitted but links of components. No bucket is capped.
5. Final components.

Sets are compared by 64-bit hashes of their shingles. A link can be missed only where its nodes share no band key ((1 - 0.8**5)**40: 1 in 8 million at similarity 0.8).

Edge cases: null, empty and wordless texts have the empty set and are linked with nothing; a text with fewer words
than a shingle is one shingle; rows that repeat, and rows of equal doc_id, get the same component when their sets are
equal or linked; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import common
from .graph import components

BANDS, ROWS = 40, 5
STEP, MISS = 40, 1e-6
#: Compressed text that one part of an open group holds, about.
BLOCK_BYTES = 4 << 20

_rng = np.random.Generator(np.random.PCG64(5))
_XOR = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_MUL = _rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_JOIN = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text in a row, ascending within a text, and n+1 offsets into them."""
    data = common.lower_ascii(data)
    starts, ends, at = common.words(data, offs)
    n_texts = len(offs) - 1
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(n_texts + 1, np.int64)
    word = common.span_hash(common.prefix_hash(data), starts, ends)
    n_words = np.diff(at)
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    first = common.ranges(at[:-1], n)
    size = np.repeat(np.minimum(n_words, width), n)
    h = np.zeros(len(first), np.uint64)
    for j in range(width):
        here = size > j if (size < width).any() else slice(None)
        h[here] = h[here] * _JOIN + word[first[here] + j]
    common.mix(h)
    ends = np.cumsum(n)
    for a, z in zip((ends - n).tolist(), ends.tolist(), strict=True):
        h[a:z].sort()
    fresh = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=fresh[1:])
    fresh[(ends - n)[n > 0]] = True
    return h[fresh], np.concatenate([[0], np.cumsum(fresh)])[np.concatenate([[0], ends])]


def _least(values: np.ndarray, offs: np.ndarray, full: np.ndarray) -> np.ndarray:
    return np.minimum.reduceat(values, offs[:-1][full])


def signatures(sets: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each set that is not empty: BANDS keys (int64), signature bytes, and a hash of the set (int64)."""
    full = np.flatnonzero(np.diff(offs))
    x = (common.mix(sets.copy()) >> np.uint64(32)).astype(np.uint32)
    low = np.empty((len(full), BANDS), np.int64)
    sig = np.empty((len(full), BANDS * ROWS), np.uint8)
    for b in range(BANDS):
        key = np.full(len(full), b + 1, np.uint64)
        for j in range(b * ROWS, (b + 1) * ROWS):
            m = _least((x ^ _XOR[j]) * _MUL[j], offs, full)
            sig[:, j] = (m * np.uint32(0x9E3779B1)) >> np.uint32(24)
            key = key * _JOIN + m
        low[:, b] = common.mix(key).view(np.int64)
    whole = np.add.reduceat(common.mix(sets * common.BASE), offs[:-1][full]) + np.diff(offs)[full].astype(np.uint64) * _JOIN
    return low, sig, common.mix(whole).view(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    """An array of equal-sized binary values from the rows of a byte matrix."""
    n, w = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, n * w + 1, w, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _spread(values: pa.Array, full: np.ndarray, n: int) -> pa.Array:
    """values at the places full of n, nulls elsewhere."""
    at = np.full(n, -1, np.int64)
    at[full] = np.arange(len(full))
    return values.take(pa.array(at, mask=at < 0))


def sketch(docs: DataFrame, width: int, tag: str | None = None) -> DataFrame:
    """doc_id, n (set size), node (set hash, null for an empty set), keys, sig, packed (the text under zstd), tag (null if none) for each row."""
    rows = common.text_only(docs.withColumn("tag", F.col(tag) if tag else F.lit(None).cast("long")), "tag")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.no_resident()
        press = zstandard.ZstdCompressor(level=1)
        for b in common.slices(batches):
            data, offs = common.text_arrays(b.column(1))
            sets, at = shingle_sets(data, offs, width)
            keys, sig, ids = signatures(sets, at) if len(sets) else (np.empty((0, BANDS), np.int64), np.empty((0, BANDS * ROWS), np.uint8), np.empty(0, np.int64))
            full, n = np.flatnonzero(np.diff(at)), b.num_rows
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            raw = data.tobytes()
            packed = [press.compress(raw[s:e]) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at).astype(np.int64)), _spread(pa.array(ids), full, n), _spread(flat, full, n), _spread(_binary(sig), full, n), pa.array(packed, pa.binary()), b.column(2)], ["doc_id", "n", "node", "keys", "sig", "packed", "tag"])

    return rows.mapInArrow(run, "doc_id long, n long, node long, keys array<long>, sig binary, packed binary, tag long")


def least_matches(threshold: float, miss: float = MISS, step: int = STEP, total: int = BANDS * ROWS) -> list[int]:
    """After step, 2*step, ... values: the fewest matches that keep P(similarity >= threshold | matches) at least miss.

    A signature byte also matches by chance, once in 256; the prior is uniform.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256
    out = []
    for n in range(step, total + 1, step):
        for m in range(n + 1):
            like = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(like - like.max())
            if w[s >= threshold].sum() >= miss * w.sum():
                break
        out.append(m)
    return out


def prune(pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, sig_a, sig_b) that the posterior bound leaves, as (a, b)."""
    least = least_matches(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (text_matrix(b.column(k)) for k in (2, 3))
            alive, matches = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
            for k, m in enumerate(least):
                cut = slice(k * STEP, (k + 1) * STEP)
                matches[alive] += (x[alive, cut] == y[alive, cut]).sum(axis=1)
                alive = alive[matches[alive] >= m]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(alive)) for c in b.columns[:2]], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def text_matrix(col: pa.Array) -> np.ndarray:
    data, _ = common.text_arrays(col)
    return data.reshape(len(col), -1)


def _sets_of(packed: list[bytes], width: int) -> list[np.ndarray]:
    open_ = zstandard.ZstdDecompressor()
    out = []
    for p in packed:
        data = np.frombuffer(open_.decompress(p), np.uint8)
        out.append(shingle_sets(data, np.array([0, len(data)]), width)[0])
    return out


def _linked(both, total, percent: int):
    return 100 * both >= percent * (total - both)


def verify(pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b, text_a, text_b), texts packed, whose full sets are similar enough, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for b in batches:
            keep = []
            for i, (node, pa_, pb) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if node != last[0]:
                    last = (node, _sets_of([pb], width)[0])
                x, y = _sets_of([pa_], width)[0], last[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if _linked(both, len(x) + len(y), percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(keep, pa.int64())) for c in b.columns[:2]], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def block_links(small: DataFrame, large: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between nodes of small and large, which have (big, comp, node, packed), where big is equal and comp is not.

    Each side of a group is dealt into as few parts as hold BLOCK_BYTES each (about); each part meets each part of the other
    side under a key of its own. A text is shuffled once for each part of the other side: once in all for groups of up to
    BLOCK_BYTES, whatever its number of members.
    """
    size = F.length("packed")

    def parts(df: DataFrame) -> DataFrame:
        return df.groupBy("big").agg(F.ceil(F.sum(size) / BLOCK_BYTES).alias("n"))

    counts = common.few(common.materialise(parts(small).withColumnRenamed("n", "n_small").join(parts(large).withColumnRenamed("n", "n_large"), "big"), "parts"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        df = df.join(counts, "big").withColumn(own, F.pmod(F.xxhash64("node"), F.col(f"n_{own}")))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n_{other}") - 1)))

    key = ["big", "small", "large"]
    # renamed, as both sides come from one table
    left, right = (dealt(df, a, b).select(*[F.col(c).alias(f"{a}_{c}") for c in (*key, "comp", "packed")]).groupBy(*[f"{a}_{c}" for c in key]) for df, a, b in ((small, "small", "large"), (large, "large", "small")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        theirs = _sets_of(right["large_packed"].to_pylist(), width)
        sizes = np.array([len(x) for x in theirs])
        every, of = np.concatenate(theirs), np.repeat(np.arange(len(theirs), dtype=np.int32), sizes)
        del theirs
        order = np.argsort(every, kind="stable")
        every, of = every[order], of[order]
        comps = right["large_comp"].to_numpy()
        out: set[tuple[int, int]] = set()
        for packed, comp in zip(left["small_packed"], left["small_comp"].to_pylist(), strict=True):
            own = _sets_of([packed.as_py()], width)[0]
            lo, hi = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
            both_n = np.bincount(of[common.ranges(lo, hi - lo)], minlength=len(sizes))
            hit = np.flatnonzero(_linked(both_n, sizes + len(own), percent) & (comps != comp))
            out.update((comp, c) for c in np.unique(comps[hit]).tolist())
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return left.cogroup(right).applyInArrow(run, "a long, b long")


def groups(docs: DataFrame, width: int = 2, percent: int = 80, tag: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the group), kept for each row of docs; with the column `tag` (a long) also that
    and `comp`, a number of the group (null for an empty set)."""
    seen = common.materialise(sketch(docs, width, tag), "sketches")
    has = seen.filter(F.col("node").isNotNull())
    nodes = common.materialise(has.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "nodes")
    keyed = has.select("node", F.posexplode("keys").alias("band", "key")).select(F.xxhash64("band", "key").alias("key"), "node")
    buckets = keyed.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first <> last").select("key", "first")
    buckets = common.materialise(buckets, "shared-keys")
    members = common.materialise(keyed.join(common.few(buckets), "key").groupBy("key", "node").agg(F.first("first").alias("first")), "buckets")

    pairs = common.materialise(members.filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct(), "candidates")
    involved = common.by_key(seen.select("node", "sig", "packed"), members.select("node"), "node").groupBy("node").agg(F.min(F.struct("packed", "sig")).alias("x")).select("node", "x.sig", "x.packed")
    involved = common.materialise(involved, "involved")
    a, b = (involved.select(F.col("node").alias(s), F.col("sig").alias(f"sig_{s}"), F.col("packed").alias(f"text_{s}")) for s in ("a", "b"))
    left = prune(pairs.join(a.select("a", "sig_a"), "a").join(b.select("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b"), percent / 100)
    left = common.materialise(left, "survivors")
    edges = common.materialise(verify(left.join(a.select("a", "text_a"), "a").join(b.select("b", "text_b"), "b").select("a", "b", "text_a", "text_b"), width, percent), "links")
    labels = components(edges)

    # buckets with several components
    member = members.select("key", "node").join(common.few(labels), "node", "left").select("key", "node", F.coalesce("label", "node").alias("comp"))
    sizes = labels.groupBy(F.col("label").alias("comp")).agg(F.count("*").alias("size"))
    sizes = common.materialise(sizes, "sizes")
    member = common.materialise(member.join(common.few(sizes), "comp", "left").withColumn("size", F.coalesce("size", F.lit(1))), "members")
    rank = F.struct("size", "comp")
    open_ = member.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max(rank).alias("top")).filter("c0 <> c1").select("key", F.col("top.comp").alias("big"))
    open_ = common.materialise(open_, "open-keys")
    opened = common.materialise(member.join(common.few(open_), "key").select("big", "comp", "node").distinct(), "open")
    packed = involved.select("node", "packed")
    large = opened.join(packed, "node").select("big", "comp", "node", "packed")
    more = common.materialise(block_links(large.filter("comp <> big"), large, width, percent), "more-links")
    merged = components(more, "merged")  # of components
    label = labels.select("node", F.col("label").alias("comp"))
    final = nodes.select("node", "doc_id").join(common.few(label), "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(common.few(merged.select(F.col("node").alias("comp"), F.col("label").alias("top"))), "comp", "left").select("node", "doc_id", F.coalesce("top", "comp").alias("comp"))
    final = common.materialise(final, "final")
    common.drop(nodes, buckets, sizes, open_, members, pairs, involved, left, edges, labels, member, opened, more, merged)
    least = final.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of_node = final.select("node", "comp").join(least, "comp").select("node", "component_id", "comp")
    out = seen.select("doc_id", "n", "node", "tag").join(of_node, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), *(["tag", "comp"] if tag else []))
