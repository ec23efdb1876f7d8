"""Exact Jaccard join in metric space: pivots, Voronoi regions, windows (operator 13).

Documents are sets of distinct shingles; 1 - similarity is a metric, so with D = 1 - threshold and a pivot p, two documents x and
y that link (distance at most D) have |d(x, p) - d(y, p)| <= D. Texts that share no shingle all lie at distance 1 from each other,
and a pivot tells nothing about them; so regions are begun from what two linked sets must share:

1. Equal sets are one node (by two 64-bit hashes). Of a set's n shingles in one order for all, the first n - ceil(threshold * n) + 1
   are its prefix: linked sets share a shingle of their prefixes. Shingles that repeat within a scanned stretch come last in that
   order, so passages that many texts share seldom open a group. Nodes of like size with a prefix shingle in common are a group.
2. The first node of a group is its pivot; a pivot's region is all members of its groups, and distances to it are exact. A bound
   comes first: the sets thrown into a number of bins keep at least their similarity as multisets of bins, so pairs that are
   too far in bins are too far.
3. Within D of the pivot is the core: linked with the pivot, so one component. From D to 2D is the window: the only other members that
   can link with the core, by the triangle inequality. They are replicated to the core and compared with it exactly.
4. What is not in the core stays in its groups, these choose new pivots, and so on while members grow fewer. Regions that pivots
   no longer divide are compared exactly, part against part, each part in bounded memory.
5. Components of all links.

No link is missed but by a collision of 64-bit shingle hashes. Which shingles come last changes the work only, never the links;
their number is bounded (LAST). No group, region or number of partners is capped.

Edge cases: null, empty and wordless texts have the empty set and are linked with nothing; a text with fewer words than a
shingle is one shingle; rows that repeat, and rows of equal doc_id, get the same component when their sets are equal or linked;
a null doc_id is never a component's id unless all its documents have none; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import common
from .graph import components
from .neardup import block_links, shingle_sets

#: Shingles that are known to repeat, at most; how often one must.
LAST, OFTEN = 400_000, 8
#: Shingles among which a task looks for repeated ones at once.
STRETCH = 1 << 21
#: The recursion goes on while a level leaves at most this share of the members.
SHRINK = 0.75
_SECOND = np.uint64(0x8CB92BA72F3D8DD7)


def _sets(packed: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The shingle set of each packed text, about STEP_BYTES of texts at a time."""
    open_ = zstandard.ZstdDecompressor()
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        data = np.frombuffer(b"".join(held), np.uint8)
        sets, at = shingle_sets(data, np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64), width)
        yield from (sets[a:z] for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))

    for p in packed:
        raw = open_.decompress(p)
        if held and size + len(raw) > common.STEP_BYTES:
            yield from flush()
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield from flush()


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of (node, n, packed), a step at a time, with their sets in a row and offsets."""
    common.lean_memory()
    for b in batches:
        for i in range(0, b.num_rows, 256):
            some = b.slice(i, 256)
            sets = list(_sets(some.column(2).to_pylist(), width))
            yield some, np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])


def scan(docs: DataFrame, width: int) -> DataFrame:
    """row (any number), doc_id, n (set size), h1 and h2 (hashes of the set, null if empty) and the packed text of each row."""
    rows = common.text_only(docs).withColumn("row", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.no_resident()
        press = zstandard.ZstdCompressor(level=1)
        for b in common.slices(batches):
            data, offs = common.text_arrays(b.column(1))
            sets, at = shingle_sets(data, offs, width)
            n = np.diff(at)
            full = np.flatnonzero(n)
            h = np.zeros((2, len(n)), np.int64)
            for k, salt in enumerate((common.BASE, _SECOND)):
                if len(full):
                    h[k, full] = common.mix(np.add.reduceat(common.mix(sets * salt), at[:-1][full]) + n[full].astype(np.uint64) * salt).view(np.int64)
            raw = data.tobytes()
            packed = [press.compress(raw[a:z]) for a, z in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array(n), *[pa.array(x, mask=n == 0) for x in h], pa.array(packed, pa.binary())], ["row", "doc_id", "n", "h1", "h2", "packed"])

    return rows.mapInArrow(run, "row long, doc_id long, n long, h1 long, h2 long, packed binary")


def repeated(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that were seen to repeat, ascending, and how often (as a power of two): at most LAST, the most frequent ones.

    Each task counts among STRETCH shingles of its own and passes on those that repeat there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            s, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(s[n > 1].view(np.int64)), pa.array(n[n > 1])], ["s", "n"])

        for _, sets, _ in _batches(batches, width):
            held.append(sets)
            if sum(map(len, held)) >= STRETCH:
                yield flush()
                held = []
        if held:
            yield flush()

    found = texts.select("node", "n", "packed").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)
    got = found.orderBy(F.desc("n"), "s").limit(LAST).toArrow()
    s, n = got["s"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(s)
    return s[order], np.log2(np.maximum(n[order], 1)).astype(np.uint8)


def prefixes(texts: DataFrame, width: int, percent: int, last: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(s, node, n): the shingles of each node's prefix."""
    late, often = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets, at in _batches(batches, width):
            n = np.diff(at)
            rank = np.zeros(len(sets), np.uint8)
            if len(late):
                p = np.minimum(np.searchsorted(late, sets), len(late) - 1)
                rank = np.where(late[p] == sets, often[p] + 1, 0).astype(np.uint8)
            own = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((common.mix(sets.copy()), rank, own))
            take = n + (-percent * n // 100) + 1
            which = order[common.ranges(at[:-1], take)]
            yield pa.RecordBatch.from_arrays([pa.array(sets[which].view(np.int64)), b.column(0).take(pa.array(own[which])), pa.array(n[own[which]])], ["s", "node", "n"])

    return texts.select("node", "n", "packed").mapInArrow(run, "s long, node long, n long")


def bins(sets: np.ndarray) -> bytes:
    """Numbers of a set's shingles in a power of two of bins, about two a bin."""
    k = max(4, int(len(sets)).bit_length() - 2)
    while True:
        count = np.bincount((sets & np.uint64((1 << k) - 1)).astype(np.int64), minlength=1 << k)
        if count.max() < 256:
            return count.astype(np.uint8).tobytes()
        k += 1


def binned(texts: DataFrame, width: int) -> DataFrame:
    """(node, n, bins) of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets, at in _batches(batches, width):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([bins(sets[a:z]) for a, z in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["node", "n", "bins"])

    return texts.select("node", "n", "packed").mapInArrow(run, "node long, n long, bins binary")


def most_shared(x: bytes, y: bytes) -> int:
    """At most so many shingles are in both sets, by their bins."""
    a, b = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (x, y))
    k = min(len(a), len(b))
    return int(np.minimum(a.reshape(-1, k).sum(axis=0), b.reshape(-1, k).sum(axis=0)).sum())


def _within(both, total, percent: int):
    """Whether sets of together `total` elements with `both` in common are at least percent % similar."""
    return 100 * both >= percent * (total - both)


def near_in_bins(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, p, n_x, n_p, bins_x, bins_p) that bins leave, as (x, p)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = b.column(2).to_numpy() + b.column(3).to_numpy()
            both = np.array([most_shared(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)], np.int64)
            keep = pa.array(_within(both, total, percent))
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in b.columns[:2]], ["x", "p"])

    return pairs.mapInArrow(run, "x long, p long")


def shared(pairs: DataFrame, width: int) -> DataFrame:
    """(x, p, both, total) for pairs (x, p, text_x, text_p): shingles in both sets, and the sum of their sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean_memory()
        for b in batches:
            if not b.num_rows:
                continue
            pivots = dict(zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True))
            theirs = dict(zip(pivots, _sets(list(pivots.values()), width), strict=True))
            both, total = [], []
            for p, own in zip(b.column(1).to_pylist(), _sets(b.column(2).to_pylist(), width), strict=True):
                both.append(len(np.intersect1d(own, theirs[p], assume_unique=True)))
                total.append(len(own) + len(theirs[p]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(both, pa.int64()), pa.array(total, pa.int64())], ["x", "p", "both", "total"])

    return pairs.mapInArrow(run, "x long, p long, both long, total long")


def _open(members: DataFrame, label: str | None = None) -> DataFrame:
    """Members (g, node) of the groups that hold several nodes, or several labels, with the first node of each group as p."""
    by = label or "node"
    several = members.groupBy("g").agg(F.min("node").alias("p"), F.min(by).alias("lo"), F.max(by).alias("hi")).filter("lo <> hi").select("g", "p")
    return members.join(common.few(common.materialise(several, "open-groups")), "g")


def _labelled(nodes: DataFrame, labels: DataFrame | None, node: str = "node", name: str = "comp") -> DataFrame:
    """nodes with their component so far; a node without links is its own."""
    if labels is None:
        return nodes.withColumn(name, F.col(node))
    return nodes.join(common.few(labels.select(F.col("node").alias(node), "label")), node, "left").withColumn(name, F.coalesce("label", node)).drop("label")


def links(texts: DataFrame, width: int, percent: int) -> list[DataFrame]:
    """Tables of edges (a, b) between nodes whose components are those of all links. texts (node, n, packed) is a written table, and goes."""
    last = repeated(texts, width)
    keyed = common.materialise(prefixes(texts, width, percent, last), "prefixes")
    several = keyed.groupBy("s").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("s")
    several = common.materialise(several, "shared-shingles")
    step = math.log(100 / percent * 1.01)  # linked sets' sizes are this far apart at most, so their classes are equal or neighbours
    size = F.floor(F.log(F.col("n").cast("double")) / F.lit(step))
    dealt = keyed.join(common.few(several), "s").select("node", F.explode(F.array(F.xxhash64("s", size), F.xxhash64("s", size + 1))).alias("g"))
    members = common.materialise(_open(common.materialise(dealt, "sized")), "members")
    common.drop(keyed, several)
    ids = common.materialise(members.select("node").distinct(), "involved")
    every, texts = texts, common.materialise(common.by_key(texts, ids, "node").drop("__key"), "texts")
    common.drop(every)
    sketches = common.materialise(binned(texts, width), "bins")
    edges: list[DataFrame] = []
    labels: DataFrame | None = None
    packed = texts.select("node", "packed")
    far = 2 * percent - 100  # similarity at distance 2D

    while True:
        before = members.count()
        if not before:
            break
        pairs = common.materialise(members.filter("node <> p").select(F.col("node").alias("x"), "p").distinct(), "pairs")
        x, p = (sketches.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("bins").alias(f"bins_{s}")) for s in "xp")
        left = common.materialise(near_in_bins(pairs.join(x, "x").join(p, "p").select("x", "p", "n_x", "n_p", "bins_x", "bins_p"), far), "near")
        x, p = (packed.select(F.col("node").alias(s), F.col("packed").alias(f"text_{s}")) for s in "xp")
        left = shared(left.join(x, "x").join(p, "p").select("x", "p", "text_x", "text_p"), width).filter(_within(F.col("both"), F.col("total"), far))
        known = common.materialise(left.select("x", "p", _within(F.col("both"), F.col("total"), percent).alias("core")), "distances")
        core = known.filter("core").select("x", "p")
        edges.append(core.select(F.col("x").alias("a"), F.col("p").alias("b")))
        labels = components(reduce(DataFrame.union, edges), "so-far")

        # the window of each region against its core
        window = _labelled(_labelled(known.filter("not core").select("x", "p"), labels, "x"), labels, "p", "big_comp").filter("comp <> big_comp")
        window = common.materialise(window.select(F.col("p").alias("big"), "comp", F.col("x").alias("node")), "window")
        cores = _labelled(core.select(F.col("p").alias("big"), F.col("x").alias("node")), labels)
        cores = common.materialise(common.by_key(cores, window.select("big"), "big"), "cores")
        found = common.materialise(block_links(window.join(packed, "node").select("big", "comp", "node", "packed"), cores.join(packed, "node").select("big", "comp", "node", "packed"), width, percent), "window-links")
        if found.limit(1).count():
            edges.append(found)
            labels = components(reduce(DataFrame.union, edges), "so-far")

        # the rest of each group, without pivot and core
        rest = members.filter("node <> p").join(core.withColumnRenamed("x", "node"), ["node", "p"], "left_anti").select("g", "node")
        rest = common.materialise(_labelled(rest, labels), "rest")
        rest = common.materialise(_open(rest, "comp"), "members")
        common.drop(members, pairs)
        members = rest
        if members.count() > SHRINK * before:
            break

    # regions that pivots don't divide
    region = common.materialise(members.select(F.col("p").alias("big"), F.col("comp"), "node").distinct() if "comp" in members.columns else members.select(F.col("p").alias("big"), F.col("node").alias("comp"), "node"), "undivided")
    if region.limit(1).count():
        whole = region.join(packed, "node").select("big", "comp", "node", "packed")
        edges.append(common.materialise(block_links(whole, whole, width, percent), "region-links"))
    return edges


def groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) for each row of docs."""
    seen = common.materialise(scan(docs, width), "sets")
    nodes = common.materialise(seen.filter(F.col("h1").isNotNull()).groupBy("h1", "h2").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "nodes")
    texts = common.materialise(common.by_key(seen.select(F.col("row").alias("node"), "n", "packed"), nodes.select("node"), "node").drop("__key"), "distinct")
    rows = common.materialise(seen.select("doc_id", "n", "h1", "h2"), "rows")
    common.drop(seen)
    edges = links(texts, width, percent)
    labels = components(reduce(DataFrame.union, edges)) if edges else None
    own = common.materialise(_labelled(nodes, labels), "labelled")
    least = own.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_set = own.select("h1", "h2", "comp").join(least, "comp").select("h1", "h2", "component_id")
    return rows.join(of_set, ["h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
