"""Exact most frequent values without a shuffle of all distinct values.

Each task keeps a bounded summary of its values (counters, of which the least are dropped against each other when they are too
many), and how much any value may have been undercounted. Only values that may be among the first k are then counted exactly; if the
k-th count doesn't exceed what a value without a counter may have, more counters are taken, and at last all values are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from servista.plans.session import scratch

#: Counters of a task at first, how they grow, and at most.
COUNTERS, GROWTH, MOST = 1 << 14, 8, 1 << 20
#: Candidates of at most so many are broadcast.
BROADCAST = 1_000_000


def reduced(counts: dict[str, int], most: int) -> int:
    """Keep at most `most` counters: all lose as much as the first one that goes has. How much that is."""
    if len(counts) <= most:
        return 0
    cut = sorted(counts.values(), reverse=True)[most]
    for value in [v for v, n in counts.items() if n <= cut]:
        del counts[value]
    for value in counts:
        counts[value] -= cut
    return cut


def summaries(values: DataFrame, counters: int) -> DataFrame:
    """(value, n) of each task's counters, and with a null value how much it may have undercounted any; values has one column, no nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        missed = 0
        for b in batches:
            seen = pc.value_counts(b.column(0))
            for value, n in zip(seen.field(0).to_pylist(), seen.field(1).to_pylist(), strict=True):
                counts[value] = counts.get(value, 0) + n
            if len(counts) > 2 * counters:
                missed += reduced(counts, counters)
        missed += reduced(counts, counters)
        yield pa.RecordBatch.from_arrays([pa.array([*counts, None], pa.string()), pa.array([*counts.values(), missed], pa.int64())], ["value", "n"])

    return values.select(F.col(values.columns[0]).cast("string").alias("value")).mapInArrow(run, "value string, n long")


def candidates(values: DataFrame, k: int, counters: int = COUNTERS) -> DataFrame | None:
    """A written table of values among which the k most frequent ones and their ties surely are; None where counters are too few."""
    while counters <= MOST:
        work = scratch(values.sparkSession, "frequent")
        summaries(values, counters).groupBy("value").agg(F.sum("n").alias("n")).write.parquet(work)
        seen = values.sparkSession.read.schema("value string, n long").parquet(work)
        missed = seen.filter("value IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        top = seen.filter("value IS NOT NULL").orderBy(F.desc("n")).limit(k).agg(F.count("*").alias("k"), F.min("n").alias("n")).first()
        if not missed:  # every value has its counter
            return seen.filter("value IS NOT NULL").filter(F.col("n") >= F.lit(top["n"])).select("value")
        if top["k"] == k and top["n"] > missed:
            return seen.filter("value IS NOT NULL").filter(F.col("n") + missed >= top["n"]).select("value")
        counters *= GROWTH
    return None


def top_values(values: DataFrame, k: int, counters: int = COUNTERS) -> DataFrame:
    """The k most frequent values (as strings, nulls are one) of a table's only column, with n: by count, then value.

    The plan gathers nothing in one task but the first k rows of each.
    """
    value = F.col(f"`{values.columns[0]}`").cast("string").alias("value")
    rows = values.select(value)
    some = candidates(rows.filter("value IS NOT NULL"), k, counters)
    if some is not None:
        few = some.limit(BROADCAST + 1).count() <= BROADCAST
        nulls = rows.filter("value IS NULL").groupBy("value").agg(F.count("*").alias("n"))
        counted = rows.join(F.broadcast(some) if few else some, "value", "left_semi").groupBy("value").agg(F.count("*").alias("n")).union(nulls)
    else:
        counted = rows.groupBy("value").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(k)
