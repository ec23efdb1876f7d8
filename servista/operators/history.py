"""Type-2 history of keyed changes, and what is asked of it.

The history of a key comes from all its changes at once, ordered by their sequence column, so late and out-of-order
rows fall into place and running it again changes nothing. One shuffle by key serves every step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from servista.functions.clean import METADATA
from servista.functions.dates import hours_between

START, END = "__START_AT", "__END_AT"


def apply_changes(changes: DataFrame, key: str, sequence: str, track: list[str] | None = None, except_columns: tuple[str, ...] = METADATA, tie: list[str] | None = None) -> DataFrame:
    """Versions of each key: the kept columns with __START_AT and __END_AT (null while current).

    Rows without key or sequence go. Of rows with equal key and sequence the last by the tie columns, then by content, stays.
    A version starts where a tracked column differs, nulls counted as equal, from the row before; track=None tracks
    every kept column.
    """
    kept = [c for c in changes.columns if c not in except_columns]
    tracked = [c for c in (track or kept) if c != key]
    order = Window.partitionBy(key).orderBy(sequence, *[F.col(c).asc_nulls_first() for c in (tie or [])], F.xxhash64(*kept))
    last = changes.filter(F.col(key).isNotNull() & F.col(sequence).isNotNull()).withColumn("__next", F.lead(sequence).over(order))
    last = last.filter(F.col("__next").isNull() | (F.col("__next") != F.col(sequence)))
    order = Window.partitionBy(key).orderBy(sequence)
    state = F.struct(*tracked)
    before = last.withColumn("__before", F.lag(F.struct(state.alias("s"))).over(order))
    opened = before.filter(F.col("__before").isNull() | ~F.col("__before.s").eqNullSafe(state))
    return opened.select(*kept, F.col(sequence).alias(START), F.lead(sequence).over(order).alias(END))


def current(history: DataFrame) -> DataFrame:
    return history.filter(F.col(END).isNull())


def current_requests(history: DataFrame) -> DataFrame:
    """Current versions with resolution hours, as the gold queries read them."""
    hours = F.when(F.col("closed_date").isNotNull(), hours_between(F.col("created_date"), F.col("closed_date")))
    return current(history).withColumn("resolution_hours", hours).withColumnsRenamed({START: "valid_from", END: "valid_to"})


def as_of(history: DataFrame, moment: Column) -> DataFrame:
    """The version of each key that was valid at a moment."""
    return history.filter((F.col(START) <= moment) & (F.col(END).isNull() | (F.col(END) > moment)))


def open_at(history: DataFrame, moments: DataFrame, column: str, unit: int = 86_400) -> DataFrame:
    """history's rows joined with each of the moments (distinct times) at which they are valid, as `column`.

    Time is cut into bins of `unit` seconds between the first and last moment. A version stands under the few bins and doublings
    of bins (at most two of each size) that cover it, a moment under its own bin and its doublings: they meet once, by equality, and are then
    compared exactly. A version of many days is never copied to each of its days, and no moment meets every version.
    """
    span = moments.agg(F.unix_seconds(F.min(F.col(column).cast("timestamp"))).alias("low"), F.unix_seconds(F.max(F.col(column).cast("timestamp"))).alias("high")).first()
    low, high = span["low"] or 0, span["high"] or 0
    last = (high - low) // unit
    levels = F.sequence(F.lit(0), F.lit(last.bit_length()))

    def bin_of(moment: Column) -> Column:
        return F.floor((F.unix_seconds(moment.cast("timestamp")) - F.lit(low)) / F.lit(unit)).cast("long")

    first, after = F.greatest(bin_of(F.col(START)), F.lit(0)), F.least(F.coalesce(bin_of(F.col(END)), F.lit(last)), F.lit(last)) + 1
    # at each doubling: an odd bin at the start, and the one before an odd end, are no half of a larger bin inside
    at = lambda size, up: F.ceil(F.col("__first") / F.pow(F.lit(2.0), size)).cast("long") if up else F.floor(F.col("__after") / F.pow(F.lit(2.0), size)).cast("long")

    def covers(size: Column) -> Column:
        a, z = at(size, True), at(size, False)
        left = F.when((a < z) & (a % 2 == 1), F.struct(size.alias("size"), a.alias("bin")))
        right = F.when((a < z) & (z % 2 == 1), F.struct(size.alias("size"), (z - 1).alias("bin")))
        return F.array(left, right)

    spread = history.withColumns({"__first": first, "__after": after}).filter("__first < __after")
    spread = spread.withColumn("__at", F.explode(F.filter(F.flatten(F.transform(levels, covers)), lambda x: x.isNotNull()))).drop("__first", "__after")
    own = F.transform(levels, lambda size: F.struct(size.alias("size"), F.floor(F.col("__bin") / F.pow(F.lit(2.0), size)).cast("long").alias("bin")))
    dealt = moments.select(F.col(column)).filter(F.col(column).isNotNull()).withColumn("__bin", bin_of(F.col(column))).withColumn("__at", F.explode(own)).drop("__bin")
    met = spread.select("*", F.col("__at.size").alias("__size"), F.col("__at.bin").alias("__own")).drop("__at").join(dealt.select(column, F.col("__at.size").alias("__size"), F.col("__at.bin").alias("__own")), ["__size", "__own"])
    return met.filter((F.col(START) <= F.col(column)) & (F.col(END).isNull() | (F.col(END) > F.col(column)))).drop("__size", "__own")


def status_history(history: DataFrame, key: str, now: Column, keep: list[str]) -> DataFrame:
    """Every version with its hours (open ones up to `now`), number and whether it is current."""
    order = Window.partitionBy(key).orderBy(START)
    return history.select(
        key,
        *keep,
        F.col(START).alias("version_start"),
        F.col(END).alias("version_end"),
        hours_between(F.col(START), F.coalesce(END, now)).alias("hours_in_status"),
        F.row_number().over(order).alias("version_number"),
        F.col(END).isNull().alias("is_current"),
    )


def request_history(history: DataFrame, key: str, value: object) -> DataFrame:
    return history.filter(F.col(key) == F.lit(value)).orderBy(START)


def time_in_status(versions: DataFrame) -> DataFrame:
    return versions.groupBy("status").agg(F.count("*").alias("versions"), F.avg("hours_in_status").alias("avg_hours"))


def transitions(versions: DataFrame, key: str, by: list[str], accuracy: int = 1_000_000) -> DataFrame:
    """Counts and durations by status and the status after it; current versions have none yet."""
    after = Window.partitionBy(key).orderBy("version_start")
    hours = F.col("hours_in_status")
    return (
        versions.withColumn("next_status", F.lead("status").over(after))
        .filter(F.col("next_status").isNotNull())
        .groupBy(F.col("status").alias("from_status"), F.col("next_status").alias("to_status"), *by)
        .agg(
            F.count("*").alias("transition_count"),
            F.avg(hours).alias("avg_hours_before_transition"),
            F.percentile_approx(hours, 0.5, accuracy).alias("median_hours_before_transition"),
            F.avg(F.when(hours > 0.1, hours)).alias("avg_hours_excl_instant"),
            F.min(hours).alias("min_hours"),
            F.max(hours).alias("max_hours"),
        )
    )
