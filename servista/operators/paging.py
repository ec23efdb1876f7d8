"""Pages far down an order, without holding the rows before them.

The order's keys are cut into ranges, and rows are counted by range; the ranges before the page are only counted, the one or two that
hold it are cut again while they are large, and at last sorted alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from servista.functions.ranges import place

#: Ranges of one cut, values sampled for their bounds, rows of a range that is sorted.
RANGES, SAMPLE, ROWS = 64, 4000, 1_000_000


def order_key(df: DataFrame, order: list[tuple[str, bool]]) -> Column:
    """A struct that sorts as the columns do, each (name, ascending): nulls first ascending, last descending, as in Spark."""
    kinds = {f.name: f.dataType for f in df.schema}
    parts = []
    for k, (name, ascending) in enumerate(order):
        c, kind = F.col(f"`{name}`"), kinds[name]
        if not ascending:
            if isinstance(kind, T.TimestampType):
                c = -F.unix_micros(c)
            elif isinstance(kind, T.TimestampNTZType):
                c = -F.unix_micros(c.cast("timestamp"))
            elif isinstance(kind, T.DateType):
                c = -F.unix_date(c)
            elif isinstance(kind, T.NumericType):
                c = -c
            else:
                raise ValueError(f"{name}: descending order needs a number or a time")
        null = F.col(f"`{name}`").isNull()
        parts += [(~null if ascending else null).alias(f"n{k}"), c.alias(f"v{k}")]
    return F.struct(*parts)


def _cut(rows: DataFrame, n: int) -> list:
    """Distinct keys between at most RANGES ranges, from a sample of bounded size."""
    keys = sorted({r[0] for r in rows.select("__key").sample(min(1.0, SAMPLE / n), seed=11).orderBy("__key").limit(4 * SAMPLE).collect()}, key=_comparable)
    step = max(1, len(keys) // RANGES)
    return keys[step::step]


def _comparable(key) -> list:
    return [(x is not None, x) if x is not None else (False, 0) for x in key]


def _literal(key, kind: T.StructType) -> Column:
    return F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(key, kind, strict=True)])


def page(df: DataFrame, order: list[tuple[str, bool]], limit: int, offset: int = 0, most: int = ROWS) -> DataFrame:
    """`limit` rows from `offset` on in the order of the columns, each (name, ascending), which should tell rows apart.

    Only a range of at most about `most` rows is sorted, unless a page or the rows of one key are more.
    """
    rows = df.withColumn("__key", order_key(df, order))
    kind = rows.schema["__key"].dataType
    assert isinstance(kind, T.StructType)
    n = rows.count()
    while n > most and offset < n:
        between = _cut(rows, n)
        if not between:
            break
        part = place(F.col("__key"), [_literal(b, kind) for b in between])
        counts = sorted((r["part"], r["n"]) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
        before, wanted = 0, []
        for p, size in counts:
            if before < offset + limit and before + size > offset:
                wanted.append((p, before, size))
            before += size
        first, last = wanted[0][0], wanted[-1][0]
        left = sum(size for _, _, size in wanted)
        if left == n:  # one key, or a page of nearly all rows
            break
        low = F.col("__key") >= _literal(between[first - 1], kind) if first else F.lit(True)
        high = F.col("__key") < _literal(between[last], kind) if last < len(between) else F.lit(True)
        rows, offset, n = rows.filter(low & high), offset - wanted[0][1], left
    return rows.orderBy("__key").offset(offset).limit(limit).drop("__key")
