"""Running sums and exact order statistics without one task for a whole order.

A table is cut into slices of the value at approximate quantiles. Rows are summed up inside slices, slices are led by the sums
of the slices before them. A slice of a table with a row per value holds about one in ``SLICES`` of its rows, whatever the keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 256
#: Slice of nulls: the first going up, the last going down, as Spark sorts them.
NULLS = -1


def _doubles(xs: list[float]) -> Column:
    """One literal array, made by one call."""
    return F.expr(f"array({', '.join(f"double('{x!r}')" for x in map(float, xs))})").cast("array<double>")


def cuts(df: DataFrame, value: str, parts: int = SLICES) -> list[float]:
    """At most parts - 1 numbers. Where they lie decides balance alone, never a result."""
    found = df.agg(F.percentile_approx(F.col(value).cast("double"), _doubles([i / parts for i in range(1, parts)]), 10_000).alias("e")).first().e
    return sorted(set(found or []))


def slice_of(value: Column, edges: list[float]) -> Column:
    """How many edges lie below the value."""
    below = F.size(F.filter(_doubles(edges), lambda e: e < value.cast("double")))
    return F.when(value.isNull(), NULLS).otherwise(below)


def running(df: DataFrame, value: str, *sums: str, by: tuple[str, ...] = (), down: bool = False, parts: int = SLICES) -> DataFrame:
    """For a table with a row per (by, value): of each summed column, ``upto_`` adds the rows up to and with this one in the order
    of the value, ``all_`` every row of the key. Null keys are a key; a null value is least.

    One small job finds the edges. Each key has at most ``parts`` + 1 rows of sums by slice, which one window puts in order.
    """
    order = F.desc if down else F.asc
    sliced = df.withColumn("slice_", slice_of(F.col(value), cuts(df, value, parts)))
    per = sliced.groupBy(*by, "slice_").agg(*[F.sum(s).alias(s) for s in sums])
    earlier = Window.partitionBy(*by).orderBy(order("slice_")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    lead = per.select(
        *[F.col(b).alias(f"key_{b}") for b in by], F.col("slice_").alias("key_slice_"),
        *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"lead_{s}") for s in sums], *[F.sum(s).over(whole).alias(f"all_{s}") for s in sums],
    )
    inside = Window.partitionBy(*by, "slice_").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0)
    placed = sliced.select("*", *[F.sum(s).over(inside).alias(f"in_{s}") for s in sums])
    same = [F.col("slice_") == F.col("key_slice_")] + [F.col(b).eqNullSafe(F.col(f"key_{b}")) for b in by]
    both = placed.join(lead if by else F.broadcast(lead), reduce(lambda a, b: a & b, same))  # without keys, a row per slice
    return both.select(*df.columns, *[(F.col(f"lead_{s}") + F.col(f"in_{s}")).alias(f"upto_{s}") for s in sums], *[f"all_{s}" for s in sums])


def percentiles(df: DataFrame, qs: list[float] | tuple[float, ...], *by: str, value: str = "value") -> DataFrame:
    """by..., q: exact percentiles, interpolated between the two order statistics around each. Nulls are left out, and so is a key
    that has nothing else. Rows are counted by value first; no task sees all values of a key."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    placed = running(counts, value, "n", by=by)
    v = F.col(value).cast("double")

    def position(q: float) -> Column:
        return F.lit(float(q)) * (F.col("all_n") - 1)

    def holder(k: Column) -> Column:
        return F.max(F.when((F.col("upto_n") - F.col("n") <= k) & (k < F.col("upto_n")), v))

    ends = [e for i, q in enumerate(qs) for e in (holder(F.floor(position(q))).alias(f"lo{i}"), holder(F.ceil(position(q))).alias(f"hi{i}"))]
    found = placed.groupBy(*by).agg(F.max("all_n").alias("all_n"), *ends).filter("all_n is not null")

    def between(i: int, q: float) -> Column:
        low, high, at = F.col(f"lo{i}"), F.col(f"hi{i}"), position(q)
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return found.select(*by, F.array(*[between(i, q) for i, q in enumerate(qs)]).alias("q"))
