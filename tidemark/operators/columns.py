"""Columns as data: adding and dropping them by plan, families and groups, canonical values, value-ordered codes, sessions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAMILIES = ((T.BooleanType, "flag"), (T.NumericType, "number"), (T.DatetimeType, "time"), (T.StringType, "text"))


def attach(df: DataFrame, made: Mapping[str, Column]) -> DataFrame:
    """Replace or append columns in one projection; names that differ only in case are refused."""
    if len({c.lower() for c in made}) < len(made):
        raise ValueError(f"names clash: {sorted(made)}")
    return df.withColumns(dict(made))


def apply_plan(df: DataFrame, plan: Mapping[str, str], spare: Iterable[str] = ()) -> DataFrame:
    """Drop the columns that the plan says to drop, but for those spared. A planned column that isn't there is an error."""
    if gone := set(plan) - set(df.columns):
        raise KeyError(f"the plan names columns that aren't there: {sorted(gone)}")
    return df.drop(*[c for c, action in plan.items() if action == "drop" and c not in set(spare)])


def sparse_plan(null_rates: DataFrame, most: float) -> dict[str, str]:
    """column -> drop or keep, from a table of (column, null_rate); one row a column."""
    return {r.column: "drop" if r.null_rate > most else "keep" for r in null_rates.select("column", "null_rate").collect()}


def group_of(name: str, groups: Mapping[str, tuple[str, ...]]) -> str | None:
    """The first group of which the column is a member or has a prefix (written with a star)."""
    for group, members in groups.items():
        if any(name.startswith(m[:-1]) if m.endswith("*") else name == m for m in members):
            return group
    return None


def select_groups(df: DataFrame, groups: Mapping[str, tuple[str, ...]], on: Iterable[str], keys: Iterable[str] = ()) -> DataFrame:
    """The keys and the columns of the groups that are switched on, in the table's order."""
    if unknown := set(on) - set(groups):
        raise KeyError(f"no such groups: {sorted(unknown)}")
    return df.select(*[c for c in df.columns if c in set(keys) or group_of(c, groups) in set(on)])


def permitted(columns: Iterable[str], known: Iterable[str], banned: Iterable[str] = ()) -> list[str]:
    """Columns that are known and not banned, sorted."""
    return sorted(set(columns) & set(known) - set(banned))


def families(df: DataFrame) -> DataFrame:
    """column, family of every column, from the schema alone."""
    kind = lambda t: next((name for k, name in FAMILIES if isinstance(t, k)), "other")
    return df.sparkSession.createDataFrame([(f.name, kind(f.dataType)) for f in df.schema], "column string, family string")


def canonical(value: Column, numeric: bool) -> Column:
    """One string for each distinct value, null for null and NaN; whole numbers and doubles of one value are alike."""
    x = F.nanvl(value.cast("double"), F.lit(None).cast("double")) if numeric else value
    return x.cast("string")


def amount_of(log: Column) -> Column:
    """The amount that a logarithm of one more came from."""
    return F.expm1(log)


def codes(df: DataFrame, columns: list[str], name: str, null_level: bool = True) -> DataFrame:
    """``df`` with a dense code from 0 for each distinct combination, in order of the values, nulls first.

    Codes are numbered inside each value of the first column and moved by the counts of the values before it, so only one row a
    value of that column meets in one task. Without ``null_level`` a row of which all parts are null has -1.
    """
    levels = df.select(*columns).distinct()
    if not null_level:
        levels = levels.filter(reduce(Column.__or__, [F.col(c).isNotNull() for c in columns]))
    head, order = columns[0], [F.asc_nulls_first(c) for c in columns]
    before = Window.orderBy(F.asc_nulls_first("head")).rowsBetween(Window.unboundedPreceding, -1)
    lead = levels.groupBy(F.col(head).alias("head")).agg(F.count("*").alias("n")).select("head", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lead"))
    numbered = levels.withColumn("inside", F.row_number().over(Window.partitionBy(head).orderBy(*order)))
    numbered = numbered.join(lead, F.col(head).eqNullSafe(F.col("head"))).select(*[F.col(c).alias(f"level_{c}") for c in columns], (F.col("lead") + F.col("inside") - 1).alias(name))
    same = [F.col(c).eqNullSafe(F.col(f"level_{c}")) for c in columns]
    out = df.join(numbered, same, "left").drop(*[f"level_{c}" for c in columns])
    return out.withColumn(name, F.coalesce(name, F.lit(-1)).cast("long"))


def sessions(df: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """key, start, n, of rows of a key that follow each other within the gap; ``time`` in microseconds."""
    window = F.session_window(F.timestamp_micros(F.col(time)), gap)
    return df.groupBy(key, window.alias("w")).agg(F.count("*").alias("n")).select(key, F.unix_micros("w.start").alias("start"), "n")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, with their repetitions, that one table has and the other doesn't; empty exactly if both are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def label_source(train: DataFrame, lag_days: int, day_length: int, key: str = "id", time: str = "ts", label: str = "label") -> DataFrame:
    """key, time, label and the time from which it may be read, of training rows; the lag has no default."""
    if lag_days < 0:
        raise ValueError(f"a lag of {lag_days} days reads the future")
    return train.select(key, time, label, (F.col(time) + lag_days * day_length).alias("readable_from"))
