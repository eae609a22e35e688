"""Late rows and late labels: rows the store refused, and rows joined to labels that mature after them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accepted(out: DataFrame) -> DataFrame:
    """What the store took, without the marker."""
    return out.filter(~F.col("late")).drop("late")


def refused(out: DataFrame) -> DataFrame:
    """id and key of rows that came after a later instant of their key."""
    return out.filter("late").select("id", "key")


def matured(rows: DataFrame, labels: DataFrame, maturity: str, late: str = "1 hour", key: str = "id", time: str = "event_time", label_time: str = "label_time") -> DataFrame:
    """Inner join of two streams on the key: what a row's label is once ``maturity`` has passed, that is, every label that comes
    from the row's own time up to then. Both bounds let the state of either side be dropped as the watermarks move; what comes
    later is in ``after_maturity``."""
    a = rows.withWatermark(time, late).alias("a")
    b = labels.withWatermark(label_time, late).alias("b")
    at, then = F.col(f"a.{time}"), F.col(f"b.{label_time}")
    kept = [F.col(f"a.{c}") for c in rows.columns] + [F.col(f"b.{c}") for c in labels.columns if c != key]
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (then >= at) & (then <= at + F.expr(f"interval {maturity}"))).select(*kept)


def after_maturity(rows: DataFrame, labels: DataFrame, maturity: str, key: str = "id", time: str = "event_time", label_time: str = "label_time") -> DataFrame:
    """The labels, of tables, that come too late for ``matured`` or before their row, with the columns of their rows."""
    joined = rows.join(labels, key)
    return joined.filter((F.col(label_time) < F.col(time)) | (F.col(label_time) > F.col(time) + F.expr(f"interval {maturity}")))
