"""Typed CSV scan of a transaction file and its identity file, input census, and sinks."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID = "TransactionID"
#: Integer columns without nulls, and string columns.
INTEGER = {"TransactionID": T.LongType(), "TransactionDT": T.LongType(), "isFraud": T.ByteType(), "card1": T.IntegerType()}
STRINGS = {"ProductCD", "card4", "card6", "P_emaildomain", "R_emaildomain", "DeviceType", "DeviceInfo"}
STRING_PREFIXES = ("M",)
STRING_IDS = {"id_12", "id_15", "id_16", "id_23", "id_27", "id_28", "id_29", "id_30", "id_31", "id_33", "id_34", "id_35", "id_36", "id_37", "id_38"}


def column_type(name: str) -> T.DataType:
    """Four rules in order: integers, strings, the amount in double, float for the rest."""
    if name in INTEGER:
        return INTEGER[name]
    if name in STRINGS or name in STRING_IDS or (name.startswith(STRING_PREFIXES) and name[1:].isdigit()):
        return T.StringType()
    return T.DoubleType() if name == "TransactionAmt" else T.FloatType()


def header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.text(path).first()[0].split(",")


def schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, column_type(n)) for n in names])


def load(spark: SparkSession, transactions: str, identity: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Transactions left-joined with identity on the id. Unknown names in ``columns`` are ignored, the id is always read; the
    second file isn't read if none of its columns is wanted. A value that doesn't fit its column's type is an error."""

    def scan(path: str) -> DataFrame:
        names = header(spark, path)
        df = spark.read.schema(schema(names)).csv(path, header=True, mode="FAILFAST")
        return df if columns is None else df.select(*[n for n in names if n == ID or n in columns])

    left = scan(transactions)
    if identity is None:
        return left
    right = scan(identity)
    return left if right.columns == [ID] else left.join(right, ID, "left")


def census(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, n_null, least, most, n_whole, worst_float_error, n_distinct: one aggregate over all columns, then a row for each."""
    parts = []
    for c in columns:
        x = F.col(c).cast("double")
        parts.append(
            F.struct(
                F.lit(c).alias("column"), F.count("*").alias("n"), F.count_if(x.isNull()).alias("n_null"), F.min(x).alias("least"), F.max(x).alias("most"),
                F.count_if(x == F.floor(x)).alias("n_whole"), F.max(F.abs(x.cast("float").cast("double") - x)).alias("worst_float_error"), F.countDistinct(x).alias("n_distinct"),
            ).alias(c)
        )
    return df.agg(*parts).select(F.explode(F.array(*[F.col(f"`{c}`") for c in columns])).alias("x")).select("x.*")


def level_codes(df: DataFrame, column: str) -> DataFrame:
    """level, code: levels in sorted order from 0. A table of the levels, not of the rows."""
    from pyspark.sql import Window

    levels = df.select(F.col(column).alias("level")).filter("level is not null").distinct()
    return levels.select("level", (F.row_number().over(Window.orderBy("level")) - 1).cast("long").alias("code"))


def write_by_split(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def to_json(rows: list[dict], path: str) -> None:
    """A small result as JSON; NaN and infinities are refused."""
    for row in rows:
        for k, v in row.items():
            if isinstance(v, float) and not math.isfinite(v):
                raise ValueError(f"{k} is {v}")
    with open(path, "w") as f:
        json.dump(rows, f, allow_nan=False, default=str)
