"""Fixture tables and the streams they stand for.

A stream has id, ts (microseconds, BIGINT), entity, card, amount, product, device parts, addresses, a distance, a day count
and a label. ``hourly`` cuts the clock to hours, which makes many ties. Nulls are made with ``nullif``: the tables hold none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000_000
DAY = 24 * HOUR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str):
    """Microseconds of a timestamp with or without zone (session zone: UTC)."""
    return F.unix_micros(F.col(c).cast("timestamp"))


def events_stream(spark: SparkSession, sf_dir: str, hourly: bool = False) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    ts = micros("ts")
    if hourly:
        ts = F.expr(f"unix_micros(cast(ts as timestamp)) div {HOUR} * {HOUR}")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        ts.alias("ts"),
        F.col("user_id").alias("entity"),
        (F.col("user_id") % 25).alias("card"),
        F.col("value").alias("amount"),
        F.col("event_type").alias("product"),
        F.nullif("event_type", F.lit("error")).alias("device"),
        F.nullif(k % 5, F.lit(0)).alias("browser"),
        F.nullif(F.col("user_id") % 7, F.lit(0)).alias("addr1"),
        F.nullif(k % 3, F.lit(0)).alias("addr2"),
        F.nullif(k % 6, F.lit(0)).cast("double").alias("dist"),
        F.nullif(k % 20, F.lit(7)).alias("tenure"),
        (k % 25 == 0).cast("int").alias("label"),
    )


#: The same stream for the SQL oracles; {ts} is the clock.
STREAM = """s AS (SELECT event_id AS id, {ts} AS ts, user_id AS entity, user_id % 25 AS card, value AS amount, event_type AS product,
 nullif(event_type, 'error') AS device, nullif(k % 5, 0) AS browser, nullif(user_id % 7, 0) AS addr1, nullif(k % 3, 0) AS addr2,
 CAST(nullif(k % 6, 0) AS DOUBLE) AS dist, nullif(k % 20, 7) AS tenure, CAST(k % 25 = 0 AS INTEGER) AS label
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""
EVENTS = STREAM.format(ts="epoch_us(ts)")
HOURLY = STREAM.format(ts=f"epoch_us(ts) // {HOUR} * {HOUR}")


def lineitem_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.expr(f"unix_micros(cast(l_shipdate as timestamp)) div {DAY}").alias("day"),
        F.col("l_suppkey").alias("entity"),
        F.col("l_extendedprice").alias("amount"),
        F.concat("l_returnflag", "l_linestatus").alias("device"),
        F.col("l_linenumber").alias("addr1"),
        (F.col("l_discount") > 0.09).cast("int").alias("label"),
    )


LINES = f"""s AS (SELECT l_orderkey * 10 + l_linenumber AS id, epoch_us(l_shipdate) // {DAY} AS day, l_suppkey AS entity, l_extendedprice AS amount,
 l_returnflag || l_linestatus AS device, l_linenumber AS addr1, CAST(l_discount > 0.09 AS INTEGER) AS label FROM lineitem)"""


def orders_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.expr(f"unix_micros(cast(o_orderdate as timestamp)) div {DAY}").alias("day"),
        F.col("o_custkey").alias("entity"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("segment"),
        F.col("o_orderstatus").alias("status"),
        (F.col("o_orderkey") % 16 == 0).cast("int").alias("label"),
    )


ORDERS = f"""s AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) // {DAY} AS day, o_custkey AS entity, o_totalprice AS amount,
 o_orderpriority AS segment, o_orderstatus AS status, CAST(o_orderkey % 16 = 0 AS INTEGER) AS label FROM orders)"""


def documents_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.join(table(spark, sf_dir, "labels"), "doc_id", "left")


DOCS = "s AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
