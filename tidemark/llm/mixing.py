"""Mixing sources to target weights by Poisson replication.

A source that should hold the share p of T bytes and has b bytes repeats each document p * T / b times on average. The
count of one document is the inverse of the Poisson distribution at a uniform number hashed from seed and doc_id, so it
needs no state and is the same on every run. Copies are dealt out by a second hash into a global random order.

Defined cases: a null source is a source; a null or empty text has 1 byte; very long texts are one row like any other; rows with
the same doc_id draw the same count and are tied in the order; null ids draw as one id; a weight of zero, or a source without a
weight, drops the source; an empty table gives no rows; other columns pass through unread, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, stage

SEED = 20
#: Bytes up to which the table of distributions is broadcast; beyond, the join is shuffled with salted sources.
BROADCAST_BYTES, SALTS = 32 << 20, 64
#: Copies that are made of a row at once.
CHUNK = 1 << 16
KEY_BITS = 60


def _digits(*parts, n: int) -> Column:
    """The first n hex digits of an MD5 as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, n), 16, 10).cast("long")


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def uniform(seed: int, doc_id: Column) -> Column:
    """In [0, 1), 52 bits."""
    return _digits(F.lit(f"{seed}u"), _id(doc_id), n=13) / F.lit(float(1 << 52))


def shuffle_key(seed: int, doc_id: Column, copy: Column) -> Column:
    return _digits(F.lit(f"{seed}s"), _id(doc_id), copy.cast("string"), n=KEY_BITS // 4)


def source_rates(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """source, rate: the mean repetitions. ``weights`` has (source, weight); by default a weight is the root of the source's bytes."""
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("bytes"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.sqrt(F.col("bytes").cast("double")))
    else:
        own = weights.select(F.col("source").alias("s"), F.col("weight").cast("double").alias("weight"))
        sizes = sizes.join(own, F.col("s").eqNullSafe(F.col("source")), "left").select("source", "bytes", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    total = sizes.agg(F.sum("weight").alias("all_weight"), F.sum("bytes").alias("all_bytes"))
    rate = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * F.col("all_bytes") / F.col("bytes")).otherwise(F.lit(0.0))
    return sizes.crossJoin(F.broadcast(total)).select("source", rate.alias("rate"))  # one row: the totals


def _reach(rate: Column) -> tuple[Column, Column]:
    """The numbers of copies between which all but a 1e-30th of the distribution lies."""
    far = 12 * F.sqrt(rate) + 40
    return F.greatest(F.lit(0), F.floor(rate - far)).cast("long"), F.ceil(rate + far).cast("long")


def _log_factorial(n: Column) -> Column:
    """By Stirling's series, for the far beginnings of high rates (n from 40 on, to 1e-13)."""
    x = n.cast("double")
    return F.when(n > 0, x * F.ln(x) - x + F.ln(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)).otherwise(F.lit(0.0))


def distributions(rates: DataFrame) -> DataFrame:
    """source, least, steps: the cumulative Poisson probabilities of least, least + 1, ... copies, up to where the rest is below
    double precision; as many as 24 roots of the rate and 80."""
    first, last = _reach(F.col("rate"))
    by = Window.partitionBy("source").orderBy("k")
    some = F.when(F.col("rate") > 0, last).otherwise(F.lit(0).cast("long"))
    steps = rates.select("source", "rate", first.alias("least"), F.explode(F.sequence(first, F.greatest(first, some))).alias("k"))
    grown = F.sum(F.when(F.col("k") > F.col("least"), F.ln("k")).otherwise(F.lit(0.0))).over(by)
    steps = steps.withColumn("log_factorial", grown + _log_factorial(F.col("least")))
    p = F.when(F.col("rate") > 0, F.exp(F.col("k") * F.ln("rate") - F.col("rate") - F.col("log_factorial"))).otherwise(F.lit(1.0))
    steps = steps.withColumn("p", p).withColumn("cdf", F.sum("p").over(by))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("k", "cdf"))), lambda x: x.cdf)
    return steps.groupBy("source").agg(F.min("least").alias("least"), in_order.alias("steps"))


def mix(docs: DataFrame, weights: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """Struct ``row`` of each copy, with copy (from 1), n_copies and shuffle_key, in the order of shuffle_key over all partitions."""
    rates = stage(source_rates(docs, weights), "rates")
    first, last = _reach(F.col("rate"))
    size = rates.agg(F.coalesce(F.sum(8 * (last - first) + 100 + F.coalesce(F.octet_length("source"), F.lit(0))), F.lit(0))).first()[0]
    table = distributions(rates).select(F.col("source").alias("s"), "least", "steps")
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("source"))
    same = F.col("s").eqNullSafe(F.col("source"))
    if size <= BROADCAST_BYTES:
        joined = packed.join(F.broadcast(table), same)
    else:
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = packed.withColumn("dealt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("dealt") == F.col("salt")))
    u = uniform(seed, F.col("doc_id"))
    counted = joined.withColumn("u", u).withColumn("n_copies", F.col("least") + F.size(F.filter("steps", lambda c: c <= F.col("u"))))
    chunks = counted.filter("n_copies > 0").select("row", "doc_id", "n_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"), F.lit(CHUNK).cast("long"))).alias("from"))
    copies = chunks.select("row", "doc_id", "n_copies", F.explode(F.sequence("from", F.least(F.col("n_copies"), F.col("from") + (CHUNK - 1)))).alias("copy"))
    keyed = copies.withColumn("shuffle_key", shuffle_key(seed, F.col("doc_id"), F.col("copy")))
    n = partitions_for(docs)
    span = (1 << KEY_BITS) // n + 1
    return keyed.repartitionById(n, F.expr(f"cast(shuffle_key div {span} as int)")).sortWithinPartitions("shuffle_key", "doc_id", "copy")


def op2_digest(docs: DataFrame) -> DataFrame:
    return mix(docs).select(
        "doc_id",
        F.col("row.source").alias("source"),
        F.col("copy").cast("long").alias("copy"),
        F.col("n_copies").cast("long").alias("n_copies"),
        "shuffle_key",
        F.sha2(F.coalesce(F.col("row.text"), F.lit("")), 256).alias("text_sha256"),
    )


ORACLE = f"""
WITH z AS (SELECT source, CAST(sum(coalesce(strlen(text), 0) + 1) AS BIGINT) AS bytes FROM documents GROUP BY source),
r AS (SELECT source, sqrt(CAST(bytes AS DOUBLE)) / sum(sqrt(CAST(bytes AS DOUBLE))) OVER () * sum(bytes) OVER () / bytes AS rate FROM z),
k AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT) + 1)) AS k FROM r),
f AS (SELECT source, k, exp(k * ln(rate) - rate - sum(CASE WHEN k > 0 THEN ln(k) ELSE 0 END) OVER (PARTITION BY source ORDER BY k)) AS p FROM k),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM f),
u AS (SELECT *, CAST('0x' || substr(md5('{SEED}u:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT u.doc_id, u.source, u.text, count(*) AS n FROM u JOIN c ON c.source = u.source AND c.cdf <= u.u GROUP BY ALL)
SELECT doc_id, source, copy, CAST(n AS BIGINT) AS n_copies, CAST('0x' || substr(md5('{SEED}s:' || doc_id || ':' || copy), 1, 15) AS BIGINT) AS shuffle_key, sha256(coalesce(text, '')) AS text_sha256
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM n)
"""
