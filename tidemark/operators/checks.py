"""Checks of keys, columns and values: purity of entities, coverage by history, impossible values, agreement, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar


def entity_stats(df: DataFrame, entity: str, *parts: str, label: str = "label") -> DataFrame:
    """Entities, rows of each, how many are single, pure by label or mixed, and rows with a null among the key's parts."""
    gone = df.agg(F.count_if(F.greatest(*[F.col(p).isNull() for p in parts], F.lit(False))).alias("null_part_rows"))
    g = df.groupBy(entity).agg(F.count("*").alias("n"), F.sum(label).alias("k"))
    out = g.agg(
        F.count("*").alias("entities"), F.avg("n").alias("mean_rows"), F.max("n").alias("most_rows"), F.count_if(F.col("n") == 1).alias("single"),
        F.count_if((F.col("n") > 1) & (F.col("k") == 0)).alias("pure_negative"), F.count_if((F.col("n") > 1) & (F.col("k") == F.col("n"))).alias("pure_positive"), F.count_if((F.col("k") > 0) & (F.col("k") < F.col("n"))).alias("mixed"),
    )
    return out.crossJoin(F.broadcast(gone))  # one row


def skew_summary(profiles: DataFrame, skew: str = "skew") -> DataFrame:
    """How the skew of columns is distributed, from a table with a row per column."""
    s = F.abs(F.col(skew))
    out = profiles.filter(F.col(skew).isNotNull()).agg(F.count("*").alias("columns"), F.count_if(s > 1).alias("beyond_1"), F.count_if(s > 3).alias("beyond_3"), F.count_if(s > 10).alias("beyond_10"), F.percentile(s, F.lit(0.5)).alias("median"), F.max(s).alias("most"))
    return out


def coverage(df: DataFrame, grains: list[str], split: str = "split", time: str = "ts", label: str = "label") -> DataFrame:
    """split, grain, n, n_cold, k_cold, k_warm, share_cold, rates with Wilson bounds. A row is cold for a grain when no row of
    its key is strictly earlier; a null key is cold. First instants come from one aggregate per key, not from sorted windows."""
    parts = []
    for g in grains:
        first = df.filter(F.col(g).isNotNull()).groupBy(F.col(g).alias("key_")).agg(F.min(time).alias("first_"))
        cold = F.coalesce(F.col("first_") >= F.col(time), F.lit(True))
        rows = df.join(first, F.col(g) == F.col("key_"), "left").withColumn("cold", cold)
        parts.append(rows.groupBy(split).agg(F.lit(g).alias("grain"), F.count("*").alias("n"), F.count_if("cold").alias("n_cold"), F.sum(F.when(F.col("cold"), F.col(label)).otherwise(0)).alias("k_cold"), F.sum(F.when(F.col("cold"), 0).otherwise(F.col(label))).alias("k_warm")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    low, high = scalar.wilson(F.col("k_cold"), F.col("n_cold"))
    rate_cold, rate_warm = F.try_divide(F.col("k_cold").cast("double"), F.col("n_cold")), F.try_divide(F.col("k_warm").cast("double"), F.col("n") - F.col("n_cold"))
    return out.select("*", (F.col("n_cold") / F.col("n")).alias("share_cold"), rate_cold.alias("rate_cold"), rate_warm.alias("rate_warm"), F.when(F.col("n_cold") > 0, low).alias("low_cold"), F.when(F.col("n_cold") > 0, high).alias("high_cold"))


def impossible(df: DataFrame, rules: dict[str, Column], label: str = "label") -> DataFrame:
    """rule, n, share, k: rows that break each rule, in one aggregate; a rule that is null isn't broken."""
    made = [F.struct(F.lit(name).alias("rule"), F.count_if(c).alias("n"), F.coalesce(F.sum(F.when(c, F.col(label))), F.lit(0)).alias("k"), F.count("*").alias("rows")).alias(f"r{i}") for i, (name, c) in enumerate(rules.items())]
    out = df.agg(*made).select(F.explode(F.array(*[F.col(f"r{i}") for i in range(len(made))])).alias("x")).select("x.*")
    return out.select("rule", "n", "k", F.try_divide(F.col("n").cast("double"), F.col("rows")).alias("share"))


def agreement(df: DataFrame, a: str, b: str, label: str = "label") -> DataFrame:
    """state (same, differs, one_missing, both_missing), n, k, rate of two columns that should say the same."""
    x, y = F.col(a).cast("string"), F.col(b).cast("string")
    state = F.when(x.isNull() & y.isNull(), "both_missing").when(x.isNull() | y.isNull(), "one_missing").when(x == y, "same").otherwise("differs")
    return df.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.sum(label).alias("k")).withColumn("rate", F.col("k") / F.col("n"))


def concentration(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """levels, n, single, top_share: how much of a free-text column its commonest levels hold."""
    g = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("c"))
    best = g.orderBy(F.desc("c"), column).limit(top).agg(F.sum("c").alias("best"))
    out = g.agg(F.count("*").alias("levels"), F.sum("c").alias("n"), F.count_if(F.col("c") == 1).alias("single"))
    return out.crossJoin(F.broadcast(best)).select("levels", "n", "single", F.try_divide(F.col("best").cast("double"), F.col("n")).alias("top_share"))
