"""Reports put together from the other operators, and single-row composition: payloads, contributions, calibration by breakpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import evaluate, profile


class PayloadError(ValueError):
    """A payload has a field that isn't declared, or one that must not be there."""


def payload_rows(df: DataFrame, payload: str, schema: str, *keep: str) -> DataFrame:
    """Typed fields of a JSON payload (absent: null) and ``unknown``: its keys that the schema lacks."""
    fields = F.from_json(payload, schema)
    names = F.array(*[F.lit(x.strip().split()[0]) for x in schema.split(",")])
    return df.select(*keep, fields.alias("f"), F.array_except(F.json_object_keys(payload), names).alias("unknown")).select(*keep, "f.*", "unknown")


def refuse_unknown(rows: DataFrame) -> DataFrame:
    if not rows.filter(F.size("unknown") > 0).isEmpty():
        raise PayloadError("a payload has fields that aren't declared")
    return rows.drop("unknown")


def top_contributions(values: dict[str, Column], k: int) -> Column:
    """Names of the k largest by absolute value, ties by name."""
    items = F.array(*[F.struct((-F.abs(v)).alias("size"), F.lit(n).alias("name"), v.alias("value")) for n, v in values.items()])
    return F.transform(F.slice(F.array_sort(items), 1, k), lambda x: x["name"])


def interpolate(x: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear through the breakpoints, flat beyond them."""
    out = F.when(x <= points[0][0], F.lit(points[0][1]))
    for (a, p), (b, q) in zip(points, points[1:], strict=False):
        out = out.when(x <= b, F.lit(p) + (x - a) * ((q - p) / (b - a)))
    return F.when(x.isNotNull(), out.otherwise(F.lit(points[-1][1])))


def group_spread(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Distinct values and spread of a value in each group of two rows or more, summed up."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct(value).alias("d"), (F.max(value) - F.min(value)).alias("spread")).filter("n > 1")
    return g.agg(F.count("*").alias("groups"), F.count_if(F.col("d") == 1).alias("constant"), F.max("d").alias("most"), F.max("spread").alias("widest"))


def day_count_profile(df: DataFrame, days: str, ts: str, day: int) -> DataFrame:
    """Range, null, zero and negative shares of a day count; starts before the stream began."""
    c = F.col(days)
    start = F.floor(F.col(ts) / day - c)
    return df.agg(F.min(c).alias("least"), F.max(c).alias("most"), F.avg(c.isNull().cast("double")).alias("null_share"), F.avg((c == 0).cast("double")).alias("zero_share"), F.count_if(c < 0).alias("n_negative"), F.count_if(start < 0).alias("n_before"))


def token_report(df: DataFrame, column: str) -> DataFrame:
    """Rows by class of token of an applied vocabulary."""
    c = F.col(f"{column}_cat")
    kind = F.when(c.isin("(rare)", "(unseen)", "(missing)"), c).otherwise("(level)")
    return df.groupBy(kind.alias("token")).agg(F.count("*").alias("n"))


def entity_kinds(df: DataFrame, entity: str = "entity", label: str = "label") -> DataFrame:
    """Rows by the kind of their entity: single, all negative, all positive, mixed."""
    g = df.groupBy(entity).agg(F.count("*").alias("n"), F.sum(label).alias("k"))
    kind = F.when(F.col("n") == 1, "single").when(F.col("k") == 0, "negative").when(F.col("k") == F.col("n"), "positive").otherwise("mixed")
    return g.groupBy(kind.alias("kind")).agg(F.count("*").alias("entities"), F.sum("n").alias("rows"), F.sum("k").alias("k"))


def full_data_aggregates(df: DataFrame, entity: str = "entity") -> DataFrame:
    """Count, mean and largest amount of the entity over all its rows, later ones too: a leak, kept to be measured."""
    w = Window.partitionBy(entity)
    return df.withColumns({"full_count": F.count("*").over(w), "full_mean": F.avg("amount").over(w), "full_max": F.max("amount").over(w)})


def segment_report(df: DataFrame, segment: str, thresholds: dict[str, float] | float, score: str = "score", label: str = "label") -> DataFrame:
    """Rows, positives, AP, AUC and the confusion at one threshold, by segment."""
    at = evaluate.sweep(df, [thresholds], segment, score=score, label=label).drop("threshold")
    return at.join(evaluate.average_precision(df, segment, score=score, label=label), segment).join(evaluate.roc_auc(df, segment, score=score, label=label), segment)


def saturation(levels: DataFrame, gain: float = 1.10) -> DataFrame:
    """The first level whose throughput is below ``gain`` times the one before. levels: level, rate (a row per level)."""
    g = levels.withColumn("before", F.lag("rate").over(Window.orderBy("level")))
    return g.filter(F.col("rate") < gain * F.col("before")).agg(F.min("level").alias("level"))


def stability(reference: DataFrame, current: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """The columns that moved most by PSI."""
    return profile.psi(reference, current, profile.quantile_edges(reference, columns)).orderBy(F.desc("psi"), "column").limit(top)
