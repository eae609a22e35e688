"""The preparation as one recipe of fitted parts, and the two matrices that models read.

Fits see training rows only (``boundary``). The lagged target encoding reads train labels at apply time, so the frame that is
prepared holds the training rows beside those to be scored; labels at or after the boundary are never read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import encode, profile
from tidemark.operators.guards import train_only

TICKS = 1_000_000


@dataclass(frozen=True)
class Recipe:
    """The decisions that no fit makes. ``texts`` maps a column to its normaliser, ``indicators`` the name of a missingness
    block to one of its columns, ``blocks`` the name of a reduced block to its columns."""

    drop: tuple[str, ...] = ()
    amount: str = "amount"
    origins: tuple[str, ...] = ()
    texts: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    indicators: dict[str, str] = field(default_factory=dict)
    levels: tuple[str, ...] = ()
    tail: float = 0.01
    counts: tuple[str, ...] = ()
    least_levels: int = 50
    targets: tuple[str, ...] = ()
    lag: int = 1
    smoothing: float = 20.0
    blocks: dict[str, list[str]] = field(default_factory=dict)
    clipped: tuple[str, ...] = ()
    clip_tail: float = 0.001


@dataclass(frozen=True)
class Fitted:
    recipe: Recipe
    boundary: int
    vocabulary: DataFrame | None
    frequency: DataFrame | None
    blocks: dict[str, dict[str, tuple[float, float]]]
    clip: dict[str, tuple[float, float]]


def stateless(df: DataFrame, r: Recipe, time: str = "ts") -> DataFrame:
    """The steps that learn nothing: dropped columns, clocks, amounts, origins, texts, indicators."""
    s = F.col(time) / TICKS
    made = {"day": scalar.day_index(s), "hour": scalar.hour_position(s), "dow": scalar.dow_position(s)}
    a = F.col(r.amount)
    made |= {f"{r.amount}_log": F.log1p(a), f"{r.amount}_cents": scalar.cents(a), f"{r.amount}_is_round": (scalar.cents(a) == 0).cast("tinyint")}
    made |= {f"{c}_origin": scalar.origin(s, F.col(c)) for c in r.origins}
    made |= {f"{c}_norm": f(F.col(c)) for c, f in r.texts.items()}
    made |= {f"missing_block_{name}": F.col(c).isNull().cast("tinyint") for name, c in r.indicators.items()}
    return df.drop(*r.drop).withColumns(made).drop(*r.origins)


def fit_preparation(train: DataFrame, recipe: Recipe, boundary: int, time: str = "ts") -> Fitted:
    at = {"boundary": boundary, "time": time}
    staged = stateless(train, recipe, time)
    return Fitted(
        recipe,
        boundary,
        encode.fit_vocabulary(staged, list(recipe.levels), recipe.tail, **at) if recipe.levels else None,
        encode.fit_frequency(staged, list(recipe.counts), recipe.least_levels, **at) if recipe.counts else None,
        {name: encode.fit_block_mean(staged, columns, **at) for name, columns in recipe.blocks.items()},
        encode.fit_clip(staged, list(recipe.clipped), recipe.clip_tail, **at) if recipe.clipped else {},
    )


def apply_preparation(df: DataFrame, fitted: Fitted, time: str = "ts", label: str = "label") -> DataFrame:
    """All steps in order; columns come out sorted by name."""
    r = fitted.recipe
    out = stateless(df, r, time)
    out = encode.apply_vocabulary(out, fitted.vocabulary, list(r.levels))
    out = encode.apply_frequency(out, fitted.frequency, list(r.counts))
    for c in r.targets:
        out = encode.target_encode(out, c, F.col(time) < fitted.boundary, r.lag, r.smoothing, label)
    for name, block in fitted.blocks.items():
        out = encode.apply_block_mean(out, block, f"blockmean_{name}")
    out = encode.apply_clip(out.drop(*[c for columns in r.blocks.values() for c in columns]), fitted.clip)
    return out.select(*sorted(out.columns))


@train_only
def fit_levels(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, level, code: codes from 0 in the order of the levels."""
    found = profile.long(df, columns, kind="string").filter("value is not null").select("column", F.col("value").alias("level")).distinct()
    return found.withColumn("code", F.row_number().over(Window.partitionBy("column").orderBy("level")) - 1)


def tree_matrix(df: DataFrame, numeric: list[str], levels: list[str], fitted: DataFrame, row: str = "id", sentinel: float | None = None) -> DataFrame:
    """Floats with their nulls and level codes; an unseen or missing level has no code. ``sentinel`` fills nulls for models
    that refuse them and adds <column>_missing."""
    for c in levels:
        codes = fitted.filter(F.col("column") == c).select(F.col("level").alias("l_"), F.col("code").cast("double").alias("c_"))
        df = df.join(codes, F.col(c).cast("string") == F.col("l_"), "left").withColumn(c, F.col("c_")).drop("l_", "c_")
    out = df.select(row, *[F.col(c).cast("double").alias(c) for c in [*numeric, *levels]])
    if sentinel is None:
        return out
    return out.select(row, *[F.coalesce(c, F.lit(sentinel)).alias(c) for c in out.columns if c != row], *[F.col(c).isNull().cast("tinyint").alias(f"{c}_missing") for c in out.columns if c != row])


@dataclass(frozen=True)
class Complete:
    imputer: dict[str, float]
    clip: dict[str, tuple[float, float]]
    scale: dict[str, tuple[float, float]]
    indicators: list[str]
    levels: dict[str, list[str]]


@train_only
def fit_complete(df: DataFrame, median: list[str], sentinel: list[str] = (), clipped: list[str] = (), levels: list[str] = (), tail: float = 0.001, time: str = "ts") -> Complete:
    """For models that take no nulls: impute, clip, standardise (a constant column becomes 0), one-hot. Columns with a null
    on train get an indicator. ``levels`` are columns of a fitted vocabulary, few levels each."""
    numeric, inside = [*median, *sentinel], {"boundary": 1 << 62, "time": time}
    imputer = encode.fit_imputer(df, list(median), list(sentinel), **inside)
    clip = encode.fit_clip(df, list(clipped), tail, **inside) if clipped else {}
    filled = encode.apply_clip(encode.apply_imputer(df, imputer), clip)
    m = filled.agg(*[F.struct(F.avg(c), F.stddev_pop(c)).alias(c) for c in numeric]).first()
    gone = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in numeric]).first()
    names = df.agg(*[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in levels]).first() if levels else {}
    return Complete(imputer, clip, {c: (m[c][0], m[c][1] or 1.0) for c in numeric}, [c for c in numeric if gone[c]], {c: list(names[c]) for c in levels})


def apply_complete(df: DataFrame, fitted: Complete, row: str = "id") -> DataFrame:
    """row, the standardised columns, <column>_missing, <column>=<level>; an unseen level is 0 throughout."""
    filled = encode.apply_clip(encode.apply_imputer(df.withColumns({f"{c}_missing": F.col(c).isNull().cast("tinyint") for c in fitted.indicators}), fitted.imputer), fitted.clip)
    hot = [F.coalesce((F.col(c).cast("string") == x).cast("tinyint"), F.lit(0)).alias(f"{c}={x}") for c, found in fitted.levels.items() for x in found]
    return filled.select(row, *[((F.col(c) - m) / s).alias(c) for c, (m, s) in fitted.scale.items()], *[f"{c}_missing" for c in fitted.indicators], *hot)


def origin_psi(reference: DataFrame, current: DataFrame, columns: list[str], time: str = "ts") -> DataFrame:
    """column, psi_count, psi_origin: what turning counts of days into the day they began does to a column's drift."""

    def origins(df: DataFrame) -> DataFrame:
        return df.select(*columns, *[scalar.origin(F.col(time) / TICKS, F.col(c)).cast("double").alias(f"{c}_origin") for c in columns])

    a, b = origins(reference), origins(current)
    p = profile.psi(a, b, profile.quantile_edges(a, a.columns))
    base, turned = F.regexp_replace("column", "_origin$", ""), F.col("column").endswith("_origin")
    return p.groupBy(base.alias("column")).agg(F.max(F.when(~turned, F.col("psi"))).alias("psi_count"), F.max(F.when(turned, F.col("psi"))).alias("psi_origin"))
