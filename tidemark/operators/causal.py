"""Causal features: a row at t reads only rows strictly before t, ties at t left out.

Both frames end at -1 of an integer clock, so a row and its peers are never in them. Expressions over one grain share one
exchange; a finer partition of the same grain (grain, value) reuses it.

A trailing window of a hot key can be cut: ``velocity_by_chunks`` deals each key's rows into chunks of time and gives every
chunk the rows of the one before, so a window no longer than a chunk finds all it needs and no key is bound to one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000.0
MINUTE = 60_000_000
WINDOWS = {"10m": 10 * MINUTE, "1h": 60 * MINUTE, "24h": 24 * 60 * MINUTE}
CONTENT = ("entity", "product", "addr1", "device", "rounded")


def prior(*by: str):
    return Window.partitionBy(*by).orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)


def trail(w: int, *by: str):
    return Window.partitionBy(*by).orderBy("ts").rangeBetween(-w, -1)


@dataclass(frozen=True)
class Feature:
    name: str
    family: str
    grain: str
    window: str
    null_means: str


def velocity(grain: str, windows: dict[str, int] = WINDOWS) -> dict[str, Column]:
    out = {}
    for name, w in windows.items():
        over = trail(w, grain)
        out[f"vel_count_{name}_{grain}"] = F.count("*").over(over)
        out[f"vel_amount_sum_{name}_{grain}"] = F.coalesce(F.sum("amount").over(over), F.lit(0.0))
        out[f"vel_amount_mean_{name}_{grain}"] = F.avg("amount").over(over)
    return out


def velocity_by_chunks(df: DataFrame, grain: str, window: int, chunk: int | None = None) -> DataFrame:
    """id, n, total of the trailing window, with every key spread over chunks of time."""
    size = max(chunk or window, window)
    own = df.select("id", "ts", F.col(grain).alias("key"), "amount", F.expr(f"ts div {size}").alias("chunk"))
    late = own.filter(F.col("ts") >= (F.col("chunk") + 1) * size - window)
    both = own.withColumn("own", F.lit(True)).unionByName(late.withColumn("chunk", F.col("chunk") + 1).withColumn("own", F.lit(False)))
    over = Window.partitionBy("key", "chunk").orderBy("ts").rangeBetween(-window, -1)
    out = both.withColumn("n", F.count("*").over(over)).withColumn("total", F.coalesce(F.sum("amount").over(over), F.lit(0.0)))
    return out.filter("own").select("id", "n", "total")


def recency(grain: str = "entity") -> dict[str, Column]:
    """Microseconds since the last row; mean gap and the deviation from it in seconds."""
    w = prior(grain)
    n, first, last = F.count("*").over(w), F.min("ts").over(w), F.max("ts").over(w)
    gap = F.when(n >= 2, (last - first) / (n - 1) / SECOND)
    return {"rec_since_prev": F.col("ts") - last, "rec_prior_count": n, "rec_mean_gap": gap, "rec_gap_deviation": (F.col("ts") - last) / SECOND - gap}


def amount(grain: str = "entity") -> dict[str, Column]:
    w = prior(grain)
    mean, std = F.avg("amount").over(w), F.stddev_samp("amount").over(w)
    window = WINDOWS["24h"]
    again = F.max("ts").over(trail(window, grain, "amount")).isNotNull()
    off = F.col("amount") - mean
    return {
        "amt_mean": mean,
        "amt_std": std,
        "amt_deviation": off,
        "amt_zscore": F.when(std > 0, off / std),
        "amt_repeat_24h": F.when(F.count("*").over(trail(window, grain)) > 0, again.cast("int")),
    }


def mode_differs(value: str, grain: str = "card") -> Column:
    """Is the value another than the running mode? Equal counts: the smaller value. Null without a value or a mode."""
    return (F.col(value) != F.mode(value, True).over(prior(grain))).cast("int")


def with_first_marks(df: DataFrame, grain: str, *values: str) -> DataFrame:
    """Marks the first row of each (grain, value), for running distinct counts."""
    return df.withColumns({f"first_{v}": (F.col(v).isNotNull() & (F.row_number().over(Window.partitionBy(grain, v).orderBy("ts", "id")) == 1)).cast("int") for v in values})


def running_distinct(value: str, grain: str) -> Column:
    return F.coalesce(F.sum(f"first_{value}").over(prior(grain)), F.lit(0))


def novel(value: str, grain: str, seen: Column) -> Column:
    """1 if no earlier row of the grain has the value; null without a value or any earlier one."""
    return F.when(F.col(value).isNotNull() & (seen > 0), (F.min("ts").over(Window.partitionBy(grain, value)) >= F.col("ts")).cast("int"))


def duplicates(content: tuple[str, ...] = CONTENT) -> dict[str, Column]:
    """Earlier rows with the same content; nulls are a level of their own."""
    w = prior(*content)
    return {"dup_prior_count": F.count("*").over(w), "dup_since_prev": F.col("ts") - F.max("ts").over(w), "dup_prior_count_1h": F.count("*").over(trail(WINDOWS["1h"], *content))}


def degree(value: str) -> Column:
    return F.when(F.col(value).isNotNull(), F.count("*").over(prior(value)))


FAMILIES = ("velocity", "recency", "geography", "device", "amount", "duplicate", "degree")


def build(df: DataFrame, edges: list[float] | None = None, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """The stream with all features of the families; ``geography`` needs the fitted ``edges`` of dist."""
    if bad := [f for f in families if f not in FAMILIES]:
        raise ValueError(f"unknown families: {bad}")
    if "geography" in families and edges is None:
        raise ValueError("geography needs fitted edges")
    out: dict[str, Column] = {}
    rows = df.withColumn("rounded", F.rint("amount"))
    if "device" in families:
        rows = with_first_marks(rows.withColumn("combination", F.when(F.coalesce("device", F.col("browser").cast("string")).isNotNull(), F.concat_ws("|", F.coalesce("device", F.lit("\0")), F.coalesce(F.col("browser").cast("string"), F.lit("\0"))))), "entity", "combination")
        seen = running_distinct("combination", "entity")
        out |= {"dev_n_distinct": seen, "dev_is_new": novel("combination", "entity", seen)}
    if "geography" in families:
        from tidemark.functions.scalar import left_closed

        rows = with_first_marks(rows, "card", "addr1")
        out |= {"geo_addr1_differs": mode_differs("addr1"), "geo_addr2_differs": mode_differs("addr2"), "geo_n_addr1": running_distinct("addr1", "card")}
        out["geo_dist_bucket"] = left_closed(F.col("dist"), F.array(*[F.lit(float(e)) for e in edges]))
    if "velocity" in families:
        out |= velocity("entity") | velocity("card")
    if "recency" in families:
        out |= recency()
    if "amount" in families:
        out |= amount()
    if "duplicate" in families:
        out |= duplicates()
    if "degree" in families:
        rows = with_first_marks(rows.withColumnRenamed("first_entity", "_") if "first_entity" in rows.columns else rows, "device", "entity")
        out |= {"degree_card": F.count("*").over(prior("card")), "degree_addr1": degree("addr1"), "degree_device": degree("device")}
        out["entities_on_device"] = F.when(F.col("device").isNotNull(), running_distinct("entity", "device"))
    return rows.withColumns(out).drop("rounded", *[c for c in rows.columns if c.startswith("first_") or c == "combination"])


def catalogue() -> list[Feature]:
    """What each feature is and what its null means."""
    none = "nothing before it"
    rows = [Feature(f"vel_{k}_{w}_{g}", "velocity", g, w, "never" if k != "amount_mean" else "no row in the window") for g in ("entity", "card") for w in WINDOWS for k in ("count", "amount_sum", "amount_mean")]
    rows += [Feature("rec_prior_count", "recency", "entity", "all", "never"), *[Feature(f"rec_{x}", "recency", "entity", "all", none) for x in ("since_prev", "mean_gap", "gap_deviation")]]
    rows += [Feature(f"amt_{x}", "amount", "entity", "all", none) for x in ("mean", "std", "deviation", "zscore", "repeat_24h")]
    rows += [Feature("dev_n_distinct", "device", "entity", "all", "never"), Feature("dev_is_new", "device", "entity", "all", "no device now or before")]
    rows += [Feature(f"geo_{x}", "geography", "card", "all", "no address now or before") for x in ("addr1_differs", "addr2_differs", "dist_bucket")] + [Feature("geo_n_addr1", "geography", "card", "all", "never")]
    rows += [Feature("dup_prior_count", "duplicate", "content", "all", "never"), Feature("dup_since_prev", "duplicate", "content", "all", none), Feature("dup_prior_count_1h", "duplicate", "content", "1h", "never")]
    rows += [Feature(x, "degree", "value", "all", "no value") for x in ("degree_addr1", "degree_device", "entities_on_device")] + [Feature("degree_card", "degree", "card", "all", "never")]
    return rows
