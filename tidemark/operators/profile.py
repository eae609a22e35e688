"""Profiles: shapes, distributions, missingness, information value, stability, entities, duplicates.

Wide profiles turn columns into rows once (``long``) and aggregate by column, so the number of jobs doesn't grow with the
number of columns. Exact percentiles come from counts by value, cumulated over slices of the order (see ``ordered``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import right_closed, two_proportion_z, wilson
from tidemark.operators import ordered

MISSING = "(missing)"
SMOOTHING = 0.5
FLOOR = 1e-6
#: Row ids that one task puts in order.
CHUNK = 1_000_000
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def long(df: DataFrame, columns: list[str], *keep: str, kind: str = "double") -> DataFrame:
    """A row for each row and column: keep..., column, value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("x")).select(*keep, "x.column", "x.value")


def shape(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.sum(label).alias("positives"), F.avg(label).alias("rate")).withColumn("columns", F.lit(len(df.columns)))


def clock_profile(df: DataFrame, ts: str = "ts", row: str = "id") -> DataFrame:
    """Span, distinct instants, greatest common divisor of the gaps, monotone in row order.

    The divisor of the gaps between neighbours is that of the distances to the first instant, so no global order is needed
    for it. Row order is checked inside chunks of row ids and then from chunk to chunk.
    """
    first = df.agg(F.min(ts).alias("first"))
    far = df.crossJoin(F.broadcast(first)).select((F.col(ts) - F.col("first")).alias("d")).distinct()  # one row
    parts = far.groupBy(F.pmod(F.xxhash64("d"), F.lit(64)).alias("part")).agg(F.collect_set("d").alias("ds"))
    gcd = lambda a, b: F.reduce(F.sequence(F.lit(0), F.lit(90)), F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.when(s.b == 0, s).otherwise(F.struct(s.b.alias("a"), (s.a % F.nullif(s.b, F.lit(0))).alias("b"))), lambda s: s.a)
    fold = lambda xs: F.reduce(xs, F.lit(0).cast("bigint"), gcd)
    step = parts.agg(F.collect_list(fold(F.col("ds"))).alias("gs")).select(fold(F.col("gs")).alias("step"))
    rows = df.select(F.expr(f"{row} div {CHUNK}").alias("chunk"), F.col(row).alias("row"), F.col(ts).alias("ts"))
    inside = rows.withColumn("late", F.col("ts") < F.lag("ts").over(Window.partitionBy("chunk").orderBy("row")))
    ends = inside.groupBy("chunk").agg(F.count_if("late").alias("n"), F.min_by("ts", "row").alias("head"), F.max_by("ts", "row").alias("tail"))
    across = F.col("head") < F.lag("tail").over(Window.orderBy("chunk"))  # a row per chunk
    back = ends.select("n", across.alias("late")).agg(F.coalesce(F.sum(F.col("n") + F.coalesce("late", F.lit(False)).cast("int")), F.lit(0)).alias("n_back"))
    spans = df.agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.countDistinct(ts).alias("n_distinct"))
    return spans.crossJoin(F.broadcast(step)).crossJoin(F.broadcast(back)).withColumn("span", F.col("last") - F.col("first")).withColumn("monotone", F.col("n_back") == 0)


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts, moments (skew and excess kurtosis corrected for bias), percentiles and the top value's share, by column."""
    rows = long(df, columns)
    n = F.col("count").cast("double")
    base = rows.groupBy("column").agg(
        F.count("*").alias("n_total"), F.count("value").alias("count"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2"),
        F.avg((F.col("value") == 0).cast("double")).alias("zero_share"),
    )
    counts = rows.filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("k"))
    top = counts.groupBy("column").agg(F.max_by("value", F.struct("k", -F.col("value"))).alias("top_value"), F.max("k").alias("top_count"), F.count("*").alias("n_unique"))
    out = base.join(top, "column", "left").join(ordered.percentiles(rows, QUANTILES, "column"), "column", "left").select(
        "column", "n_total", "count", F.coalesce("n_unique", F.lit(0)).alias("n_unique"), "least", "most", "mean", "std", "top_value",
        F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).alias("kurtosis"),
        *[F.get("q", F.lit(i)).alias(f"p{int(q * 100):02d}") for i, q in enumerate(QUANTILES)],
        (F.col("top_count") / F.col("count")).alias("top_share"), "zero_share",
    )
    return out


def categorical_profile(df: DataFrame, columns: list[str], tail: float = 0.01) -> DataFrame:
    counts = long(df, columns, kind="string").groupBy("column", "value").agg(F.count("*").alias("k")).filter("value is not null")
    up = Window.partitionBy("column").orderBy("k", "value").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("column")
    marked = counts.withColumn("rare", F.sum("k").over(up) <= tail * F.sum("k").over(whole))
    return marked.groupBy("column").agg(
        F.count("*").alias("n_levels"), F.sum("k").alias("n"), F.max("k").alias("top_count"), F.max_by("value", F.struct("k", "value")).alias("top_level"),
        F.count_if("rare").alias("n_rare"), F.count_if(F.col("k") == 1).alias("n_single"),
    )


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal widths; the last bin has both its ends."""
    span = df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    x = F.col(column)
    at = F.when(x == F.col("high"), bins - 1).otherwise(F.floor((x - F.col("low")) / ((F.col("high") - F.col("low")) / bins)).cast("int"))
    return df.filter(x.isNotNull()).crossJoin(F.broadcast(span)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # one row


def rate_by_group(df: DataFrame, *by: str, label: str = "label") -> DataFrame:
    """n, k, rate, share of rows and Wilson bounds of each level; null is a level."""
    levels = [F.coalesce(F.col(b).cast("string"), F.lit(MISSING)).alias(b) for b in by]
    g = df.select(*levels, label).groupBy(*by).agg(F.count("*").alias("n"), F.sum(label).cast("bigint").alias("k"))
    low, high = wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    total = g.agg(F.sum("n").alias("all"))
    return g.crossJoin(F.broadcast(total)).select(*by, "n", "k", (F.col("k") / F.col("n")).alias("rate"), (F.col("n") / F.col("all")).alias("share"), low.alias("low"), high.alias("high"))


def missing_blocks(df: DataFrame, columns: list[str], row: str = "id") -> DataFrame:
    """column, block: columns whose nulls fall on the same rows share a block, named after the first of them.

    Each column's null mask is told by its size and two order-free digests of the row ids: one aggregate over all columns.
    """
    marks = long(df, columns, row, kind="string").groupBy("column").agg(
        F.count_if(F.col("value").isNull()).alias("n_null"),
        F.coalesce(F.bit_xor(F.when(F.col("value").isNull(), F.xxhash64(row))), F.lit(0)).alias("x"),
        F.coalesce(F.bit_xor(F.when(F.col("value").isNull(), F.xxhash64(row, F.lit(7)))), F.lit(0)).alias("y"),
    )
    return marks.select("column", "n_null", F.min("column").over(Window.partitionBy("n_null", "x", "y")).alias("block"))


def missing_overlap(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, share of rows where both are missing; one wide aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.avg((F.col(a).isNull() & F.col(b).isNull()).cast("double")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("share")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def missing_against_label(df: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    rows = long(df, columns, label, kind="string")
    gone = F.col("value").isNull()
    y = F.col(label)
    g = rows.groupBy("column").agg(F.count_if(gone).alias("n_missing"), F.count_if(~gone).alias("n_present"), F.coalesce(F.sum(F.when(gone, y)), F.lit(0)).alias("k_missing"), F.coalesce(F.sum(F.when(~gone, y)), F.lit(0)).alias("k_present"))
    d = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    km, nm, kp, np_ = (F.col(c).cast("double") for c in ("k_missing", "n_missing", "k_present", "n_present"))
    return g.select("*", d("k_missing", "n_missing").alias("rate_missing"), d("k_present", "n_present").alias("rate_present"), F.try_divide(d("k_missing", "n_missing"), d("k_present", "n_present")).alias("risk_ratio"), two_proportion_z(km, nm, kp, np_).alias("z"))


def column_percentiles(df: DataFrame, columns: list[str], qs: list[float] | tuple[float, ...]) -> dict[str, list[float]]:
    """Exact percentiles of each column that has a value; a row per column comes to the driver."""
    if not columns:
        return {}
    return {r.column: list(r.q) for r in ordered.percentiles(long(df, list(columns)), qs, "column").collect()}


def quantile_edges(df: DataFrame, columns: list[str], bins: int = 10) -> dict[str, list[float]]:
    """Inner cut points of each column, equal ones once; the outermost bins are open. One aggregate for all columns."""
    found = column_percentiles(df, columns, [i / bins for i in range(bins + 1)])
    return {c: sorted(set(found.get(c, [])))[1:-1] for c in columns}


def binned(c: str, edges: list[float]) -> Column:
    """Right-closed bins as labels, null as a bin."""
    code = right_closed(F.col(c).cast("double"), F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>"))
    return F.when(F.col(c).isNull(), MISSING).otherwise(F.concat(F.lit("b"), F.lpad(code.cast("string"), 2, "0")))


def bins_long(df: DataFrame, edges: dict[str, list[float] | None], *keep: str) -> DataFrame:
    """keep..., column, bin; columns without edges (None) are levels."""
    made = [F.struct(F.lit(c).alias("column"), (F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) if e is None else binned(c, e)).alias("bin")) for c, e in edges.items()]
    return df.select(*keep, F.explode(F.array(*made)).alias("x")).select(*keep, "x.column", "x.bin")


def decile_table(df: DataFrame, column: str, label: str = "label", bins: int = 10) -> DataFrame:
    edges = quantile_edges(df, [column], bins)[column]
    g = df.select(binned(column, edges).alias("bin"), F.col(column).alias("v"), label).groupBy("bin")
    g = g.agg(F.count("*").alias("n"), F.sum(label).cast("bigint").alias("k"), F.min("v").alias("least"), F.max("v").alias("most"))
    low, high = wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return g.select("bin", "n", "k", "least", "most", (F.col("k") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


def information_value(df: DataFrame, numeric: list[str], levels: list[str] = (), label: str = "label", bins: int = 10) -> DataFrame:
    """column, n_bins, iv, iv_missing (the term of the null bin), iv_present."""
    edges = quantile_edges(df, list(numeric), bins) | dict.fromkeys(levels)
    g = bins_long(df, edges, label).groupBy("column", "bin").agg(F.count_if(F.col(label) == 0).alias("g0"), F.count_if(F.col(label) == 1).alias("b0"))
    w = Window.partitionBy("column")
    good, bad = F.col("g0") + SMOOTHING, F.col("b0") + SMOOTHING
    g = g.withColumn("good", good / F.sum(good).over(w)).withColumn("bad", bad / F.sum(bad).over(w))
    term = (F.col("good") - F.col("bad")) * F.ln(F.col("good") / F.col("bad"))
    out = g.groupBy("column").agg(F.count("*").alias("n_bins"), F.sum(term).alias("iv"), F.coalesce(F.sum(F.when(F.col("bin") == MISSING, term)), F.lit(0.0)).alias("iv_missing"))
    return out.withColumn("iv_present", F.col("iv") - F.col("iv_missing"))


def psi(reference: DataFrame, current: DataFrame, edges: dict[str, list[float] | None]) -> DataFrame:
    """column, psi, n_new (bins that the reference doesn't have). The bins come from the reference."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        g = bins_long(df, edges).groupBy("column", "bin").agg(F.count("*").alias("n"))
        return g.select("column", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy("column"))).alias(name))

    both = shares(reference, "e").join(shares(current, "a"), ["column", "bin"], "full_outer")
    e, a = F.greatest(F.coalesce("e", F.lit(0.0)), F.lit(FLOOR)), F.greatest(F.coalesce("a", F.lit(0.0)), F.lit(FLOOR))
    return both.groupBy("column").agg(F.sum((a - e) * F.ln(a / e)).alias("psi"), F.count_if(F.col("e").isNull()).alias("n_new"))


def entity_structure(df: DataFrame, entity: str = "entity", ts: str = "ts", row: str = "id", label: str = "label") -> DataFrame:
    """Sizes, purity and gaps of entities, by whether they hold a positive row."""
    gaps = df.withColumn("gap", F.col(ts) - F.lag(ts).over(Window.partitionBy(entity).orderBy(ts, row)))
    per = gaps.groupBy(entity).agg(F.count("*").alias("n"), F.sum(label).alias("k"), F.sum("gap").alias("gap_sum"), F.count("gap").alias("gap_n"))
    return per.groupBy((F.col("k") > 0).alias("positive")).agg(
        F.count("*").alias("entities"), F.sum("n").alias("rows"), F.max("n").alias("largest"), F.percentile("n", F.lit(0.5)).alias("median_size"), F.count_if(F.col("n") == 1).alias("singletons"),
        F.count_if(F.col("k") == F.col("n")).alias("pure"), F.try_divide(F.sum("gap_sum").cast("double"), F.sum("gap_n")).alias("mean_gap"),
    )


def cold_warm(df: DataFrame, *by: str, entity: str = "entity", ts: str = "ts", row: str = "id", label: str = "label") -> DataFrame:
    """The first row of each entity against its later ones."""
    first = F.row_number().over(Window.partitionBy(entity).orderBy(ts, row)) == 1
    return df.withColumn("cold", first).groupBy("cold", *by).agg(F.count("*").alias("n"), F.sum(label).cast("bigint").alias("k"), F.avg(label).alias("rate"))


def duplicate_groups(df: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """Groups of rows equal on the columns (nulls are equal) and the rates inside and outside."""
    g = df.groupBy(*columns).agg(F.count("*").alias("n"), F.sum(label).alias("k"))
    twice = F.col("n") > 1
    return g.agg(
        F.count_if(twice).alias("groups"), F.coalesce(F.sum(F.when(twice, F.col("n"))), F.lit(0)).alias("rows"), F.max("n").alias("largest"),
        F.try_divide(F.sum(F.when(twice, F.col("k"))).cast("double"), F.sum(F.when(twice, F.col("n")))).alias("rate_in"), F.try_divide(F.sum(F.when(~twice, F.col("k"))).cast("double"), F.sum(F.when(~twice, F.col("n")))).alias("rate_out"),
    )


def zero_against_positive(df: DataFrame, column: str, *by: str, label: str = "label") -> DataFrame:
    x, y = F.col(column), F.col(label)
    g = df.groupBy(*by).agg(F.count_if(x == 0).alias("n0"), F.count_if(x > 0).alias("n1"), F.coalesce(F.sum(F.when(x == 0, y)), F.lit(0)).alias("k0"), F.coalesce(F.sum(F.when(x > 0, y)), F.lit(0)).alias("k1"))
    l0, h0 = wilson(F.col("k0").cast("double"), F.col("n0").cast("double"))
    l1, h1 = wilson(F.col("k1").cast("double"), F.col("n1").cast("double"))
    r0, r1 = F.try_divide(F.col("k0").cast("double"), F.col("n0")), F.try_divide(F.col("k1").cast("double"), F.col("n1"))
    return g.select(*by, "n0", "n1", "k0", "k1", r0.alias("rate0"), r1.alias("rate1"), F.try_divide(r1, r0).alias("lift"), ((h0 < l1) | (h1 < l0)).alias("disjoint"))


def label_granularity(df: DataFrame, *keys: str, label: str = "label") -> DataFrame:
    """Of groups of two rows or more: all positive, all negative, mixed."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(label).alias("k")).filter("n > 1")
    return g.agg(F.count("*").alias("groups"), F.count_if(F.col("k") == F.col("n")).alias("all_positive"), F.count_if(F.col("k") == 0).alias("all_negative"), F.count_if((F.col("k") > 0) & (F.col("k") < F.col("n"))).alias("mixed"))


def key_sizes(df: DataFrame, key: str) -> DataFrame:
    g = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    missing = df.agg(F.count_if(F.col(key).isNull()).alias("n_missing"))
    out = g.agg(F.count("*").alias("keys"), F.avg("n").alias("mean"), F.max("n").alias("most"), F.percentile("n", F.array(F.lit(0.5), F.lit(0.9))).alias("q"), F.count_if(F.col("n") == 1).alias("single"))
    return out.crossJoin(F.broadcast(missing)).select("keys", "mean", "most", F.get("q", F.lit(0)).alias("median"), F.get("q", F.lit(1)).alias("p90"), "single", "n_missing")


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """A column that isn't there is reported as absent."""
    have = [c for c in columns if c in df.columns]
    out = long(df, have, kind="string").groupBy("column").agg(F.count_if(F.col("value").isNull()).alias("n_null"), F.count("*").alias("n"))
    out = out.select("column", F.lit(True).alias("present"), "n_null", (F.col("n_null") / F.col("n")).alias("rate"))
    gone = [c for c in columns if c not in have]
    return out if not gone else out.unionByName(df.sparkSession.createDataFrame([(c, False, None, None) for c in gone], "column string, present boolean, n_null bigint, rate double"))


def state_footprint(df: DataFrame, grains: dict[str, str]) -> DataFrame:
    """Keys of each grain and rows by key: what an online store would hold. grains: name -> column."""
    parts = long(df, list(grains.values()), kind="string").filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    return parts.groupBy("column").agg(F.count("*").alias("keys"), F.avg("n").alias("mean"), F.percentile("n", F.array(F.lit(0.95), F.lit(0.99))).alias("q"), F.max("n").alias("most")).select("column", "keys", "mean", F.get("q", F.lit(0)).alias("p95"), F.get("q", F.lit(1)).alias("p99"), "most")


def distinct_per_group(df: DataFrame, group: str, value: str) -> DataFrame:
    g = df.groupBy(group).agg(F.countDistinct(value).alias("d"))
    return g.agg(F.count("*").alias("groups"), F.avg("d").alias("mean"), F.max("d").alias("most"), F.count_if(F.col("d") <= 1).alias("degenerate"))


def ties(df: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Rows that share key and instant with an earlier row."""
    return df.groupBy(key, ts).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("tied_rows"), F.count_if(F.col("n") > 1).alias("groups"))


def compare(a: DataFrame, b: DataFrame, columns: list[str], key: str = "id", tolerance: float = 1e-9) -> DataFrame:
    """column, worst difference, rows null on one side alone, rows beyond the tolerance."""
    both = long(a, columns, key).withColumnRenamed("value", "x").join(long(b, columns, key).withColumnRenamed("value", "y"), [key, "column"], "full_outer")
    d = F.abs(F.col("x") - F.col("y"))
    return both.groupBy("column").agg(F.count("*").alias("n"), F.max(d).alias("worst"), F.count_if(F.col("x").isNull() != F.col("y").isNull()).alias("n_null_mismatch"), F.count_if(d > tolerance).alias("n_beyond"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free digest of a frame."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h % 1_000_003).alias("s"))


def membership(df: DataFrame, keys: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Rows and rates inside and outside a set of keys."""
    marked = df.join(keys.select(key).distinct().withColumn("seen", F.lit(True)), key, "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    return marked.groupBy("seen").agg(F.count("*").alias("n"), F.countDistinct(key).alias("keys"), F.sum(label).cast("bigint").alias("k"), F.avg(label).alias("rate"))


def clip_cost(df: DataFrame, columns: list[str], tails: tuple[float, ...] = (0.001, 0.01), label: str = "label") -> DataFrame:
    """Rows and positives outside symmetric quantiles, for each column and tail."""
    qs = [q for t in tails for q in (t, 1 - t)]
    row = column_percentiles(df, columns, qs)
    parts = []
    for c in columns:
        bounds = row.get(c, [None] * len(qs))
        for i, t in enumerate(tails):
            out = (F.col(c) < F.lit(bounds[2 * i])) | (F.col(c) > F.lit(bounds[2 * i + 1]))
            parts.append(F.struct(F.lit(c).alias("column"), F.lit(t).alias("tail"), F.count_if(out).alias("n_out"), F.coalesce(F.sum(F.when(out, F.col(label))), F.lit(0)).alias("k_out")))
    return df.agg(*[p.alias(f"p{i}") for i, p in enumerate(parts)]).select(F.explode(F.array(*[F.col(f"p{i}") for i in range(len(parts))])).alias("x")).select("x.*")


def quantile_shift(a: DataFrame, b: DataFrame, columns: list[str], qs: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """column, q, value in a, in b and the difference."""
    at = F.array(*[F.lit(q) for q in qs])
    side = lambda df, n: ordered.percentiles(long(df, columns), qs, "column").select("column", F.posexplode("q").alias("i", n))
    both = side(a, "x").join(side(b, "y"), ["column", "i"])
    return both.select("column", F.get(at, F.col("i")).alias("q"), "x", "y", (F.col("y") - F.col("x")).alias("shift"))


def heaviest(df: DataFrame, columns: list[str], share: float) -> DataFrame:
    """Values that at least a share of the rows carry."""
    n = df.count()
    return long(df, columns, kind="string").filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n")).filter(F.col("n") >= share * n)
