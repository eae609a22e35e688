"""Evaluation of scores. Every metric is built from one aggregate by score and cumulative sums over distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ordered


def by_score(df: DataFrame, *by: str, score: str = "score", label: str = "label") -> DataFrame:
    return df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(label).cast("double").alias("tp"), F.count("*").cast("double").alias("n"))


def curve(df: DataFrame, *by: str, score: str = "score", label: str = "label") -> DataFrame:
    """For each distinct score: positives and alerts at or above it."""
    g = by_score(df, *by, score=score, label=label)
    c = ordered.running(g, "score", "tp", "n", by=by, down=True)
    totals = [F.col("all_tp").alias("positives"), F.col("all_n").alias("rows")]
    return c.select(*by, "score", F.col("tp").alias("own"), F.col("n").alias("own_n"), F.col("upto_tp").alias("tp"), F.col("upto_n").alias("alerts"), *totals)


def average_precision(df: DataFrame, *by: str, score: str = "score", label: str = "label") -> DataFrame:
    """Sum of precision times the step in recall, over distinct scores from above."""
    c = curve(df, *by, score=score, label=label)
    return c.groupBy(*by).agg(F.sum(F.try_divide(F.col("own"), F.col("positives")) * F.col("tp") / F.col("alerts")).alias("pr_auc"))


def roc_auc(df: DataFrame, *by: str, score: str = "score", label: str = "label") -> DataFrame:
    """Share of pairs in order, ties half: positives at a score against the negatives below it."""
    c = curve(df, *by, score=score, label=label)
    above_n = F.col("alerts") - F.col("tp")
    own_n = F.col("own_n") - F.col("own")
    negatives = F.col("rows") - F.col("positives")
    return c.groupBy(*by).agg(F.try_divide(F.sum(F.col("own") * (negatives - above_n + own_n / 2)), F.max(F.col("positives") * negatives)).alias("roc_auc"))


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    return {"precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn), "f1": F.try_divide(2 * tp, 2 * tp + fp + fn), "alert_rate": F.try_divide(tp + fp, tp + fp + fn + tn), "false_positive_rate": F.try_divide(fp, fp + tn)}


def sweep(df: DataFrame, thresholds: list[float], *by: str, score: str = "score", label: str = "label") -> DataFrame:
    """Confusion counts and rates at score >= t, for all thresholds in one aggregate."""
    s, y = F.col(score), F.col(label)
    parts = [F.struct(F.lit(float(t)).alias("threshold"), F.count_if((s >= t) & (y == 1)).alias("tp"), F.count_if((s >= t) & (y == 0)).alias("fp"), F.count_if((s < t) & (y == 1)).alias("fn"), F.count_if((s < t) & (y == 0)).alias("tn")).alias(f"t{i}") for i, t in enumerate(thresholds)]
    rows = df.groupBy(*by).agg(*parts).select(*by, F.explode(F.array(*[F.col(f"t{i}") for i in range(len(parts))])).alias("x")).select(*by, "x.*")
    d = [F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn")]
    return rows.select("*", *[c.alias(n) for n, c in rates(*d).items()])


def best_f1(df: DataFrame, *by: str, score: str = "score", label: str = "label") -> DataFrame:
    """Largest F1 over distinct scores, equal ones at the lowest threshold."""
    c = curve(df, *by, score=score, label=label).withColumn("f1", 2 * F.col("tp") / (F.col("alerts") + F.col("positives")))
    return c.groupBy(*by).agg(F.max_by(F.struct("score", "f1", "tp", "alerts"), F.struct("f1", -F.col("score"))).alias("x")).select(*by, F.col("x.score").alias("threshold"), "x.f1", F.col("x.tp").cast("bigint").alias("tp"), F.col("x.alerts").cast("bigint").alias("alerts"))


def alert_budget(df: DataFrame, per_day: float, days: float, score: str = "score", label: str = "label") -> DataFrame:
    """The threshold whose alerts use up a budget: the k-th largest score."""
    k = max(1, round(per_day * days))
    c = curve(df, score=score, label=label)
    enough = c.agg(F.max(F.when(F.col("alerts") >= F.least(F.lit(k), F.col("rows")), F.col("score"))).alias("threshold"))
    return c.join(F.broadcast(enough), F.col("score") == F.col("threshold")).select("threshold", F.col("tp").cast("bigint").alias("tp"), F.col("alerts").cast("bigint").alias("alerts"))


def card_level(df: DataFrame, key: str, score: str = "score", label: str = "label") -> DataFrame:
    return df.groupBy(key).agg(F.max(score).alias("score"), F.max(label).alias("label"), F.count("*").alias("n"))


def reliability(df: DataFrame, bins: int = 10, p: str = "score", label: str = "label", row: str = "id") -> DataFrame:
    """Bins of equal counts in order of p: mean p, rate, gap. The bin of a row comes from its place in the whole order."""
    g = _ranked(df, p, row).withColumn("bin", _ntile(bins)).groupBy("bin")
    return g.agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("rate"), F.avg((F.col(p) - F.col(label)) ** 2).alias("brier")).withColumn("gap", F.abs(F.col("mean_p") - F.col("rate")))


def _ranked(df: DataFrame, p: str, row: str, parts: int = 256) -> DataFrame:
    """place (from 0) of each row in the order of (p, row), and the number of rows, without one task for all rows: rows are
    numbered inside slices of the value and slices are offset by their counts."""
    edges = ordered.cuts(df, p, parts)
    sliced = df.withColumn("slice", F.greatest(ordered.slice_of(F.col(p), edges), F.lit(0)))
    sizes = dict(sliced.groupBy("slice").count().collect())  # a row per slice, ``parts`` at most
    lead, upto = [], 0
    for i in range(len(edges) + 1):
        lead.append(upto)
        upto += sizes.get(i, 0)
    at = F.row_number().over(Window.partitionBy("slice").orderBy(p, row))
    place = F.get(F.array(*[F.lit(x) for x in lead]), F.col("slice")).cast("bigint") + F.col("at") - 1
    return sliced.withColumn("at", at).withColumn("place", place).withColumn("total", F.lit(upto).cast("bigint")).drop("slice", "at")


def _ntile(bins: int) -> Column:
    """Larger bins first, as ntile deals them; bins from 0."""
    big = f"(total % {bins}) * (total div {bins} + 1)"
    return F.when(F.expr(f"place < {big}"), F.expr(f"place div (total div {bins} + 1)")).otherwise(F.expr(f"total % {bins} + (place - {big}) div greatest(total div {bins}, 1)")).cast("int")


def cost_edges(missed: float, decline: float, review: float) -> tuple[float, float]:
    """Review beats approval from review / missed; a block beats review from 1 - review / decline."""
    if min(missed, decline, review) <= 0:
        raise ValueError("costs must be positive")
    return review / missed, 1 - review / decline


def band(p: Column, low: float, high: float) -> Column:
    """0 approve, 1 review, 2 block; an edge belongs to the riskier band."""
    return F.when(p >= high, 2).when(p >= low, 1).otherwise(0)


def band_report(df: DataFrame, costs: tuple[float, float, float], *by: str, p: str = "score", label: str = "label") -> DataFrame:
    missed, decline, review = costs
    low, high = cost_edges(*costs)
    g = df.withColumn("band", band(F.col(p), low, high)).groupBy("band", *by).agg(F.count("*").alias("n"), F.sum(label).cast("bigint").alias("k"))
    cost = F.when(F.col("band") == 0, F.col("k") * missed).when(F.col("band") == 1, F.col("n") * review).otherwise((F.col("n") - F.col("k")) * decline)
    return g.withColumn("rate", F.col("k") / F.col("n")).withColumn("cost", cost.cast("double"))


def poisson_one(key: Column, draw: Column, seed: int) -> Column:
    """A Poisson(1) weight from a hash of key and draw, by the inverse of its distribution."""
    u = F.pmod(F.xxhash64(key, draw, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    cdf, total, p = [], 0.0, 0.36787944117144233
    for k in range(1, 16):
        total += p
        cdf.append(total)
        p /= k
    return sum(((u >= c).cast("int") for c in cdf), F.lit(0))


def bootstrap(df: DataFrame, draws: int, seed: int = 42, key: str = "id", label: str = "label", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """draw, precision, recall: each row (or group, by its key) gets a Poisson(1) weight in each draw from a hash, so all
    measures share their draws and nothing is resampled by position."""
    many = df.select(key, label, score, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("w", poisson_one(F.col(key), F.col("draw"), seed))
    hit = F.col(score) >= threshold
    g = many.groupBy("draw").agg(F.sum(F.when(hit & (F.col(label) == 1), F.col("w")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("w")).otherwise(0)).alias("alerts"), F.sum(F.col("w") * F.col(label)).alias("positives"))
    return g.select("draw", F.try_divide(F.col("tp").cast("double"), F.col("alerts")).alias("precision"), F.try_divide(F.col("tp").cast("double"), F.col("positives")).alias("recall"))


def interval(draws: DataFrame, column: str, level: float = 0.95) -> DataFrame:
    a = (1 - level) / 2
    return draws.agg(F.avg(column).alias("mean"), F.percentile(column, F.array(F.lit(a), F.lit(1 - a))).alias("q")).select("mean", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


def paired_difference(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Difference over shared draws: mean, bounds, share of draws with the sign of the mean."""
    d = a.select("draw", F.col(column).alias("x")).join(b.select("draw", F.col(column).alias("y")), "draw").select((F.col("y") - F.col("x")).alias("d"))
    r = d.agg(F.avg("d").alias("mean"), F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.avg((F.col("d") > 0).cast("double")).alias("up"))
    return r.select("mean", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"), F.greatest("up", 1 - F.col("up")).alias("sign_agreement"))


def isotonic(df: DataFrame, score: str = "score", label: str = "label"):
    """A fitted calibrator; ``transform`` gives the column prediction."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    rows = VectorAssembler(inputCols=[score], outputCol="features").transform(df.select(F.col(score).cast("double"), F.col(label).cast("double").alias("label")))
    return IsotonicRegression(featuresCol="features", labelCol="label").fit(rows)
