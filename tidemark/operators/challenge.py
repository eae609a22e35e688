"""Tests of columns and models against time: consistency, adversarial validation, performance by batch, late labels, search.

One-column models are orderings of bins, so their AUC comes from counts by bin and no row is scored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import correlate, evaluate, guards, ordered, profile


def auc_of_counts(counts: DataFrame, value: str, positives: str, negatives: str, *by: str) -> DataFrame:
    """by..., auc over rows of (value, positives, negatives), ties half."""
    level = counts.groupBy(*by, value).agg(F.sum(positives).alias("p"), F.sum(negatives).alias("q"))
    level = ordered.running(level, value, "q", by=by).withColumn("under", F.col("upto_q") - F.col("q"))
    return level.groupBy(*by).agg(F.try_divide(F.sum(F.col("p") * (F.col("under") + F.col("q") / 2.0)), F.sum("p") * F.sum("q")).alias("auc"))


def time_consistency(early: DataFrame, late: DataFrame, numeric: list[str], levels: list[str] = (), label: str = "label", bins: int = 10) -> DataFrame:
    """column, early_auc, late_auc, inverted: bins of the early window ordered by their early rate, and what that order is worth
    in each window. A level unseen early ranks at the early rate of all rows. An AUC is null for a window of one class."""
    edges = (profile.quantile_edges(early, list(numeric), bins) if numeric else {}) | dict.fromkeys(levels)

    def counts(df: DataFrame, name: str) -> DataFrame:
        g = profile.bins_long(df, edges, label).groupBy("column", "bin")
        return g.agg(F.count_if(F.col(label) == 1).alias(f"{name}_p"), F.count_if(F.col(label) == 0).alias(f"{name}_q"))

    both = counts(early, "early").join(counts(late, "late"), ["column", "bin"], "full_outer").na.fill(0)
    w = Window.partitionBy("column")
    overall = F.try_divide(F.sum("early_p").over(w), F.sum(F.col("early_p") + F.col("early_q")).over(w))
    rated = both.withColumn("rate", F.round(F.coalesce(F.try_divide(F.col("early_p"), F.col("early_p") + F.col("early_q")), overall), 12))
    a = auc_of_counts(rated, "rate", "early_p", "early_q", "column").withColumnRenamed("auc", "early_auc")
    b = auc_of_counts(rated, "rate", "late_p", "late_q", "column").withColumnRenamed("auc", "late_auc")
    return a.join(b, "column").withColumn("inverted", (F.col("early_auc") > 0.5) & (F.col("late_auc") < 0.5))


def single_column_auc(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """column, auc of the column's own order for telling b from a, nulls lowest; null for a column of one value."""
    counts = profile.long(a.withColumn("side", F.lit(0)).select("side", *columns).unionByName(b.withColumn("side", F.lit(1)).select("side", *columns)), columns, "side")
    counts = counts.groupBy("column", "value").agg(F.count_if(F.col("side") == 1).alias("n1"), F.count_if(F.col("side") == 0).alias("n0"))
    several = counts.groupBy("column").agg((F.count("*") > 1).alias("several"))
    return auc_of_counts(counts, "value", "n1", "n0", "column").join(several, "column").select("column", F.when(F.col("several"), F.col("auc")).alias("auc"))


def adversarial(a: DataFrame, b: DataFrame, columns: list[str], folds: int = 5, family: str = "boosted", row: str = "id", seed: int = 42) -> DataFrame:
    """fold, auc of models that tell b from a, each scored on rows it wasn't fitted on; fold -1 is all rows out of fold. Folds
    come from a hash of the id. Nulls must be filled before."""
    both = a.select(row, *columns).withColumn("label", F.lit(0)).unionByName(b.select(row, *columns).withColumn("label", F.lit(1)))
    both = both.withColumn("fold", F.pmod(F.xxhash64(row, F.lit(seed)), F.lit(folds)).cast("int"))
    held = [correlate.fit_and_score(both.filter(F.col("fold") != k), both.filter(F.col("fold") == k), columns, family, row).withColumn("fold", F.lit(k)) for k in range(folds)]
    scored = reduce(DataFrame.unionByName, held)
    each = evaluate.roc_auc(scored, "fold")
    return each.unionByName(evaluate.roc_auc(scored).select(F.lit(-1).alias("fold"), "roc_auc"))


def performance(df: DataFrame, reference: float, as_of: int, maturity_days: int, day: int, tolerance: float = 0.06, by: str = "batch", end: str = "end", score: str = "score", label: str = "label") -> DataFrame:
    """by, n, k, pr_auc, roc_auc, change, decayed. Refuses a batch whose labels can't be known yet."""
    guards.assert_mature(df, end, maturity_days, as_of, day)
    counts = df.groupBy(by).agg(F.count("*").alias("n"), F.sum(label).alias("k"))
    metrics = evaluate.average_precision(df, by, score=score, label=label).join(evaluate.roc_auc(df, by, score=score, label=label), by)
    change = F.col("pr_auc") - F.lit(reference)
    return counts.join(metrics, by).withColumn("change", change).withColumn("decayed", F.coalesce(change < -tolerance, F.lit(False)))


def label_latency(df: DataFrame, days: list[int], day: int, time: str = "ts", label: str = "label") -> DataFrame:
    """days, treatment, n, k, rate, true_rate: the labels of the last so many days aren't there yet and count as 0
    (``immature``) or their rows are left out (``excluded``). One aggregate for all."""
    last = df.agg(F.max(time).alias("last_"))
    rows = df.crossJoin(F.broadcast(last))  # one row
    parts: list[Column] = [F.count("*").alias("n_all"), F.sum(label).alias("k_all")]
    for d in days:
        known = F.col(time) < F.col("last_") - d * day if d else F.lit(True)
        parts += [F.count_if(known).alias(f"n{d}"), F.coalesce(F.sum(F.when(known, F.col(label))), F.lit(0)).alias(f"k{d}")]
    one = rows.agg(*parts)
    cases = [F.struct(F.lit(d).alias("days"), F.lit(t).alias("treatment"), F.col("n_all" if t == "immature" else f"n{d}").alias("n"), F.col(f"k{d}").alias("k")) for d in days for t in ("immature", "excluded")]
    out = one.select(F.explode(F.array(*cases)).alias("x"), F.try_divide(F.col("k_all").cast("double"), F.col("n_all")).alias("true_rate"))
    return out.select("x.*", F.try_divide(F.col("x.k").cast("double"), F.col("x.n")).alias("rate"), "true_rate")


def leakage(df: DataFrame, entity: str = "entity", time: str = "ts", score: str = "score", label: str = "label") -> DataFrame:
    """variant, roc_auc, delta: scores as they are, averaged over all rows of the entity (later ones too), and averaged over the
    rows strictly before. Averages are rounded to nine digits, so that equal ones tie."""
    before = Window.partitionBy(entity).orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
    whole = F.round(F.avg(score).over(Window.partitionBy(entity)), 9)
    past = F.round(F.coalesce(F.avg(score).over(before), F.col(score)), 9)
    made = df.select(F.col(label).alias("label"), F.col(score).alias("baseline"), whole.alias("all_rows"), past.alias("past_rows"))
    wide = profile.long(made, ["baseline", "all_rows", "past_rows"], "label").select("label", F.col("column").alias("variant"), F.col("value").alias("score"))
    auc = evaluate.roc_auc(wide, "variant")
    base = F.max(F.when(F.col("variant") == "baseline", F.col("roc_auc"))).over(Window.partitionBy())  # three rows
    return auc.withColumn("delta", F.col("roc_auc") - base)


def rate_bootstrap(df: DataFrame, draws: int, *by: str, row: str = "id", label: str = "label", seed: int = 42, level: float = 0.95) -> DataFrame:
    """by..., rate, low, high: the draws share Poisson weights hashed from the row, and are summed before any shuffle."""
    many = df.select(*by, row, label, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    w = many.withColumn("w", evaluate.poisson_one(F.col(row), F.col("draw"), seed))
    each = w.groupBy(*by, "draw").agg(F.sum(label).alias("k"), F.count("*").alias("n"), F.try_divide(F.sum(F.col("w") * F.col(label)).cast("double"), F.sum("w")).alias("drawn"))
    a = (1 - level) / 2
    out = each.groupBy(*by).agg(F.first(F.col("k") / F.col("n")).alias("rate"), F.percentile("drawn", F.array(F.lit(a), F.lit(1 - a))).alias("q"))
    return out.select(*by, "rate", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


def search(df: DataFrame, features: list[str], penalties: list[float], k: int = 3, time: str = "ts", row: str = "id", label: str = "label") -> DataFrame:
    """penalty, fold, roc_auc over expanding windows: fold i is fitted on blocks up to i and scored on the next."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    packed = VectorAssembler(inputCols=features, outputCol="features").transform(guards.folds(df, k, time))
    out = []
    for c in penalties:
        for i in range(k):
            model = correlate.linear_models(features, label)["logistic"].copy().setRegParam(c).fit(packed.filter(F.col("block") <= i))
            scored = model.transform(packed.filter(F.col("block") == i + 1)).select(row, label, F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
            out.append(evaluate.roc_auc(scored, label=label).select(F.lit(c).alias("penalty"), F.lit(i).alias("fold"), "roc_auc"))
    return reduce(DataFrame.unionByName, out)
