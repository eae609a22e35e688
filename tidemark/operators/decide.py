"""Decisions read from sweeps: the lag and the smoothing of a target encoding, agreement of two metrics, levels a fit never saw.

A sweep encodes no row. Rows are counted by (column, level, day) once, each setting's encoding is a value of such a count, and
an AUC comes from the counts by value. What follows are tables of a row per setting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import challenge, profile

#: An AUC below this tells nothing about what a split can resolve.
LEAST_AUC = 0.51


def target_sweep(df: DataFrame, columns: list[str], lags: list[int], smoothings: list[float], split: str = "split", label: str = "label", day: str = "day") -> DataFrame:
    """column, lag, smoothing, train_auc, validation_auc of each column's target encoding alone, over rows that have one.

    Rows of a split other than ``train`` and ``val`` are left out, and labels of ``val`` only judge. A null level has no
    encoding, nor has a row before any train row; an AUC is null for a side of one class.
    """
    x = df.filter(F.col(split).isin("train", "val"))
    train, positive = F.col(split) == "train", F.col(label) == 1
    sides = {"train_p": train & positive, "train_q": train & ~positive, "val_p": ~train & positive, "val_q": ~train & ~positive}
    levels = profile.long(x, columns, split, label, F.col(day).alias("day"), kind="string").filter("value is not null")
    counts = levels.groupBy("column", "value", "day").agg(*[F.count_if(c).alias(n) for n, c in sides.items()])
    daily = x.groupBy(F.col(day).alias("day")).agg(F.count_if(train & positive).alias("train_p"), F.count_if(train & ~positive).alias("train_q"))

    def upto(lag: int, *by: str) -> tuple[Column, Column]:
        """Positives and rows of train known so many days before."""
        w = Window.partitionBy(*by).orderBy("day").rangeBetween(Window.unboundedPreceding, -lag)
        known = [F.coalesce(F.sum(c).over(w), F.lit(0)) for c in ("train_p", "train_q")]
        return known[0].cast("double"), (known[0] + known[1]).cast("double")

    def of_lag(lag: int, positives: Column, rows: Column) -> Column:
        return F.struct(F.lit(lag).alias("lag"), positives.alias("y"), rows.alias("n"))

    own = counts.select("*", F.array(*[of_lag(lag, *upto(lag, "column", "value")) for lag in lags]).alias("own"))
    prior = daily.select(F.col("day").alias("prior_day"), F.array(*[F.try_divide(*upto(lag)) for lag in lags]).alias("prior"))  # a row per day
    placed = own.join(prior, F.col("day") == F.col("prior_day")).select("column", *sides, "prior", F.posexplode("own").alias("i", "x"))
    placed = placed.withColumn("prior", F.get("prior", F.col("i"))).filter("prior is not null")
    each = placed.withColumn("smoothing", F.explode(F.array(*[F.lit(float(m)) for m in smoothings])))
    te = F.try_divide(F.col("x.y") + F.col("smoothing") * F.col("prior"), F.col("x.n") + F.col("smoothing"))
    keys = ["column", "lag", "smoothing"]
    scored = each.select("column", "x.lag", "smoothing", te.alias("te"), *sides).filter("te is not null").groupBy(*keys, "te").agg(*[F.sum(s).alias(s) for s in sides])
    fitted = challenge.auc_of_counts(scored, "te", "train_p", "train_q", *keys).withColumnRenamed("auc", "train_auc")
    held = challenge.auc_of_counts(scored, "te", "val_p", "val_q", *keys).withColumnRenamed("auc", "validation_auc")
    return fitted.join(held, keys)


def _half_width(difference: str) -> Column:
    """Half of a 95 % interval of a mean over columns; 0 for one column, which has no spread."""
    return scalar.Z95 * F.coalesce(F.stddev_samp(difference), F.lit(0.0)) / F.sqrt(F.count(difference))


def _paired_with_best(sweep: DataFrame, key: str) -> DataFrame:
    """key, validation_auc (mean of all settings), best (of equal ones the least), cost and cost_half: by how much the best one's
    validation AUC is above this one's, column by column."""
    w = Window.partitionBy()  # a row per setting
    means = sweep.groupBy(key).agg(F.avg("validation_auc").alias("validation_auc"))
    first = F.min(F.struct(-F.round("validation_auc", 9), F.col(key))).over(w)[key]
    means = means.filter("validation_auc is not null").withColumn("best", F.col(key) == first)
    each = sweep.groupBy(key, "column").agg(F.avg("validation_auc").alias("auc"))
    top = each.join(means.filter("best").select(key), key).select("column", F.col("auc").alias("top_auc"))
    cost = each.join(top, "column").withColumn("less", F.col("top_auc") - F.col("auc"))
    return means.join(cost.groupBy(key).agg(F.avg("less").alias("cost"), _half_width("less").alias("cost_half")), key)


def choose_lag(sweep: DataFrame, positives: int, negatives: int) -> DataFrame:
    """lag, validation_auc, gap, gap_half, cost, band, eligible, chosen.

    A lag is eligible if the mean over columns of train less validation AUC lies within its interval of zero, and if its cost
    against the best lag is within what a validation split of so many rows can resolve. The least eligible lag is chosen, the
    largest if there is none: a lag that lets a row's own label in shows as a gap, not as a worse validation AUC.
    """
    each = sweep.groupBy("lag", "column").agg((F.avg("train_auc") - F.avg("validation_auc")).alias("more"))
    gaps = each.groupBy("lag").agg(F.avg("more").alias("gap"), _half_width("more").alias("gap_half"))
    level = F.greatest(F.max(F.when(F.col("best"), F.col("validation_auc"))).over(Window.partitionBy()), F.lit(LEAST_AUC))  # a row per lag
    band = scalar.detectable_auc_difference(level, F.lit(float(positives)), F.lit(float(negatives)))
    both = _paired_with_best(sweep, "lag").withColumn("band", band).join(gaps, "lag")
    both = both.withColumn("eligible", F.coalesce((F.abs("gap") <= F.col("gap_half")) & (F.col("cost") <= F.col("band")), F.lit(False)))
    w = Window.partitionBy()
    chosen = F.coalesce(F.min(F.when(F.col("eligible"), F.col("lag"))).over(w), F.max("lag").over(w))
    return both.select("lag", "validation_auc", "gap", "gap_half", "cost", "band", "eligible", (F.col("lag") == chosen).alias("chosen"))


def choose_smoothing(sweep: DataFrame, lag: int) -> DataFrame:
    """smoothing, validation_auc, cost, cost_half, within, chosen, resolved at one lag: the best mean validation AUC is chosen;
    ``resolved`` tells whether any other lies outside the paired interval, so that the sweep told them apart."""
    found = _paired_with_best(sweep.filter(F.col("lag") == lag), "smoothing").withColumn("within", F.coalesce(F.col("cost") <= F.col("cost_half"), F.lit(False)))
    resolved = F.count_if(~F.col("within")).over(Window.partitionBy()) > 0
    return found.select("smoothing", "validation_auc", "cost", "cost_half", "within", F.col("best").alias("chosen"), resolved.alias("resolved"))


def metric_agreement(models: DataFrame, first: str = "roc_auc", second: str = "pr_auc", name: str = "name") -> DataFrame:
    """a, b, by_first, by_second, discordant for each two models of a table with a row per model: the signs of the differences of
    two metrics, and whether they differ, so that the choice of the metric is the decision. Differences under 1e-12 are none."""
    sides = [models.select(F.col(name).alias(s), F.round(first, 12).alias(f"x_{s}"), F.round(second, 12).alias(f"y_{s}")) for s in "ab"]
    both = sides[0].join(sides[1], F.col("a") < F.col("b"))
    signs = both.select("a", "b", F.signum(F.col("x_a") - F.col("x_b")).cast("int").alias("by_first"), F.signum(F.col("y_a") - F.col("y_b")).cast("int").alias("by_second"))
    return signs.withColumn("discordant", F.col("by_first") != F.col("by_second"))


def unseen_levels(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """column, in_train, only_later, later_rows, share: levels, those found only outside of train, the rows that carry one, and
    their share of all rows outside of train (null if there are none). A null is no level but a row."""
    counts = profile.long(df.withColumn("in_train_", train), columns, "in_train_", kind="string").groupBy("column", "value")
    counts = counts.agg(F.count_if("in_train_").alias("seen"), F.count_if(~F.col("in_train_")).alias("later"))
    level, fresh = F.col("value").isNotNull(), F.col("value").isNotNull() & (F.col("seen") == 0)
    found = counts.groupBy("column").agg(
        F.count_if(level & (F.col("seen") > 0)).alias("in_train"), F.count_if(fresh).alias("only_later"),
        F.coalesce(F.sum(F.when(fresh, F.col("later"))), F.lit(0)).alias("later_rows"), F.sum("later").alias("all_later"),
    )
    return found.select("column", "in_train", "only_later", "later_rows", F.try_divide(F.col("later_rows").cast("double"), F.col("all_later")).alias("share"))
