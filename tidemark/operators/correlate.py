"""Ranks, correlations, trends and the grouping of redundant columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.operators.profile import long


def ranks(df: DataFrame, columns: list[str], row: str = "id") -> DataFrame:
    """row, column, value, rank: average ranks among the values that are there.

    Counts by distinct value are cumulated and joined back, so a tie group is one row of the window.
    """
    rows = long(df, columns, row).filter("value is not null")
    counts = rows.groupBy("column", "value").agg(F.count("*").alias("n"))
    placed = ordered.running(counts, "value", "n", by=("column",))
    placed = placed.select("column", "value", (F.col("upto_n") - (F.col("n") - 1) / 2.0).alias("rank"))
    return rows.join(placed, ["column", "value"])


def spearman(df: DataFrame, columns: list[str], row: str = "id") -> DataFrame:
    """a, b, n, rho over rows where both are there, with ranks taken once per column.

    Each row gives its pairs of ranks to one aggregate by pair, which adds them up before the exchange, so the plan has the same
    size for any number of columns.
    """
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column"))
    held = ranks(df, columns, row).groupBy(row).agg(F.collect_list(F.struct(place.alias("i"), "rank")).alias("held"))  # a rank a column
    first = held.select("held", F.explode("held").alias("x"))
    both = first.select("x", F.explode(F.filter("held", lambda y: y.i > F.col("x.i"))).alias("y"))
    found = both.groupBy(F.col("x.i").alias("i"), F.col("y.i").alias("j")).agg(F.count("*").alias("n"), F.corr("x.rank", "y.rank").alias("rho"))
    named = [(i, j, a, b) for i, a in enumerate(columns, 1) for j, b in enumerate(columns[i:], i + 1)]
    pairs = df.sparkSession.createDataFrame(named, "i bigint, j bigint, a string, b string")
    return pairs.join(found, ["i", "j"], "left").select("a", "b", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "rho")


def exact_spearman(df: DataFrame, a: str, b: str, row: str = "id") -> DataFrame:
    """Ranks taken again among the rows where both are there."""
    return spearman(df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()), [a, b], row)


def screened(pairs: DataFrame, least: float = 0.8) -> DataFrame:
    return pairs.filter(F.abs("rho") >= least)


def correlated_groups(pairs: list[tuple[str, str, float]], priority: list[str], least: float = 0.95) -> dict[str, str]:
    """column -> the column that stands for it. Greedy in order of priority; being alike isn't passed on."""
    alike = {(a, b) for a, b, r in pairs if abs(r) >= least} | {(b, a) for a, b, r in pairs if abs(r) >= least}
    stands: dict[str, str] = {}
    for c in priority:
        if c not in stands:
            stands[c] = c
            for d in priority:
                if d not in stands and (c, d) in alike:
                    stands[d] = c
    return stands


def trend(df: DataFrame, period: str = "period", label: str = "label") -> DataFrame:
    """Least squares slope of the rate over periods, Kendall's tau-b and the chi-square of homogeneity. Pairs are of periods."""
    p = df.groupBy(F.col(period).alias("t")).agg(F.count("*").cast("double").alias("n"), F.sum(label).cast("double").alias("k")).withColumn("r", F.col("k") / F.col("n"))
    line = p.agg(F.regr_slope("r", "t").alias("slope"), F.regr_r2("r", "t").alias("r2"), F.count("*").alias("periods"))
    q = p.select(F.col("t").alias("u"), F.col("r").alias("s"))
    pair = p.join(q, F.col("t") < F.col("u")).agg(F.sum(F.signum(F.col("s") - F.col("r"))).alias("d"), F.count("*").cast("double").alias("pairs"), F.count_if(F.col("s") == F.col("r")).alias("tied"))
    tau = pair.select(F.try_divide(F.col("d"), F.sqrt(F.col("pairs") * (F.col("pairs") - F.col("tied")))).alias("tau"))
    total = p.agg(F.sum("n").alias("nn"), F.sum("k").alias("kk"))
    rate = F.col("kk") / F.col("nn")
    chi = p.crossJoin(F.broadcast(total)).agg(F.sum((F.col("k") - F.col("n") * rate) ** 2 / (F.col("n") * rate * (1 - rate))).alias("chi2"))
    return line.crossJoin(F.broadcast(tau)).crossJoin(F.broadcast(chi))  # one row each


def linear_models(features: list[str], label: str = "label"):
    """The three families by name, unfitted."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier

    common = {"featuresCol": "features", "labelCol": label}
    return {"logistic": LogisticRegression(**common, maxIter=50), "forest": RandomForestClassifier(**common, seed=42, numTrees=20), "boosted": GBTClassifier(**common, seed=42, maxIter=10)}


def fit_and_score(train: DataFrame, test: DataFrame, features: list[str], family: str = "logistic", row: str = "id", label: str = "label") -> DataFrame:
    """id, label, score of the test rows. Nulls must be filled before."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    pack = VectorAssembler(inputCols=features, outputCol="features")
    model = linear_models(features, label)[family].fit(pack.transform(train))
    return model.transform(pack.transform(test)).select(row, label, F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
