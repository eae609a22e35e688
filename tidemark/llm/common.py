"""Helpers shared by the corpus operators: staging, checked broadcasts, row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import new_path, shared_dir, ship  # noqa: F401

#: Rows up to which a side may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write once to the shared folder and read back: lineage ends here, so a lost executor costs no recomputation.

    ``batch``: rows of an Arrow batch while it is written. The shuffles of the write are removed with it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if batch:
        small_batches(spark, batch)
    old = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, old)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*staged: DataFrame) -> None:
    """Remove staged tables that nothing will read again."""
    for df in staged:
        for file in df.inputFiles()[:1]:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only for a side whose counted rows stay within ``limit``."""
    return F.broadcast(df) if rows <= limit else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(df: DataFrame, size: int = 64 << 20) -> int:
    """Partitions that grow with the table: one for each ``size`` bytes of its files, the session's number at least.

    A table without files, or of a plan whose size the optimizer can't tell, gets the session's number.
    """
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(df.sparkSession), -(-estimate // size) if estimate < 1 << 50 else 0)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Before Python code runs: the package is there, and the Arrow batches handed to it are small, as texts may be long."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside one expression and return ``body(value)``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_python(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow``, with the package on its way to the workers first."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
