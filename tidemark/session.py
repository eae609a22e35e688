"""A session with the settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew-join handling, UTC, Arrow; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": os.environ.get("TIDEMARK_UI", "false"),
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return b.config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once for each context, wherever the driver found it."""
    import atexit
    import shutil
    import tempfile
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    top, made = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="tidemark-code-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)  # the driver serves the file as long as it runs
    file = Path(made) / "tidemark.zip"
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"tidemark/{p.relative_to(top)}")
    sc.addPyFile(str(file))
    sc._tidemark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local session, where driver and executors are one process, may go without it.
    """
    import tempfile

    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """A file or folder, wherever Spark keeps it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
