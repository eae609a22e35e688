"""Drift references and reports, decay, retraining, and a registry of models."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.profile import FLOOR, bins_long

WARN, ALERT = 0.10, 0.20


class LabelsRefused(ValueError):
    """A drift job was handed labels."""


def psi_by_batch(reference: DataFrame, batches: DataFrame, edges: dict[str, list[float] | None], by: str = "batch") -> DataFrame:
    """by, column, psi of every batch against the reference: all columns and batches in one pass."""
    ref = bins_long(reference, edges).groupBy("column", "bin").agg(F.count("*").alias("n"))
    ref = ref.select("column", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy("column"))).alias("e"))
    cur = bins_long(batches, edges, by).groupBy(by, "column", "bin").agg(F.count("*").alias("n"))
    cur = cur.select(by, "column", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy(by, "column"))).alias("a"))
    grid = ref.select("column", "bin").unionByName(cur.select("column", "bin")).distinct().join(cur.select(by, "column").distinct(), "column")
    both = grid.join(ref, ["column", "bin"], "left").join(cur, [by, "column", "bin"], "left")
    e, a = F.greatest(F.coalesce("e", F.lit(0.0)), F.lit(FLOOR)), F.greatest(F.coalesce("a", F.lit(0.0)), F.lit(FLOOR))
    return both.groupBy(by, "column").agg(F.sum((a - e) * F.ln(a / e)).alias("psi"))


def alert_edges(in_control: DataFrame) -> DataFrame:
    """column, edge: the worst batch in control, but at least the alert level."""
    return in_control.groupBy("column").agg(F.greatest(F.max("psi"), F.lit(ALERT)).alias("edge"))


def held_out_counts(in_control: DataFrame, by: str = "batch") -> DataFrame:
    """by, n: columns that pass an edge set by the other batches. The worst of the others is the first or second worst."""
    w = Window.partitionBy("column").orderBy(F.desc("psi"), by)
    top = in_control.withColumn("rank", F.row_number().over(w))
    all_ = Window.partitionBy("column")
    others = F.when(F.col("rank") == 1, F.max(F.when(F.col("rank") == 2, F.col("psi"))).over(all_)).otherwise(F.max("psi").over(all_))
    return top.withColumn("past", F.col("psi") > F.greatest(F.coalesce(others, F.lit(0.0)), F.lit(ALERT))).groupBy(by).agg(F.count_if("past").alias("n"))


def drift_report(psis: DataFrame, edges: DataFrame, count_edge: int, by: str = "batch", quiet: str = "_te") -> DataFrame:
    """by, n_past, worst, drifted: more columns past their edges than any batch in control; encoded targets never alert."""
    if "label" in psis.columns:
        raise LabelsRefused("a drift report takes no labels")
    j = psis.join(edges, "column").withColumn("past", (F.col("psi") > F.col("edge")) & ~F.col("column").endswith(quiet))
    return j.groupBy(by).agg(F.count_if("past").alias("n_past"), F.max("psi").alias("worst")).withColumn("drifted", F.col("n_past") > count_edge)


def severity(psi):
    return F.when(psi > ALERT, "alert").when(psi > WARN, "warn").otherwise("stable")


def decay_flag(reference: float, current_high: float, tolerance: float) -> bool:
    """The metric fell by more than the tolerance, even at the top of its interval."""
    return current_high < reference - tolerance


def should_retrain(cycles: list[dict], consecutive: int = 2) -> bool:
    """The latest decay verdict decides; without one, so many drift alerts in a row up to now. A cycle without a batch breaks the row."""
    for c in reversed(cycles):
        if c.get("decay") is not None:
            return bool(c["decay"])
    run = 0
    for c in reversed(cycles):
        if not c.get("batch", True) or not c.get("drift"):
            break
        run += 1
    return run >= consecutive


def gate(champion: float, challenger: float, low: float, margin: float = 0.06) -> bool:
    """A challenger passes if it isn't worse by more than the margin at the low end of the difference."""
    return challenger >= champion or low >= -margin


class Registry:
    """Versions and aliases of models in one JSON file."""

    def __init__(self, path: str):
        self.path = Path(path)

    def _read(self) -> dict:
        return json.loads(self.path.read_text()) if self.path.exists() else {"versions": [], "aliases": {}, "history": []}

    def _write(self, x: dict) -> None:
        new = self.path.with_suffix(".new")
        new.write_text(json.dumps(x, allow_nan=False))
        new.replace(self.path)

    def register(self, where: str) -> int:
        x = self._read()
        x["versions"].append(where)
        self._write(x)
        return len(x["versions"])

    def promote(self, version: int, alias: str = "champion") -> None:
        x = self._read()
        if not 1 <= version <= len(x["versions"]):
            raise ValueError(f"no version {version}")
        x["history"].append([alias, x["aliases"].get(alias)])
        x["aliases"][alias] = version
        self._write(x)

    def rollback(self, alias: str = "champion") -> int:
        x = self._read()
        for i in range(len(x["history"]) - 1, -1, -1):
            if x["history"][i][0] == alias and x["history"][i][1]:
                x["aliases"][alias] = x["history"].pop(i)[1]
                self._write(x)
                return x["aliases"][alias]
        raise ValueError("nothing to go back to")

    def aliases(self) -> dict[str, int]:
        return self._read()["aliases"]
