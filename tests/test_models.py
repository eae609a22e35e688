"""Splits, fits and synthetic rows against versions worked out in Python."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import challenge, correlate, encode, guards


def auc(score, label):
    p, q = score[label == 1], score[label == 0]
    return float(np.mean((p[:, None] > q[None, :]) + (p[:, None] == q[None, :]) / 2))


def logistic(x, y, rounds=60):
    """Maximum likelihood by Newton's steps."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-a @ w))
        w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a, a.T @ (y - p))
    return lambda z: 1 / (1 + np.exp(-np.c_[np.ones(len(z)), z] @ w))


@pytest.fixture(scope="module")
def sample():
    r = np.random.default_rng(7)
    x = r.normal(size=(600, 2))
    y = (r.random(600) < 1 / (1 + np.exp(1 - x[:, 0] + 0.5 * x[:, 1]))).astype(int)
    return pd.DataFrame({"id": range(600), "ts": range(600), "u": x[:, 0], "v": x[:, 1], "label": y})


def test_random_split(spark):
    df = spark.range(20_000).withColumnRenamed("id", "key")
    first = guards.random_split(df, "key")
    got = {x.split: x["count"] for x in first.groupBy("split").count().collect()}
    for split, share in (("train", 0.7), ("val", 0.15), ("test", 0.15)):
        assert abs(got[split] - share * 20_000) < 5 * math.sqrt(share * (1 - share) * 20_000)
    # the same whatever the partitions, equal keys together, another seed another split
    again = guards.random_split(df.union(df).repartition(13), "key")
    assert again.groupBy("key").agg(F.count_distinct("split").alias("n")).filter("n > 1").isEmpty()
    assert first.exceptAll(again).isEmpty()
    assert not first.exceptAll(guards.random_split(df, "key", seed=1)).isEmpty()


def test_logistic_against_newton(spark, sample):
    cut = sample.ts < 400
    want = logistic(sample[cut][["u", "v"]].to_numpy(), sample[cut].label.to_numpy())(sample[~cut][["u", "v"]].to_numpy())
    df = spark.createDataFrame(sample)
    got = correlate.fit_and_score(df.filter("ts < 400"), df.filter("ts >= 400"), ["u", "v"]).orderBy("id").toPandas()
    assert list(got.id) == list(sample[~cut].id) and list(got.label) == list(sample[~cut].label)
    assert got.score.to_numpy() == pytest.approx(want, abs=0.01)


def test_search_against_newton(spark, sample):
    got = {(x.penalty, x.fold): x.roc_auc for x in challenge.search(spark.createDataFrame(sample), ["u", "v"], [0.0, 50.0], 2).collect()}
    assert set(got) == {(c, i) for c in (0.0, 50.0) for i in (0, 1)}
    edges = [0, *[math.floor(np.quantile(sample.ts, q)) for q in (1 / 3, 2 / 3)], 600]
    for i in (0, 1):
        fit, held = sample[sample.ts < edges[i + 1]], sample[(sample.ts >= edges[i + 1]) & (sample.ts < edges[i + 2])]
        want = auc(logistic(fit[["u", "v"]].to_numpy(), fit.label.to_numpy())(held[["u", "v"]].to_numpy()), held.label.to_numpy())
        assert got[0.0, i] == pytest.approx(want, abs=0.01)


def test_adversarial_tells_sides_apart_only_where_they_differ(spark):
    r = np.random.default_rng(5)
    side = lambda start, shift: spark.createDataFrame(pd.DataFrame({"id": range(start, start + 400), "x": r.normal(size=400) + shift, "z": r.normal(size=400)}))
    a, same, other = side(0, 0.0), side(1000, 0.0), side(2000, 2.0)
    alike = {x.fold: x.roc_auc for x in challenge.adversarial(a, same, ["x", "z"], 2).collect()}
    apart = {x.fold: x.roc_auc for x in challenge.adversarial(a, other, ["x", "z"], 2).collect()}
    assert set(alike) == set(apart) == {-1, 0, 1}
    assert all(abs(v - 0.5) < 0.1 for v in alike.values())
    # two normals two deviations apart: no order does better than 0.921
    assert all(0.86 < v < 0.96 for v in apart.values())


@pytest.mark.parametrize("positives", [1, 3, 12])
def test_smote_against_brute_force(spark, positives):
    r = random.Random(2)
    rows = [(i, r.random(), r.random(), int(i < positives)) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double, label int")
    made = encode.smote(df, ["x", "y"], k=5).collect()
    at = {i: (x, y) for i, x, y, label in rows if label}
    each = math.ceil((40 - 2 * positives) / positives)
    assert len(made) == (positives * each if positives > 1 else 0)
    assert len({(m.from_id, m.draw) for m in made}) == len(made)
    for m in made:
        p, q = at[m.from_id], at[m.to_id]
        near = sorted((j for j in at if j != m.from_id), key=lambda j: (sum((a - b) ** 2 for a, b in zip(p, at[j])), j))[:5]
        assert m.to_id in near
        shares = [(c - a) / (b - a) for a, b, c in zip(p, q, m.point)]
        assert shares[0] == pytest.approx(shares[1]) and 0 <= shares[0] < 1


def test_smote_of_balanced_classes(spark):
    df = spark.createDataFrame([(i, float(i), i % 2) for i in range(6)], "id bigint, x double, label int")
    assert encode.smote(df, ["x"]).count() == 0
    assert encode.smote(df.limit(0), ["x"]).count() == 0


def test_smote_neighbours_in_blocks(spark, monkeypatch):
    """Neighbours over many blocks, with equal points, a missing coordinate and large offsets; few rows leave a pair of blocks."""
    monkeypatch.setattr(encode, "BLOCK", 8)
    r = random.Random(5)
    rows = [(i, [1e6 + r.randrange(4), r.randrange(4) / 3], i % 2) for i in range(60)]
    made = encode.nearest(spark.createDataFrame([*rows, (60, [None, 1.0], 0)], "a bigint, p array<double>, bucket bigint"), 3)
    got = {(x.a, x.b) for x in made.collect()}
    want = {(i, j) for i, p, b in rows for _, j in sorted((sum((x - y) ** 2 for x, y in zip(p, q)), j) for j, q, c in rows if c == b and j != i)[:3]}
    assert got == want
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroups" in plan and "NOT (a#" not in plan  # no join of rows with rows
