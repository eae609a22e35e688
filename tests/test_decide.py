"""The decisions against brute force and tables worked out by hand."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import decide

ROWS = "split string, label int, day int, a string, b int"


def auc(scored):
    p, q = ([s for s, y in scored if y == side] for side in (1, 0))
    return sum((x > y) + (x == y) / 2 for x in p for y in q) / (len(p) * len(q)) if p and q else None


def encodings(rows, column, lag, m, split):
    at = {"a": 3, "b": 4}[column]
    train = [r for r in rows if r[0] == "train"]
    for r in rows:
        known = [t for t in train if t[2] <= r[2] - lag]
        if r[0] != split or r[at] is None or not known:
            continue
        own = [t for t in known if t[at] == r[at]]
        prior = sum(t[1] for t in known) / len(known)
        yield (sum(t[1] for t in own) + m * prior) / (len(own) + m), r[1]


def test_sweep_against_brute_force(spark):
    r = random.Random(3)
    rows = [("train" if d < 7 else "val" if d < 9 else "test", int(r.random() < 0.3), d, r.choice(["x", "y", "z", None]), r.choice([1, 2, None])) for d in range(10) for _ in range(30)]
    got = {(x.column, x.lag, x.smoothing): (x.train_auc, x.validation_auc) for x in decide.target_sweep(spark.createDataFrame(rows, ROWS), ["a", "b"], [0, 2], [1.0, 20.0]).collect()}
    assert len(got) == 8
    for c, lag, m in itertools.product("ab", (0, 2), (1.0, 20.0)):
        for value, split in zip(got[c, lag, m], ("train", "val")):
            assert value == pytest.approx(auc(list(encodings(rows, c, lag, m, split)))), (c, lag, m, split)


def test_sweep_of_nothing(spark):
    empty = decide.target_sweep(spark.createDataFrame([], ROWS), ["a", "b"], [0], [1.0])
    assert empty.count() == 0
    assert decide.choose_lag(empty, 1, 1).count() == 0
    one_class = spark.createDataFrame([("train", 0, 1, "x", None), ("val", 0, 2, "x", None)], ROWS)
    assert [(x.column, x.train_auc, x.validation_auc) for x in decide.target_sweep(one_class, ["a", "b"], [0], [1.0]).collect()] == [("a", None, None)]


SWEEP = "column string, lag int, smoothing double, train_auc double, validation_auc double"


def test_lag_with_a_gap_is_passed_over(spark):
    # lag 0 leaks in both columns, lag 1 differs from zero in neither direction, lag 7 too, but later
    rows = [("a", 0, 5.0, 0.9, 0.60), ("b", 0, 5.0, 0.9, 0.61), ("a", 1, 5.0, 0.61, 0.60), ("b", 1, 5.0, 0.59, 0.60), ("a", 7, 5.0, 0.56, 0.55), ("b", 7, 5.0, 0.54, 0.55)]
    got = {x.lag: x for x in decide.choose_lag(spark.createDataFrame(rows, SWEEP), 50, 500).collect()}
    assert [k for k, x in got.items() if x.chosen] == [1]
    assert {k: x.eligible for k, x in got.items()} == {0: False, 1: True, 7: True}
    assert got[0].gap == pytest.approx(0.295) and got[0].gap_half == pytest.approx(1.959963984540054 * 0.005)
    assert got[7].cost == pytest.approx(0.055)
    # so many rows resolve the cost of 7 and of 1 as well: none is left, so the largest is taken
    strict = {x.lag: x for x in decide.choose_lag(spark.createDataFrame(rows, SWEEP), 10**7, 10**7).collect()}
    assert [k for k, x in strict.items() if x.chosen] == [7] and not any(x.eligible for x in strict.values())


def test_smoothing(spark):
    rows = [("a", 1, 5.0, 0.7, 0.60), ("b", 1, 5.0, 0.7, 0.62), ("a", 1, 50.0, 0.7, 0.59), ("b", 1, 50.0, 0.7, 0.63), ("a", 1, 500.0, 0.7, 0.50), ("b", 1, 500.0, 0.7, 0.52), ("a", 2, 9.0, 0.7, 0.99)]
    got = {x.smoothing: x for x in decide.choose_smoothing(spark.createDataFrame(rows, SWEEP), 1).collect()}
    assert set(got) == {5.0, 50.0, 500.0}
    assert [k for k, x in got.items() if x.chosen] == [5.0]  # equal means: the least
    assert {k: x.within for k, x in got.items()} == {5.0: True, 50.0: True, 500.0: False}
    assert all(x.resolved for x in got.values())


def test_agreement(spark):
    models = spark.createDataFrame([("p", 0.8, 0.3), ("q", 0.7, 0.4), ("r", 0.7, 0.1)], "name string, roc_auc double, pr_auc double")
    got = {(x.a, x.b): (x.by_first, x.by_second, x.discordant) for x in decide.metric_agreement(models).collect()}
    assert got == {("p", "q"): (1, -1, True), ("p", "r"): (1, 1, False), ("q", "r"): (0, 1, True)}


def test_unseen_levels(spark):
    df = spark.createDataFrame([("train", "x"), ("train", None), ("val", "x"), ("val", "n"), ("test", "n"), ("test", None)], "split string, c string")
    got = decide.unseen_levels(df, ["c"], F.col("split") == "train").collect()
    assert [tuple(x) for x in got] == [("c", 1, 1, 2, 0.5)]
    only_train = decide.unseen_levels(df.filter("split = 'train'"), ["c"], F.col("split") == "train").collect()
    assert [tuple(x) for x in only_train] == [("c", 1, 0, 0, None)]
    assert decide.unseen_levels(df.limit(0), ["c"], F.col("split") == "train").count() == 0
