"""Invariants and brute-force versions of the operators that SQL oracles don't reach."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.functions import scalar
from tidemark.operators import causal, challenge, checks, correlate, encode, evaluate, graph, guards, monitor, ordered, prepare, profile
from tidemark.sources import csv
from tidemark.streaming import online

COLUMNS = "id bigint, ts bigint, entity bigint, card bigint, amount double, product string, device string, browser bigint, addr1 bigint, addr2 bigint, dist double, tenure bigint, label int"
HOUR = 3_600_000_000


def stream(n=400, seed=1):
    r = random.Random(seed)
    pick = lambda *x: r.choice(x)
    return [(i, r.randrange(60) * HOUR, r.randrange(12), r.randrange(4), pick(25.0, 68.95, 117.0), pick("W", "C"), pick("a", "b", None), pick(1, 2, None), pick(1, 2, 3, None), pick(1, 2, None), pick(1.0, 3.0, None, 60.0), pick(1, 2, None), r.randrange(5) // 4) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    return stream()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1000
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_truncation(frame):
    """A feature doesn't move when later rows come, and ties never see each other."""
    cut = 30 * HOUR
    whole = causal.build(frame, [1.0, 10.0]).filter(F.col("ts") < cut)
    part = causal.build(frame.filter(F.col("ts") < cut), [1.0, 10.0])
    assert whole.exceptAll(part).isEmpty() and part.exceptAll(whole).isEmpty()
    shuffled = causal.build(frame.orderBy(F.rand(3)).repartition(7), [1.0, 10.0])
    again = causal.build(frame, [1.0, 10.0])
    cols = [c for c in again.columns if not c.startswith(("amt_", "vel_amount"))]
    assert shuffled.select(cols).exceptAll(again.select(cols)).isEmpty()
    with pytest.raises(ValueError):
        causal.build(frame, None, ("geography",))
    with pytest.raises(ValueError):
        causal.build(frame, families=("unknown",))
    names = {f.name for f in causal.catalogue()}
    assert names <= set(again.columns)


def test_chunks(frame):
    plain = frame.select("id", F.count("*").over(causal.trail(24 * HOUR, "card")).alias("n"))
    assert plain.exceptAll(causal.velocity_by_chunks(frame, "card", 24 * HOUR).select("id", "n")).isEmpty()


def test_guards(spark, frame):
    with pytest.raises(guards.TrainOnlyError):
        guards.assert_train_only(frame, 10)
    with pytest.raises(guards.TrainOnlyError):
        guards.assert_train_only(frame.limit(0), 10)
    with pytest.raises(guards.TrainOnlyError):
        guards.assert_train_only(frame.drop("ts"), 10)
    with pytest.raises(guards.TrainOnlyError):
        guards.assert_train_only(frame.withColumn("ts", F.lit(None).cast("bigint")), 10)
    with pytest.raises(guards.TrainOnlyError):
        encode.fit_imputer(frame, ["dist"], boundary=0)
    a, b = guards.boundaries(frame)
    parts = guards.time_split(frame, a, b)
    assert sum(p.count() for p in parts) == frame.count()
    with pytest.raises(guards.MaturityError):
        guards.assert_mature(spark.createDataFrame([(10,)], "e int"), "e", 5, 14, 1)
    assert guards.challenger_windows(100, 10, 20, 30, 1) == {"gate": (90, 100), "calibrate": (70, 90), "fit": (40, 70)}
    assert guards.window_filter(frame, (0, HOUR)).filter("ts > 0").isEmpty()


def test_components(spark, rows, frame):
    made = {r.id: r for r in graph.incremental_components(frame.withColumn("day", F.expr(f"ts div {24 * HOUR}")), ["entity", "addr1"], 1).collect()}
    for i in range(0, len(rows), 9):
        _, t, entity = rows[i][:3]
        before = [r for r in rows if r[1] < t]
        group, nodes = set(), {("e", entity)} if any(r[2] == entity for r in before) else set()
        while True:
            more = {r[0] for r in before if ("e", r[2]) in nodes or (r[8] is not None and ("a", r[8]) in nodes)}
            if more == group:
                break
            group = more
            nodes |= {("e", rows[k][2]) for k in group} | {("a", rows[k][8]) for k in group if rows[k][8] is not None}
        day = t // (24 * HOUR)
        labelled = [k for k in group if rows[k][1] // (24 * HOUR) + 1 <= day]
        assert (made[i].component_size, made[i].n_labelled, made[i].n_positive) == (len(group), len(labelled), sum(rows[k][12] for k in labelled))


def test_static_components(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = [(i, f"a{i // 2}", f"b{(i + 1) // 2}" if i < 20 else None) for i in range(30)]
    made = {r.id: r.component for r in graph.static_components(spark.createDataFrame(rows, "id bigint, x string, y string"), ["x", "y"]).collect()}
    assert made == {i: 0 if i < 20 else i // 2 * 2 for i in range(30)}
    s = graph.component_summary(spark.createDataFrame(list(made.items()), "id bigint, component bigint")).first()
    assert (s.components, s.giant) == (6, 20)


def test_online_store(spark, rows, frame, tmp_path):
    """Batch frames, the replayed store and the streaming store over split micro-batches agree row for row."""
    batch = causal.with_first_marks(frame, "entity", "device")
    seen = causal.running_distinct("device", "entity")
    cols = causal.recency() | causal.amount() | causal.velocity("entity") | {"seen": seen, "new": causal.novel("device", "entity", seen)}
    want = batch.select("id", *[c.alias(n) for n, c in cols.items()]).toPandas().set_index("id")
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])
    alone = online.replay(pdf).set_index("id")
    ordered = pdf.sort_values(["ts", "id"])
    import os
    import time

    for k, at in enumerate(range(0, len(ordered), 70)):
        part = ordered.iloc[at : at + 70][["id", "ts", "amount", "device", "entity"]]
        part.to_json(tmp_path / f"{k}.json", orient="records", lines=True)
        os.utime(tmp_path / f"{k}.json", (time.time() - 1000 + k, time.time() - 1000 + k))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = spark.readStream.schema("id bigint, ts bigint, amount double, device string, entity bigint").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    q = online.features(src).writeStream.format("memory").queryName("online").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    live = spark.table("online").toPandas().set_index("id")
    assert len(live) == len(want)
    pairs = {"prior_count": "rec_prior_count", "since_prev": "rec_since_prev", "amt_mean": "amt_mean", "amt_std": "amt_std", "n_distinct_device": "seen", "device_is_new": "new"}
    pairs |= {f"count_{w}": f"vel_count_{w}_entity" for w in causal.WINDOWS} | {f"sum_{w}": f"vel_amount_sum_{w}_entity" for w in causal.WINDOWS}
    for got in (alone, live):
        assert not got["late"].any()
        for mine, theirs in pairs.items():
            for i in want.index:
                a, b = got.at[i, mine], want.at[i, theirs]
                assert pd.isna(a) == pd.isna(b) and (pd.isna(a) or math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=1e-6)), (mine, i, a, b)
    s = online.fresh()
    online.step(s, 1, "k", 100, 1.0, None)
    assert online.step(s, 2, "k", 50, 1.0, None)[2] is True



@pytest.mark.parametrize("text,device,browser", [("SM-J700M Build/MMB29K", "sm", None), ("rv:57.0", "rv", None), ("Trident/7.0", "trident", None), (" Windows ", "windows", None), ("", None, None), ("12", "other", None), ("chrome 63.0 for android", None, "chrome|android"), ("safari generic", None, "safari|none"), ("65.0", None, "unknown|none")])
def test_normalise(spark, text, device, browser):
    row = spark.createDataFrame([(text,)], "t string").select(scalar.normalise_device(F.col("t")).alias("d"), scalar.normalise_browser(F.col("t")).alias("b")).first()
    assert device is None and text or row.d == device
    assert browser is None or row.b == browser


def test_metrics(spark):
    r = random.Random(3)
    rows = [(i, r.randrange(20) / 20, int(r.random() < 0.3)) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, score double, label int")
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert evaluate.roc_auc(df).first()[0] == pytest.approx(auc)
    ap = last = 0.0
    for t in sorted({s for _, s, _ in rows}, reverse=True):
        hit = [y for _, s, y in rows if s >= t]
        ap += (sum(hit) / len(pos) - last) * sum(hit) / len(hit)
        last = sum(hit) / len(pos)
    assert evaluate.average_precision(df).first()[0] == pytest.approx(ap)
    sizes = {x.bin: x.n for x in evaluate.reliability(df.limit(497), 10).collect()}
    assert [sizes[b] for b in range(10)] == [50] * 7 + [49] * 3
    draws = evaluate.bootstrap(df, 200)
    low, high = evaluate.interval(draws, "recall").select("low", "high").first()
    recall = sum(s >= 0.5 for s in pos) / len(pos)
    assert low < recall < high and high - low < 0.2
    same = evaluate.paired_difference(draws, draws, "recall").first()
    assert same.mean == 0 and same.low == same.high == 0
    with pytest.raises(ValueError):
        evaluate.cost_edges(1, 0, 1)
    fitted = evaluate.isotonic(df).transform(df.select("score", F.col("score").alias("features"))).groupBy("score").agg(F.first("prediction").alias("p")).orderBy("score").collect()
    assert all(a.p <= b.p for a, b in zip(fitted, fitted[1:], strict=False))


def test_preparation(spark, frame):
    far = 10**18
    contract = [r.asDict() for r in encode.declare(frame, ["amount", "dist", "device", "ts"]).collect()]
    good = frame.select("amount", "dist", "device", "ts")
    assert encode.validate(good, contract) == []
    bad = good.withColumn("amount", F.lit(None).cast("double")).drop("ts").withColumn("more", F.lit(1))
    assert len(encode.validate(bad, contract)) == 3
    plan = encode.column_plan([{"column": "a", "top_share": 0.99, "missing": 0.99}, {"column": "b", "auc": 0.4}, {"column": "c", "top_share": 0.99, "iv": 0.5}, {"column": "d", "duplicate_of": "c"}])
    assert [p["reason"] for p in plan] == ["constant", "unstable", None, "redundant"] and plan[0]["also_matched"] == ["missing"]
    made = encode.smote(frame, ["amount", "dist", "tenure"], k=3).collect()
    pos = frame.filter("label = 1").count()
    assert len(made) == pos * math.ceil((frame.count() - 2 * pos) / pos) and all(m.from_id != m.to_id for m in made)
    hot = encode.one_hot(frame, "product", ["W", "C"]).agg(F.sum(F.col("product=W") + F.col("product=C"))).first()[0]
    assert hot == frame.count()
    v = encode.fit_vocabulary(frame, ["device"], boundary=far)
    tokens = {r[0] for r in encode.apply_vocabulary(frame.withColumn("device", F.when(F.col("id") < 5, "new").otherwise(F.col("device"))), v, ["device"]).select("device_cat").distinct().collect()}
    assert tokens == {"a", "b", "(unseen)", "(missing)"}
    same = encode.target_encode(frame.withColumn("day", F.expr(f"ts div {24 * HOUR}")), "addr1", F.col("ts") < 30 * HOUR, 1, 5.0).select("id", "addr1_te")
    flipped = encode.target_encode(frame.withColumn("day", F.expr(f"ts div {24 * HOUR}")).withColumn("label", F.when(F.col("ts") < 30 * HOUR, F.col("label")).otherwise(1 - F.col("label"))), "addr1", F.col("ts") < 30 * HOUR, 1, 5.0).select("id", "addr1_te")
    assert same.exceptAll(flipped).isEmpty()


def test_statistics(spark, frame):
    assert correlate.correlated_groups([("a", "b", 0.99), ("b", "c", 0.99)], ["a", "b", "c"]) == {"a": "a", "b": "a", "c": "c"}
    z = scalar.normal_tail(1.959963984540054)
    assert z == pytest.approx(0.05)
    pdf = frame.toPandas()
    for r in correlate.spearman(frame, ["amount", "dist", "tenure"]).collect():
        both = pdf[[r.a, r.b]].rank().dropna()
        assert r.n == len(both) and r.rho == pytest.approx(both[r.a].corr(both[r.b]))
    c = profile.compare(frame, frame.withColumn("amount", F.col("amount") + (F.col("id") == 3).cast("int")), ["amount"]).first()
    assert (c.worst, c.n_beyond, c.n_null_mismatch) == (1.0, 1, 0)
    assert profile.fingerprint(frame).first() == profile.fingerprint(frame.repartition(9)).first()
    clock = profile.clock_profile(spark.createDataFrame([(1, 0), (2, 12), (3, 18), (4, 6)], "id bigint, ts bigint")).first()
    assert (clock.step, clock.n_back, clock.monotone, clock.span) == (6, 1, False, 18)


def test_monitoring(spark, tmp_path):
    assert monitor.should_retrain([{"drift": True}, {"drift": True}]) and not monitor.should_retrain([{"drift": True}, {"batch": False}, {"drift": True}])
    assert not monitor.should_retrain([{"drift": True}, {"drift": True}, {"decay": False}])
    assert monitor.decay_flag(0.6, 0.5, 0.06) and not monitor.decay_flag(0.6, 0.55, 0.06)
    assert monitor.gate(0.5, 0.49, -0.05) and not monitor.gate(0.5, 0.3, -0.25)
    r = monitor.Registry(str(tmp_path / "r.json"))
    one, two = r.register("a"), r.register("b")
    r.promote(one)
    r.promote(two)
    assert r.aliases() == {"champion": 2} and r.rollback() == 1
    with pytest.raises(ValueError):
        r.rollback()
    with pytest.raises(monitor.LabelsRefused):
        monitor.drift_report(spark.createDataFrame([("a", 1.0, 1)], "column string, psi double, label int"), None, 0)


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("TransactionID,isFraud,TransactionDT,TransactionAmt,ProductCD,card1,addr1,M1\n1,0,86400,68.95,W,1000,,T\n2,1,86401,10.0,C,1001,3,\n")
    (tmp_path / "i.csv").write_text("TransactionID,id_01,id_31\n2,-5,safari generic\n")
    t, i = str(tmp_path / "t.csv"), str(tmp_path / "i.csv")
    df = csv.load(spark, t, i)
    assert dict(df.dtypes) | {} == {"TransactionID": "bigint", "isFraud": "tinyint", "TransactionDT": "bigint", "TransactionAmt": "double", "ProductCD": "string", "card1": "int", "addr1": "float", "M1": "string", "id_01": "float", "id_31": "string"}
    assert df.orderBy("TransactionID").collect()[0].id_31 is None and df.count() == 2
    assert csv.load(spark, t, i, ["card1", "nothing"]).columns == ["TransactionID", "card1"]
    csv.write_by_split(df.withColumn("split", F.lit("train")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError):
        csv.to_json([{"x": float("nan")}], str(tmp_path / "x.json"))


def test_plans(frame):
    """One exchange per grain: windows of a key and of (key, value) share it."""
    plan = frame.select("id", *[c.alias(n) for n, c in (causal.velocity("entity") | causal.recency() | causal.amount()).items()])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_prepared_frames(spark, frame):
    cut = 40 * HOUR
    train = frame.filter(F.col("ts") < cut)
    recipe = prepare.Recipe(origins=("tenure",), texts={"device": scalar.normalise_device}, indicators={"d": "dist"}, levels=("product",), counts=("card",), least_levels=1, targets=("addr1",), blocks={"b": ["dist"]}, clipped=("amount",))
    fitted = prepare.fit_preparation(train, recipe, cut)
    out = prepare.apply_preparation(frame, fitted)
    assert out.columns == sorted(out.columns) and "dist" not in out.columns and "tenure" not in out.columns
    assert out.count() == frame.count()
    # What comes at or after the boundary changes neither the fit nor an encoded value.
    flipped = frame.withColumn("label", F.when(F.col("ts") < cut, F.col("label")).otherwise(1 - F.col("label")))
    same = prepare.apply_preparation(flipped, fitted)
    assert out.select("id", "addr1_te").exceptAll(same.select("id", "addr1_te")).isEmpty()
    with pytest.raises(guards.TrainOnlyError):
        prepare.fit_preparation(frame, recipe, cut)
    done = prepare.apply_complete(frame, prepare.fit_complete(train, ["dist"], ["tenure"], ["dist"], ["product"], boundary=cut))
    assert done.columns == ["id", "dist", "tenure", "dist_missing", "tenure_missing", "product=C", "product=W"]
    assert done.filter(F.greatest(*[F.col(f"`{c}`").isNull() for c in done.columns])).isEmpty()
    mean = done.join(train.select("id"), "id").agg(F.avg("dist"), F.stddev_pop("dist")).first()
    assert abs(mean[0]) < 1e-9 and abs(mean[1] - 1) < 1e-9
    codes = prepare.fit_levels(train.filter("device = 'b' or device is null"), ["device"], boundary=cut)
    tree = {r.id: r.device for r in prepare.tree_matrix(frame, [], ["device"], codes).collect()}
    assert all(tree[r.id] == (0.0 if r.device == "b" else None) for r in frame.select("id", "device").collect())


def test_time_checks(spark, rows, frame):
    early, late_ = frame.filter(F.col("ts") < 30 * HOUR), frame.filter(F.col("ts") >= 30 * HOUR)

    def auc(pairs):
        p, q = [s for s, y in pairs if y], [s for s, y in pairs if not y]
        return sum((a > b) + (a == b) / 2 for a in p for b in q) / (len(p) * len(q))

    a, b = [r for r in rows if r[1] < 30 * HOUR], [r for r in rows if r[1] >= 30 * HOUR]
    rate = {k: sum(r[12] for r in a if r[6] == k) / sum(r[6] == k for r in a) for k in {r[6] for r in a}}
    got = challenge.time_consistency(early, late_, [], ["device"]).first()
    assert got.early_auc == pytest.approx(auc([(rate[r[6]], r[12]) for r in a])) and got.late_auc == pytest.approx(auc([(rate[r[6]], r[12]) for r in b]))
    one = challenge.single_column_auc(early, late_, ["dist", "amount"]).filter("column = 'dist'").first().auc
    assert one == pytest.approx(auc([(-1 if r[10] is None else r[10], r[1] >= 30 * HOUR) for r in rows]))
    assert challenge.single_column_auc(early.withColumn("dist", F.lit(1.0)), late_.withColumn("dist", F.lit(1.0)), ["dist"]).first().auc is None
    for r in challenge.rate_bootstrap(frame, 100, "product").collect():
        assert r.low <= r.rate <= r.high
    table = {(r.days, r.treatment): r for r in challenge.label_latency(frame, [0, 1], 24 * HOUR).collect()}
    assert table[0, "immature"].rate == table[0, "excluded"].rate == table[0, "excluded"].true_rate
    assert table[1, "immature"].n == len(rows) and table[1, "excluded"].n == sum(r[1] < max(x[1] for x in rows) - 24 * HOUR for r in rows)
    with pytest.raises(guards.MaturityError):
        challenge.performance(guards.batch_index(frame.withColumn("score", F.lit(0.5)), 1, 24 * HOUR), 0.5, 24 * HOUR, 30, 24 * HOUR)


def test_checks(spark, rows, frame):
    kinds = checks.entity_stats(frame, "entity", "addr1", "dist").first()
    groups = {k: [r[12] for r in rows if r[2] == k] for k in {r[2] for r in rows}}
    assert kinds.entities == len(groups) and kinds.mixed == sum(0 < sum(g) < len(g) for g in groups.values())
    assert kinds.null_part_rows == sum(r[8] is None or r[10] is None for r in rows)
    warm = checks.coverage(frame.withColumn("split", F.lit("x")), ["addr1"]).first()
    assert warm.n_cold == sum(r[8] is None or not any(q[8] == r[8] and q[1] < r[1] for q in rows) for r in rows)
    broken = checks.impossible(frame, {"dist": F.col("dist") > 3}).first()
    assert broken.n == sum(r[10] is not None and r[10] > 3 for r in rows)
    assert {r.state for r in checks.agreement(frame, "browser", "addr2").collect()} == {"same", "differs", "one_missing", "both_missing"}
    assert checks.concentration(frame, "device", 1).first().top_share == pytest.approx(max(sum(r[6] == k for r in rows) for k in "ab") / sum(r[6] is not None for r in rows))


def test_column_helpers(spark, frame):
    from tidemark.operators import columns

    with pytest.raises(ValueError):
        columns.attach(frame, {"x": F.lit(1), "X": F.lit(2)})
    with pytest.raises(KeyError):
        columns.apply_plan(frame, {"nowhere": "drop"})
    with pytest.raises(KeyError):
        columns.select_groups(frame, {"a": ("addr*",)}, ["b"])
    with pytest.raises(ValueError):
        columns.label_source(frame, -1, 24 * HOUR)
    assert columns.group_of("addr2", {"amounts": ("amount",), "address": ("addr*",)}) == "address" and columns.group_of("x", {}) is None
    assert columns.permitted(["b", "a", "c"], ["a", "b"], ["b"]) == ["a"]
    assert columns.symmetric_difference(frame, frame).isEmpty()


def test_codes_follow_the_values(spark, frame, rows):
    from tidemark.operators import columns

    first = lambda v: (v is not None, v if v is not None else 0)
    levels = sorted({(r[8], r[9]) for r in rows}, key=lambda x: tuple(map(first, x)))
    for r in columns.codes(frame, ["addr1", "addr2"], "code").collect():
        assert r.code == levels.index((r.addr1, r.addr2))
    some = [x for x in levels if x != (None, None)]
    for r in columns.codes(frame, ["addr1", "addr2"], "code", null_level=False).collect():
        assert r.code == (some.index((r.addr1, r.addr2)) if (r.addr1, r.addr2) in some else -1)


def test_screen_against_pandas(spark, rows, frame):
    from tidemark.operators import correlate

    names = ["amount", "dist", "addr1", "tenure"]
    table = pd.DataFrame(rows, columns=[x.split()[0] for x in COLUMNS.split(", ")])[names].astype(float)
    ranks = table.rank()
    for r in correlate.spearman(frame, names).collect():
        both = ranks[[r.a, r.b]].dropna()
        assert r.n == len(both) and r.rho == pytest.approx(both[r.a].corr(both[r.b]))


@pytest.mark.parametrize("parts", [2, 7, 256])
def test_sums_and_percentiles_over_slices(spark, parts):
    r = random.Random(parts)
    rows = [(r.choice(["a", "b", None]), r.choice([0.0, 0.0, None, round(r.gauss(0, 50), 1)])) for _ in range(900)]
    df = spark.createDataFrame(rows, "k string, v double")
    counts = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    for down in (False, True):
        found = {(x.k, x.v): (x.upto_n, x.all_n) for x in ordered.running(counts, "v", "n", by=("k",), down=down, parts=parts).collect()}
        low = float("-inf")
        for (k, v), got in found.items():
            own = [low if y is None else y for x, y in rows if x == k]
            at = low if v is None else v
            assert got == (sum(y >= at if down else y <= at for y in own), len(own))
    qs = [0.0, 0.013, 0.5, 0.95, 1.0]
    got = {x.k: list(x.q) for x in ordered.percentiles(df, qs, "k", value="v").collect()}
    for k in ("a", "b", None):
        assert got[k] == pytest.approx(list(np.quantile([v for x, v in rows if x == k and v is not None], qs)))


def test_slices_of_nothing(spark):
    none = spark.createDataFrame([], "k string, v double")
    assert ordered.percentiles(none, [0.5], "k", value="v").collect() == [] == guards.boundaries(none, "v")
    assert ordered.percentiles(none.select("v"), [0.5], value="v").collect() == []
    nulls = spark.createDataFrame([("a", None), ("a", None)], "k string, v double")
    assert ordered.percentiles(nulls, [0.5], "k", value="v").collect() == []
    assert profile.quantile_edges(nulls, ["v"]) == {"v": []}


def test_no_task_holds_a_whole_order(spark):
    """Every window over a table with a row per value has a slice among its keys."""
    scores = spark.range(5000).select((F.col("id") % 997 / 997).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    plan = evaluate.curve(scores)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert sum("slice_" in x for x in windows) >= 2 and len(windows) <= 4
    sizes = ordered.running(evaluate.by_score(scores), "score", "n").withColumn("slice", ordered.slice_of(F.col("score"), ordered.cuts(scores, "score")))
    assert sizes.groupBy("slice").count().agg(F.max("count")).first()[0] <= 8


def test_isotonic_against_pooling(spark):
    r = random.Random(8)
    rows = [(i / 60, int(r.random() < i / 60)) for i in range(60)]
    blocks = []
    for s, y in rows:  # pool adjacent violators
        blocks.append([y, 1, [s]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            y2, n2, s2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y2, blocks[-1][1] + n2, blocks[-1][2] + s2]
    want = {s: y / n for y, n, at in blocks for s in at}
    df = spark.createDataFrame(rows, "score double, label int")
    got = evaluate.isotonic(df).transform(df.select("score", F.col("score").alias("features"))).collect()
    assert {x.score: x.prediction for x in got} == pytest.approx(want)


def test_components_of_variance_against_numpy(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(200, 6)) @ r.normal(size=(6, 6))
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], ", ".join(f"v{i} double" for i in range(6)))
    model, keep = encode.fit_pca(df, df.columns)
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    shares = values / values.sum()
    assert list(model.stages[-1].explainedVariance) == pytest.approx(list(shares))
    assert keep == int(np.searchsorted(np.cumsum(shares), 0.95)) + 1


def test_rate_of_the_others(spark):
    labels = {1: 1, 2: 0, 3: 1, 4: 1, 5: 0}
    group = {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    components = spark.createDataFrame(list(group.items()), "id bigint, component bigint")
    df = spark.createDataFrame(list(labels.items()), "id bigint, label int")
    got = {x.id: x.rate for x in graph.leave_one_out_rate(components, df).collect()}
    for i, c in group.items():
        others = [labels[j] for j in group if group[j] == c and j != i]
        assert got[i] == (sum(others) / len(others) if others else None)
