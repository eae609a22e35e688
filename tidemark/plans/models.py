"""Queries of the preparation, column checks, model checks and late data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import challenge, checks, guards, prepare, profile
from tidemark.plans.features import _SPLIT, _split
from tidemark.plans.profiles import SCORED, _scored, psi_sql
from tidemark.plans.registry import query
from tidemark.sources import tables
from tidemark.sources.tables import DAY, EVENTS
from tidemark.streaming import files, late, online


def _events(spark, d):
    return tables.events_stream(spark, d)


def _auc(rows: str, by: str) -> str:
    """AUC of (by, score, label) rows by average ranks."""
    return (
        f"SELECT {by}, (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * (count(*) - sum(label)), 0) AS roc_auc FROM "
        f"(SELECT *, rank() OVER (PARTITION BY {by} ORDER BY score) + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0 AS r FROM {rows}) GROUP BY {by}"
    )


RECIPE = prepare.Recipe(
    drop=("browser",),
    origins=("tenure",),
    texts={"device": scalar.normalise_device},
    indicators={"addr": "addr1", "dist": "dist"},
    levels=("product", "entity"),
    tail=0.3,
    counts=("entity",),
    least_levels=5,
    targets=("addr1",),
    lag=3,
    blocks={"main": ["dist", "addr2"]},
    clipped=("amount",),
    clip_tail=0.01,
)
_Y = f"y AS (SELECT *, ts // {DAY} AS day FROM s), {_SPLIT.replace('FROM s, b)', 'FROM y AS s, b)')}"


@query(
    "pr15_preparation",
    f"WITH {EVENTS}, {_Y}, lv AS (SELECT 'product' AS c, product AS level, count(*) AS n FROM x WHERE split = 'train' GROUP BY ALL UNION ALL SELECT 'entity', CAST(entity AS VARCHAR), count(*) FROM x WHERE split = 'train' GROUP BY ALL), "
    "v AS (SELECT *, sum(n) OVER (PARTITION BY c ORDER BY n, level ROWS UNBOUNDED PRECEDING) <= 0.3 * sum(n) OVER (PARTITION BY c) AS rare FROM lv), "
    "p AS (SELECT d.day, (SELECT sum(label) / count(*) FROM x q WHERE q.split = 'train' AND q.day <= d.day - 3) AS prior FROM (SELECT DISTINCT day FROM x) d), "
    "m AS (SELECT avg(dist) AS dm, stddev_samp(dist) AS ds, avg(addr2) AS am, stddev_samp(addr2) AS asd, quantile_cont(amount, 0.01) AS lo, quantile_cont(amount, 0.99) AS hi FROM x WHERE split = 'train') "
    "SELECT x.id, x.ts, x.entity, card, greatest(least(amount, hi), lo) AS amount, product, device, addr1, label, x.day, (ts // 3600000000) % 24 AS hour, x.day % 7 AS dow, ln(1 + amount) AS amount_log, CAST(round_even(amount * 100, 0) AS BIGINT) % 100 AS amount_cents, "
    f"CAST(CAST(round_even(amount * 100, 0) AS BIGINT) % 100 = 0 AS INTEGER) AS amount_is_round, floor(ts / {DAY} - tenure) AS tenure_origin, device AS device_norm, CAST(addr1 IS NULL AS INTEGER) AS missing_block_addr, CAST(dist IS NULL AS INTEGER) AS missing_block_dist, "
    "CASE WHEN vp.level IS NULL THEN '(unseen)' WHEN vp.rare THEN '(rare)' ELSE product END AS product_cat, CASE WHEN ve.level IS NULL THEN '(unseen)' WHEN ve.rare THEN '(rare)' ELSE ve.level END AS entity_cat, coalesce(ve.n, 0) AS entity_freq, "
    "CASE WHEN addr1 IS NOT NULL THEN ((SELECT coalesce(sum(label), 0) FROM x q WHERE q.split = 'train' AND q.addr1 = x.addr1 AND q.day <= x.day - 3) + 20 * prior) / ((SELECT count(*) FROM x q WHERE q.split = 'train' AND q.addr1 = x.addr1 AND q.day <= x.day - 3) + 20) END AS addr1_te, "
    "(coalesce((dist - dm) / ds, 0) + coalesce((addr2 - am) / asd, 0)) / nullif(CAST(dist IS NOT NULL AS INTEGER) + CAST(addr2 IS NOT NULL AS INTEGER), 0) AS blockmean_main "
    "FROM x JOIN p ON x.day = p.day CROSS JOIN m LEFT JOIN v vp ON vp.c = 'product' AND vp.level = x.product LEFT JOIN v ve ON ve.c = 'entity' AND ve.level = CAST(x.entity AS VARCHAR)",
    d="amount amount_log addr1_te blockmean_main",
    i="label hour dow amount_cents amount_is_round tenure_origin missing_block_addr missing_block_dist",
)
def preparation(spark, d):
    s = _events(spark, d)
    t = guards.boundaries(s)[0]
    return prepare.apply_preparation(s, prepare.fit_preparation(s.filter(F.col("ts") < t), RECIPE, t))


@query(
    "pr17_complete",
    f"WITH {EVENTS}, {_SPLIT}, f AS (SELECT quantile_cont(dist, 0.5) AS dm, min(tenure) - 1 AS tm, quantile_cont(amount, 0.01) AS lo, quantile_cont(amount, 0.99) AS hi FROM x WHERE split = 'train'), "
    "z AS (SELECT id, split, product, dist IS NULL AS gone, tenure IS NULL AS none, greatest(least(amount, hi), lo) AS amount, coalesce(dist, dm) AS dist, coalesce(CAST(tenure AS DOUBLE), tm) AS tenure FROM x, f), "
    "m AS (SELECT avg(amount) AS a, stddev_pop(amount) AS sa, avg(dist) AS b, stddev_pop(dist) AS sb, avg(tenure) AS c, stddev_pop(tenure) AS sc FROM z WHERE split = 'train') "
    "SELECT id, (amount - a) / sa AS amount, (dist - b) / sb AS dist, (tenure - c) / sc AS tenure, CAST(gone AS INTEGER) AS dist_missing, CAST(none AS INTEGER) AS tenure_missing, "
    + ", ".join(f"CAST(product = '{p}' AS INTEGER) AS is_{p}" for p in ("click", "error", "purchase", "signup", "view"))
    + " FROM z, m",
    d="amount dist tenure",
    i="dist_missing tenure_missing is_click is_error is_purchase is_signup is_view",
)
def complete(spark, d):
    s = _events(spark, d)
    t = guards.boundaries(s)[0]
    out = prepare.apply_complete(s, prepare.fit_complete(s.filter(F.col("ts") < t), ["amount", "dist"], ["tenure"], ["amount"], ["product"], 0.01, boundary=t))
    return out.toDF(*[c.replace("product=", "is_") for c in out.columns])


query(
    "pr18_tree_matrix",
    f"WITH {EVENTS}, {_SPLIT}, v AS (SELECT device AS level, row_number() OVER (ORDER BY device) - 1 AS code FROM (SELECT DISTINCT device FROM x WHERE split = 'train' AND device IS NOT NULL)) "
    "SELECT id, amount, coalesce(dist, -1) AS dist, coalesce(CAST(code AS DOUBLE), -1) AS device, 0 AS amount_missing, CAST(dist IS NULL AS INTEGER) AS dist_missing, CAST(code IS NULL AS INTEGER) AS device_missing FROM x LEFT JOIN v ON v.level = x.device",
    d="amount dist device",
    i="amount_missing dist_missing device_missing",
)(lambda spark, d: (lambda s, t: prepare.tree_matrix(s, ["amount", "dist"], ["device"], prepare.fit_levels(s.filter(F.col("ts") < t), ["device"], boundary=t), sentinel=-1.0))(_events(spark, d), guards.boundaries(_events(spark, d))[0]))


_ORIGINS = (
    "o AS (SELECT split, label, CAST(tenure AS DOUBLE) AS tenure, CAST(floor(ts / {day} - tenure) AS DOUBLE) AS tenure_origin FROM x), "
    "tr AS (SELECT * FROM o WHERE split = 'train'), te AS (SELECT * FROM o WHERE split = 'test')"
).format(day=DAY)


@query(
    "pr11_origin_psi",
    f"WITH {EVENTS}, {_SPLIT}, {_ORIGINS}, {psi_sql(['tenure', 'tenure_origin'], 'tr', 'te')} SELECT 'tenure' AS \"column\", "
    "max(psi) FILTER (\"column\" = 'tenure') AS psi_count, max(psi) FILTER (\"column\" = 'tenure_origin') AS psi_origin FROM psi",
    d="psi_count psi_origin",
)
def origin_psi(spark, d):
    rows = _split(spark, d)
    return prepare.origin_psi(rows.filter("split = 'train'"), rows.filter("split = 'test'"), ["tenure"])



query(
    "ag06_entity_stats",
    f"WITH {EVENTS}, g AS (SELECT card, count(*) AS n, sum(label) AS k FROM s GROUP BY 1) SELECT count(*) AS entities, avg(n) AS mean_rows, max(n) AS most_rows, count(*) FILTER (n = 1) AS single, count(*) FILTER (n > 1 AND k = 0) AS pure_negative, count(*) FILTER (n > 1 AND k = n) AS pure_positive, "
    "count(*) FILTER (k > 0 AND k < n) AS mixed, (SELECT count(*) FROM s WHERE addr1 IS NULL OR dist IS NULL) AS null_part_rows FROM g",
    d="mean_rows",
)(lambda spark, d: checks.entity_stats(_events(spark, d), "card", "card", "addr1", "dist"))
query(
    "ag31_skew_summary",
    "WITH k AS (" + " UNION ALL ".join(f"SELECT abs(skewness(CAST(embedding[{i + 1}] AS DOUBLE))) AS x FROM embeddings" for i in range(64)) + ") SELECT count(*) AS columns, count(*) FILTER (x > 1) AS beyond_1, count(*) FILTER (x > 3) AS beyond_3, count(*) FILTER (x > 10) AS beyond_10, quantile_cont(x, 0.5) AS median, max(x) AS most FROM k",
    d="median most",
)(lambda spark, d: checks.skew_summary(profile.numeric_profile(tables.table(spark, d, "embeddings").select(*[F.get("embedding", F.lit(i)).cast("double").alias(f"v{i}") for i in range(64)]), [f"v{i}" for i in range(64)])))
query(
    "ag32_coverage",
    f"WITH {EVENTS}, {_SPLIT}, u AS (SELECT split, label, 'entity' AS grain, min(ts) OVER (PARTITION BY entity) >= ts AS cold FROM x UNION ALL SELECT split, label, 'addr1', addr1 IS NULL OR min(ts) OVER (PARTITION BY addr1) >= ts FROM x), "
    "g AS (SELECT split, grain, count(*) AS n, count(*) FILTER (cold) AS n_cold, coalesce(sum(label) FILTER (cold), 0) AS k_cold, coalesce(sum(label) FILTER (NOT cold), 0) AS k_warm FROM u GROUP BY ALL), "
    "h AS (SELECT *, n_cold / n AS share_cold, k_cold / nullif(n_cold, 0) AS rate_cold, k_warm / nullif(n - n_cold, 0) AS rate_warm, 1.959963984540054::DOUBLE AS z FROM g) "
    "SELECT split, grain, n, n_cold, k_cold, k_warm, share_cold, rate_cold, rate_warm, CASE WHEN n_cold > 0 THEN greatest((rate_cold + z * z / (2 * n_cold)) / (1 + z * z / n_cold) - z * sqrt(rate_cold * (1 - rate_cold) / n_cold + z * z / (4 * n_cold * n_cold)) / (1 + z * z / n_cold), 0) END AS low_cold, "
    "CASE WHEN n_cold > 0 THEN least((rate_cold + z * z / (2 * n_cold)) / (1 + z * z / n_cold) + z * sqrt(rate_cold * (1 - rate_cold) / n_cold + z * z / (4 * n_cold * n_cold)) / (1 + z * z / n_cold), 1) END AS high_cold FROM h",
    d="share_cold rate_cold rate_warm low_cold high_cold",
    i="k_cold k_warm",
)(lambda spark, d: checks.coverage(_split(spark, d), ["entity", "addr1"]))
query("ag34_impossible", f"WITH {EVENTS}, r AS (SELECT 'amount_low' AS rule, count(*) FILTER (amount < 5) AS n, coalesce(sum(label) FILTER (amount < 5), 0) AS k, count(*) AS rows FROM s UNION ALL SELECT 'tenure_long', count(*) FILTER (tenure > 18), coalesce(sum(label) FILTER (tenure > 18), 0), count(*) FROM s) SELECT rule, n, k, n / rows AS share FROM r", d="share", i="k")(
    lambda spark, d: checks.impossible(_events(spark, d), {"amount_low": F.col("amount") < 5, "tenure_long": F.col("tenure") > 18})
)
query(
    "ag34_agreement",
    f"WITH {EVENTS} SELECT CASE WHEN addr2 IS NULL AND browser IS NULL THEN 'both_missing' WHEN addr2 IS NULL OR browser IS NULL THEN 'one_missing' WHEN addr2 = browser THEN 'same' ELSE 'differs' END AS state, count(*) AS n, sum(label) AS k, avg(label) AS rate FROM s GROUP BY 1",
    d="rate",
    i="k",
)(lambda spark, d: checks.agreement(_events(spark, d), "addr2", "browser"))
query("ag34_concentration", "WITH g AS (SELECT p_name AS l, count(*) AS c FROM part GROUP BY 1) SELECT count(*) AS levels, sum(c) AS n, count(*) FILTER (c = 1) AS single, (SELECT sum(c) FROM (SELECT c FROM g ORDER BY c DESC, l LIMIT 10)) / sum(c) AS top_share FROM g", d="top_share", i="n")(
    lambda spark, d: checks.concentration(tables.table(spark, d, "part"), "p_name")
)

_ORDER = "SELECT 'product' AS \"column\", split, label, coalesce(e.k / e.n, o.k / o.n) AS score FROM x LEFT JOIN e ON x.product = e.product, o"
query(
    "st07_time_consistency",
    f"WITH {EVENTS}, {_SPLIT}, e AS (SELECT product, sum(label) AS k, count(*) AS n FROM x WHERE split = 'train' GROUP BY 1), o AS (SELECT sum(label) AS k, count(*) AS n FROM x WHERE split = 'train'), r AS ({_ORDER} WHERE split <> 'val'), a AS ({_auc('r', 'split')}) "
    "SELECT 'product' AS \"column\", max(roc_auc) FILTER (split = 'train') AS early_auc, max(roc_auc) FILTER (split = 'test') AS late_auc, max(roc_auc) FILTER (split = 'train') > 0.5 AND max(roc_auc) FILTER (split = 'test') < 0.5 AS inverted FROM a",
    d="early_auc late_auc",
)(lambda spark, d: (lambda x: challenge.time_consistency(x.filter("split = 'train'"), x.filter("split = 'test'"), [], ["product"]))(_split(spark, d)))
query("st07_time_consistency_bins")(lambda spark, d: (lambda x: challenge.time_consistency(x.filter("split = 'train'"), x.filter("split = 'test'"), ["amount", "dist", "tenure"], ["product"]))(_split(spark, d)))
query(
    "st08_single_column",
    f"WITH {EVENTS}, {_SPLIT}, r AS (SELECT unnest(['amount', 'dist', 'tenure']) AS \"column\", CAST(split = 'test' AS INTEGER) AS label, coalesce(unnest([amount, dist, CAST(tenure AS DOUBLE)]), -1) AS score FROM x WHERE split <> 'val') " + _auc("r", '"column"').replace("roc_auc", "auc"),
    d="auc",
)(lambda spark, d: (lambda x: challenge.single_column_auc(x.filter("split = 'train'"), x.filter("split = 'test'"), ["amount", "dist", "tenure"]))(_split(spark, d)))


@query("st08_adversarial")
def adversarial(spark, d):
    x = _split(spark, d).na.fill(-1.0, ["dist"]).na.fill(-1, ["tenure"])
    return challenge.adversarial(x.filter("split = 'train'"), x.filter("split = 'test'"), ["amount", "dist", "tenure"], 3)


query(
    "mo05_performance",
    f"WITH {SCORED}, q AS (SELECT *, (ts // {DAY} - (SELECT min(ts) // {DAY} FROM e)) // 7 AS batch FROM e), g AS (SELECT batch, score, sum(label) AS t, count(*) AS n FROM q GROUP BY ALL), "
    "c AS (SELECT *, sum(t) OVER w AS tp, sum(n) OVER w AS al, sum(t) OVER (PARTITION BY batch) AS p FROM g WINDOW w AS (PARTITION BY batch ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), v AS (SELECT batch, sum(t / p * tp / al) AS pr_auc, sum(t) AS k, sum(n) AS n FROM c GROUP BY 1), "
    f"a AS ({_auc('q', 'batch')}) SELECT v.batch, n, k, pr_auc, roc_auc, pr_auc - 0.05 AS change, pr_auc - 0.05 < -0.01 AS decayed FROM v JOIN a USING (batch)",
    d="pr_auc roc_auc change",
    i="n k",
)(lambda spark, d: (lambda s: challenge.performance(guards.batch_index(s, 7, DAY), 0.05, 1 << 60, 60, DAY, 0.01))(_scored(spark, d)))
query(
    "mo11_label_latency",
    f"WITH {EVENTS}, m AS (SELECT max(ts) AS t FROM s), w AS (SELECT unnest([0, 3, 7, 14]) AS days), g AS (SELECT days, count(*) AS n_all, sum(label) AS k_all, count(*) FILTER (days = 0 OR ts < t - days * {DAY}) AS n_known, coalesce(sum(label) FILTER (days = 0 OR ts < t - days * {DAY}), 0) AS k FROM s, m, w GROUP BY 1) "
    "SELECT days, treatment, CASE WHEN treatment = 'immature' THEN n_all ELSE n_known END AS n, k, k / CASE WHEN treatment = 'immature' THEN n_all ELSE n_known END AS rate, k_all / n_all AS true_rate FROM g, (SELECT unnest(['immature', 'excluded']) AS treatment)",
    d="rate true_rate",
    i="days n k",
)(lambda spark, d: challenge.label_latency(_events(spark, d), [0, 3, 7, 14], DAY))
query(
    "mo12_leakage",
    f"WITH {SCORED}, h AS (SELECT id, label, score, round(avg(score) OVER (PARTITION BY entity), 9) AS w, round(coalesce(avg(score) OVER (PARTITION BY entity ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), score), 9) AS p FROM e), "
    f"r AS (SELECT 'baseline' AS variant, label, score FROM h UNION ALL SELECT 'all_rows', label, w FROM h UNION ALL SELECT 'past_rows', label, p FROM h), a AS ({_auc('r', 'variant')}) SELECT variant, roc_auc, roc_auc - (SELECT roc_auc FROM a WHERE variant = 'baseline') AS delta FROM a",
    d="roc_auc delta",
)(lambda spark, d: challenge.leakage(_scored(spark, d)))
query("st06_rate_bootstrap")(lambda spark, d: challenge.rate_bootstrap(_events(spark, d), 50, "product"))
query("ev14_search")(lambda spark, d: challenge.search(_events(spark, d).na.fill(0.0, ["dist"]), ["amount", "dist"], [0.0, 0.1], 2))
query("sf15_two_proportions", f"WITH {EVENTS}, c AS (SELECT CAST(sum(label) FILTER (dist IS NULL) AS DOUBLE) AS k1, CAST(count(*) FILTER (dist IS NULL) AS DOUBLE) AS n1, CAST(sum(label) FILTER (dist IS NOT NULL) AS DOUBLE) AS k2, CAST(count(*) FILTER (dist IS NOT NULL) AS DOUBLE) AS n2 FROM s) SELECT (k1 / n1 - k2 / n2) / sqrt((k1 + k2) / (n1 + n2) * (1 - (k1 + k2) / (n1 + n2)) * (1 / n1 + 1 / n2)) AS z FROM c", d="z")(
    lambda spark, d: _events(spark, d)
    .agg(*[F.sum(F.when(c, F.col("label"))).cast("double").alias(f"k{i}") for i, c in ((1, F.col("dist").isNull()), (2, F.col("dist").isNotNull()))], *[F.count_if(c).cast("double").alias(f"n{i}") for i, c in ((1, F.col("dist").isNull()), (2, F.col("dist").isNotNull()))])
    .select(scalar.two_proportion_z(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2")).alias("z"))
)


def _stream(spark, d, table):
    return spark.readStream.schema(tables.table(spark, d, table).schema).parquet(f"{d}/{table}.parquet*")


def _run(out):
    """The whole input as one available-now stream of a small aggregate, read back as a table of the driver's memory."""
    name = "stream_" + uuid.uuid4().hex
    out.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return out.sparkSession.table(name)


query("ss08_weekly", f"SELECT epoch_us(ts) // {7 * DAY} * 7 AS start_day, count(*) AS n, sum(value) AS total FROM events GROUP BY 1", d="total")(
    lambda spark, d: _run(online.weekly(_stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("event_time"), F.col("value").alias("amount")))).select(F.expr(f"unix_micros(week.start) div {DAY}").alias("start_day"), "n", "total")
)


def _labelled(src):
    rows = src.select(F.col("event_id").alias("id"), F.col("value").alias("amount"), F.col("ts").cast("timestamp").alias("event_time"))
    k = F.get_json_object("props", "$.k").cast("bigint")
    arrival = F.expr("cast(ts as timestamp) + make_interval(0, 0, 0, cast(5 + event_id % 11 as int))")
    return rows, src.select(F.col("event_id").alias("id"), (k % 25 == 0).cast("int").alias("label"), arrival.alias("label_time"))


_ARRIVALS = f"WITH {EVENTS}, l AS (SELECT id, label, ts + (5 + id % 11) * {DAY} AS at FROM s) SELECT s.id, s.amount, l.label FROM s JOIN l ON s.id = l.id"


@query("ss11_matured_labels", f"{_ARRIVALS} WHERE l.at <= s.ts + {12 * DAY}", d="amount", i="label")
def matured_labels(spark, d):
    """Labels come 5 to 15 days after their rows; after 12 days they are final."""
    return files.run(late.matured(*_labelled(_stream(spark, d, "events")), "12 days").select("id", "amount", "label"), "matured")


@query("ss11_late_labels", f"{_ARRIVALS} WHERE l.at > s.ts + {12 * DAY}", d="amount", i="label")
def late_labels(spark, d):
    return late.after_maturity(*_labelled(tables.table(spark, d, "events")), "12 days").select("id", "amount", "label")
