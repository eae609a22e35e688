"""Queries of profiles, statistics, evaluation and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import correlate, evaluate, guards, monitor, profile
from tidemark.plans.features import _SPLIT, _split, _vectors
from tidemark.plans.registry import query
from tidemark.sources import tables
from tidemark.sources.tables import DAY, DOCS, EVENTS, HOURLY, LINES, ORDERS

Z = scalar.Z95


def _events(spark, d):
    return tables.events_stream(spark, d)


def _wilson(k, n):
    k, n = f"CAST({k} AS DOUBLE)", f"CAST({n} AS DOUBLE)"
    mid, half = f"({k} / {n} + {Z * Z} / (2 * {n}))", f"{Z} * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {Z * Z} / (4 * {n} * {n}))"
    return f"greatest(({mid}) / (1 + {Z * Z} / {n}) - ({half}) / (1 + {Z * Z} / {n}), 0) AS low, least(({mid}) / (1 + {Z * Z} / {n}) + ({half}) / (1 + {Z * Z} / {n}), 1) AS high"


query("ag01_shape", f"WITH {EVENTS} SELECT count(*) AS rows, sum(label) AS positives, avg(label) AS rate, 13 AS columns FROM s", d="rate", i="positives columns")(lambda spark, d: profile.shape(_events(spark, d)))
query(
    "ag02_clock",
    f"WITH {HOURLY}, f AS (SELECT min(ts) AS a FROM s), g AS (SELECT DISTINCT ts - a AS g FROM s, f), l AS (SELECT ts < lag(ts) OVER (ORDER BY id) AS late FROM s) "
    "SELECT min(ts) AS first, max(ts) AS last, count(DISTINCT ts) AS n_distinct, (SELECT list_reduce(list(g ORDER BY g), lambda x, y: gcd(x, y)) FROM g) AS step, (SELECT count(*) FROM l WHERE late) AS n_back, max(ts) - min(ts) AS span, (SELECT count(*) = 0 FROM l WHERE late) AS monotone FROM s",
    i="step",
)(lambda spark, d: profile.clock_profile(tables.events_stream(spark, d, hourly=True)))
query("ag03_label_granularity", f"WITH {EVENTS}, g AS (SELECT card, addr2, count(*) AS n, sum(label) AS k FROM s GROUP BY card, addr2 HAVING count(*) > 1) SELECT count(*) AS groups, count(*) FILTER (k = n) AS all_positive, count(*) FILTER (k = 0) AS all_negative, count(*) FILTER (k > 0 AND k < n) AS mixed FROM g")(
    lambda spark, d: profile.label_granularity(_events(spark, d), "card", "addr2")
)
query("ag04_key_sizes", f"WITH {EVENTS}, g AS (SELECT count(*) AS n FROM s WHERE entity IS NOT NULL GROUP BY entity) SELECT count(*) AS keys, avg(n) AS mean, max(n) AS most, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.9) AS p90, count(*) FILTER (n = 1) AS single, 0 AS n_missing FROM g", d="mean median p90", i="n_missing")(
    lambda spark, d: profile.key_sizes(_events(spark, d), "entity")
)
_LONG = lambda cols, kind="DOUBLE": " UNION ALL ".join(f"SELECT id, label, '{c}' AS \"column\", CAST({c} AS {kind}) AS value FROM s" for c in cols)
_Q = ", ".join(f"quantile_cont(value, {q}) AS p{int(q * 100):02d}" for q in profile.QUANTILES)
query(
    "ag08_numeric_profile",
    f"WITH {EVENTS}, u AS ({_LONG(['amount', 'dist', 'tenure'])}), t AS (SELECT \"column\", value, count(*) AS k FROM u WHERE value IS NOT NULL GROUP BY ALL), "
    "tt AS (SELECT \"column\", first(value ORDER BY k DESC, value) AS top_value, max(k) AS k FROM t GROUP BY 1) "
    "SELECT u.\"column\", count(*) AS n_total, count(value) AS count, count(DISTINCT value) AS n_unique, min(value) AS least, max(value) AS most, avg(value) AS mean, stddev_samp(value) AS std, max(top_value) AS top_value, "
    f"skewness(value) AS skew, kurtosis(value) AS kurtosis, {_Q}, max(tt.k) / count(value) AS top_share, avg(CASE WHEN value = 0 THEN 1.0 WHEN value IS NOT NULL THEN 0.0 END) AS zero_share FROM u JOIN tt ON u.\"column\" = tt.\"column\" GROUP BY 1",
    d="least most mean std top_value skew kurtosis top_share zero_share " + " ".join(f"p{int(q * 100):02d}" for q in profile.QUANTILES),
)(lambda spark, d: profile.numeric_profile(_events(spark, d), ["amount", "dist", "tenure"]))
query(
    "ag09_categorical_profile",
    f"WITH {EVENTS}, u AS ({_LONG(['product', 'device', 'entity'], 'VARCHAR')}), c AS (SELECT \"column\", value, count(*) AS k FROM u WHERE value IS NOT NULL GROUP BY ALL), "
    "r AS (SELECT *, sum(k) OVER (PARTITION BY \"column\" ORDER BY k, value ROWS UNBOUNDED PRECEDING) <= 0.01 * sum(k) OVER (PARTITION BY \"column\") AS rare FROM c) "
    "SELECT \"column\", count(*) AS n_levels, sum(k) AS n, max(k) AS top_count, first(value ORDER BY k DESC, value DESC) AS top_level, count(*) FILTER (rare) AS n_rare, count(*) FILTER (k = 1) AS n_single FROM r GROUP BY 1",
    i="n",
)(lambda spark, d: profile.categorical_profile(_events(spark, d), ["product", "device", "entity"]))
query("ag10_histogram", f"WITH {EVENTS}, m AS (SELECT min(amount) AS a, max(amount) AS z FROM s) SELECT CASE WHEN amount = z THEN 19 ELSE CAST(floor((amount - a) / ((z - a) / 20)) AS BIGINT) END AS bin, count(*) AS n FROM s, m GROUP BY 1", i="bin")(
    lambda spark, d: profile.histogram(_events(spark, d), "amount", 20)
)
query("ag11_rate_by_group", f"WITH {EVENTS}, g AS (SELECT coalesce(device, '(missing)') AS device, count(*) AS n, sum(label) AS k FROM s GROUP BY 1) SELECT device, n, k, k / n AS rate, n / sum(n) OVER () AS share, {_wilson('k', 'n')} FROM g", d="rate share low high", i="k")(
    lambda spark, d: profile.rate_by_group(_events(spark, d), "device")
)
query("ag12_periods", f"WITH {EVENTS} SELECT (ts - (SELECT min(ts // {DAY}) FROM s) * {DAY}) // {7 * DAY} AS week, count(*) AS n, sum(label) AS k, avg(label) AS rate FROM s GROUP BY 1", d="rate", i="k")(
    lambda spark, d: guards.batch_index(_events(spark, d), 7, DAY).groupBy(F.col("batch").alias("week")).agg(F.count("*").alias("n"), F.sum("label").alias("k"), F.avg("label").alias("rate"))
)
query("ag13_missing_blocks", f"WITH {DOCS}, n AS (SELECT 'quality' AS \"column\", count(*) - count(quality) AS n_null, 'quality' AS block FROM s UNION ALL SELECT 'toxic', count(*) - count(toxic), 'quality' FROM s UNION ALL SELECT 'lang', count(*) - count(lang), 'lang' FROM s UNION ALL SELECT 'source', count(*) - count(source), 'lang' FROM s) SELECT * FROM n")(
    lambda spark, d: profile.missing_blocks(tables.documents_labels(spark, d), ["quality", "toxic", "lang", "source"], "doc_id")
)
query("ag14_missing_overlap", f"WITH {EVENTS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, avg(CASE WHEN {a} IS NULL AND {b} IS NULL THEN 1.0 ELSE 0 END) AS share FROM s" for a, b in (("addr1", "addr1"), ("addr1", "addr2"), ("addr1", "dist"), ("addr2", "addr2"), ("addr2", "dist"), ("dist", "dist"))), d="share")(
    lambda spark, d: profile.missing_overlap(_events(spark, d), ["addr1", "addr2", "dist"])
)
query(
    "ag15_missing_against_label",
    f"WITH {EVENTS}, u AS ({_LONG(['addr1', 'device', 'dist'], 'VARCHAR')}), g AS (SELECT \"column\", count(*) FILTER (value IS NULL) AS n_missing, count(value) AS n_present, sum(CASE WHEN value IS NULL THEN label ELSE 0 END) AS k_missing, sum(CASE WHEN value IS NOT NULL THEN label ELSE 0 END) AS k_present FROM u GROUP BY 1), "
    "r AS (SELECT *, k_missing / nullif(n_missing, 0) AS rate_missing, k_present / nullif(n_present, 0) AS rate_present, (k_missing + k_present) / (n_missing + n_present) AS p FROM g) "
    "SELECT \"column\", n_missing, n_present, k_missing, k_present, rate_missing, rate_present, rate_missing / nullif(rate_present, 0) AS risk_ratio, (rate_missing - rate_present) / sqrt(p * (1 - p) * (1 / n_missing + 1 / n_present)) AS z FROM r",
    d="rate_missing rate_present risk_ratio z",
    i="k_missing k_present",
)(lambda spark, d: profile.missing_against_label(_events(spark, d), ["addr1", "device", "dist"]))

_EDGES = "(SELECT list_sort(list_distinct(quantile_cont(CAST({c} AS DOUBLE), [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) FROM {t})"
_BIN = "CASE WHEN {c} IS NULL THEN '(missing)' ELSE 'b' || lpad(CAST(len(list_filter(e[2:len(e) - 1], lambda x: x < {c})) AS VARCHAR), 2, '0') END"


def _bins(c, src="s", ref="s"):
    return f"SELECT label, '{c}' AS \"column\", {_BIN.format(c=c)} AS bin FROM (SELECT *, {_EDGES.format(c=c, t=ref)} AS e FROM {src})"


def psi_sql(columns: list[str], ref: str, cur: str) -> str:
    """CTEs that end in ``psi`` (column, psi, n_new) of numeric columns, binned by the reference's deciles."""
    shares = "SELECT \"column\", bin, count(*) / sum(count(*)) OVER (PARTITION BY \"column\") AS share FROM {} GROUP BY \"column\", bin"
    r, c = (" UNION ALL ".join(_bins(x, side, ref) for x in columns) for side in (ref, cur))
    both = (
        "SELECT coalesce(rs.\"column\", cs.\"column\") AS \"column\", rs.share IS NULL AS fresh, greatest(coalesce(rs.share, 0), 1e-6) AS e, "
        "greatest(coalesce(cs.share, 0), 1e-6) AS a FROM rs FULL JOIN cs ON rs.\"column\" = cs.\"column\" AND rs.bin = cs.bin"
    )
    found = "SELECT \"column\", sum((a - e) * ln(a / e)) AS psi, count(*) FILTER (fresh) AS n_new FROM j GROUP BY 1"
    return f"r AS ({r}), c AS ({c}), rs AS ({shares.format('r')}), cs AS ({shares.format('c')}), j AS ({both}), psi AS ({found})"


query("ag16_deciles", f"WITH {EVENTS}, b AS (SELECT amount, label, {_BIN.format(c='amount')} AS bin FROM (SELECT *, {_EDGES.format(c='amount', t='s')} AS e FROM s)), g AS (SELECT bin, count(*) AS n, sum(label) AS k, min(amount) AS least, max(amount) AS most FROM b GROUP BY 1) SELECT bin, n, k, least, most, k / n AS rate, {_wilson('k', 'n')} FROM g", d="least most rate low high", i="k")(
    lambda spark, d: profile.decile_table(_events(spark, d), "amount")
)
query(
    "ag17_information_value",
    f"WITH {EVENTS}, b AS ({_bins('amount')} UNION ALL {_bins('dist')} UNION ALL SELECT label, 'device', coalesce(device, '(missing)') FROM s), g AS (SELECT \"column\", bin, count(*) FILTER (label = 0) + 0.5::DOUBLE AS g, count(*) FILTER (label = 1) + 0.5::DOUBLE AS b FROM b GROUP BY ALL), "
    "w AS (SELECT *, g / sum(g) OVER (PARTITION BY \"column\") AS sg, b / sum(b) OVER (PARTITION BY \"column\") AS sb FROM g), t AS (SELECT *, (sg - sb) * ln(sg / sb) AS t FROM w) "
    "SELECT \"column\", count(*) AS n_bins, sum(t) AS iv, coalesce(sum(t) FILTER (bin = '(missing)'), 0) AS iv_missing, sum(t) - coalesce(sum(t) FILTER (bin = '(missing)'), 0) AS iv_present FROM t GROUP BY 1",
    d="iv iv_missing iv_present",
)(lambda spark, d: profile.information_value(_events(spark, d), ["amount", "dist"], ["device"]))
query(
    "ag18_psi",
    f"WITH {EVENTS}, {_SPLIT}, tr AS (SELECT * FROM x WHERE split = 'train'), te AS (SELECT * FROM x WHERE split = 'test'), r AS ({_bins('amount', 'tr', 'tr')} UNION ALL SELECT label, 'device', coalesce(device, '(missing)') FROM tr), c AS ({_bins('amount', 'te', 'tr')} UNION ALL SELECT label, 'device', coalesce(device, '(missing)') FROM te), "
    "rs AS (SELECT \"column\", bin, count(*) / sum(count(*)) OVER (PARTITION BY \"column\") AS e FROM r GROUP BY \"column\", bin), cs AS (SELECT \"column\", bin, count(*) / sum(count(*)) OVER (PARTITION BY \"column\") AS a FROM c GROUP BY \"column\", bin), "
    "j AS (SELECT coalesce(rs.\"column\", cs.\"column\") AS \"column\", e IS NULL AS fresh, greatest(coalesce(e, 0), 1e-6) AS e, greatest(coalesce(a, 0), 1e-6) AS a FROM rs FULL JOIN cs ON rs.\"column\" = cs.\"column\" AND rs.bin = cs.bin) SELECT \"column\", sum((a - e) * ln(a / e)) AS psi, count(*) FILTER (fresh) AS n_new FROM j GROUP BY 1",
    d="psi",
)(lambda spark, d: (lambda x: (lambda tr: profile.psi(tr, x.filter("split = 'test'"), profile.quantile_edges(tr, ["amount"]) | {"device": None}))(x.filter("split = 'train'")))(_split(spark, d)))
query(
    "ag19_entity_structure",
    f"WITH {EVENTS}, g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY entity ORDER BY ts, id) AS gap FROM s), p AS (SELECT entity, count(*) AS n, sum(label) AS k, sum(gap) AS gs, count(gap) AS gn FROM g GROUP BY 1) "
    "SELECT k > 0 AS positive, count(*) AS entities, sum(n) AS rows, max(n) AS largest, quantile_cont(n, 0.5) AS median_size, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (k = n) AS pure, sum(gs) / nullif(sum(gn), 0) AS mean_gap FROM p GROUP BY 1",
    d="median_size mean_gap",
    i="rows",
)(lambda spark, d: profile.entity_structure(_events(spark, d)))
query("ag20_cold_warm", f"WITH {EVENTS}, f AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts, id) = 1 AS cold FROM s) SELECT cold, count(*) AS n, sum(label) AS k, avg(label) AS rate FROM f GROUP BY 1", d="rate", i="k")(lambda spark, d: profile.cold_warm(_events(spark, d)))
query(
    "ag21_duplicate_groups",
    f"WITH {HOURLY}, g AS (SELECT entity, addr2, device, count(*) AS n, sum(label) AS k FROM s GROUP BY ALL) SELECT count(*) FILTER (n > 1) AS groups, coalesce(sum(n) FILTER (n > 1), 0) AS rows, max(n) AS largest, sum(k) FILTER (n > 1) / sum(n) FILTER (n > 1) AS rate_in, sum(k) FILTER (n = 1) / sum(n) FILTER (n = 1) AS rate_out FROM g",
    d="rate_in rate_out",
    i="rows",
)(lambda spark, d: profile.duplicate_groups(tables.events_stream(spark, d, hourly=True), ["entity", "addr2", "device"]))


@query(
    "ag22_zero_against_positive",
    f"WITH {EVENTS}, {_SPLIT}, g AS (SELECT split, count(*) FILTER (tenure = 0) AS n0, count(*) FILTER (tenure > 0) AS n1, coalesce(sum(label) FILTER (tenure = 0), 0) AS k0, coalesce(sum(label) FILTER (tenure > 0), 0) AS k1 FROM x GROUP BY 1) SELECT split, n0, n1, k0, k1, k0 / nullif(n0, 0) AS rate0, k1 / nullif(n1, 0) AS rate1, (k1 / nullif(n1, 0)) / nullif(k0 / nullif(n0, 0), 0) AS lift FROM g",
    d="rate0 rate1 lift",
    i="k0 k1",
)
def zero_positive(spark, d):
    return profile.zero_against_positive(_split(spark, d), "tenure", "split").drop("disjoint")


query("ag23_normalisation", "SELECT count(DISTINCT p_name) AS raw, count(DISTINCT split_part(lower(p_name), ' ', 1)) AS normalised FROM part")(
    lambda spark, d: tables.table(spark, d, "part").agg(F.countDistinct("p_name").alias("raw"), F.countDistinct(scalar.normalise_device(F.col("p_name"))).alias("normalised"))
)


def _clip_sql(column: str, tail: float) -> str:
    outside = f"({column} < low OR {column} > high)"
    bounds = f"SELECT quantile_cont({column}, {tail}) AS low, quantile_cont({column}, {1 - tail}) AS high FROM s"
    return (
        f"SELECT '{column}' AS \"column\", {tail}::DOUBLE AS tail, count(*) FILTER {outside} AS n_out, "
        f"coalesce(sum(label) FILTER {outside}, 0) AS k_out FROM s, ({bounds})"
    )


_CLIPS = " UNION ALL ".join(_clip_sql(c, t) for c in ("amount", "dist") for t in (0.001, 0.01))


@query("ag25_clip_cost", f"WITH {EVENTS} {_CLIPS}", i="k_out")
def clip_cost(spark, d):
    return profile.clip_cost(_events(spark, d), ["amount", "dist"])


query("ag26_null_rates", f"WITH {EVENTS} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", true AS present, count(*) - count({c}) AS n_null, (count(*) - count({c})) / count(*) AS rate FROM s" for c in ("addr1", "dist", "label")) + " UNION ALL SELECT 'absent', false, NULL, NULL", d="rate")(
    lambda spark, d: profile.null_rates(_events(spark, d), ["addr1", "dist", "label", "absent"])
)
query("ag27_state_footprint", f"WITH {EVENTS} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS keys, avg(n) AS mean, quantile_cont(n, 0.95) AS p95, quantile_cont(n, 0.99) AS p99, max(n) AS most FROM (SELECT count(*) AS n FROM s WHERE {c} IS NOT NULL GROUP BY {c})" for c in ("entity", "card")), d="mean p95 p99")(
    lambda spark, d: profile.state_footprint(_events(spark, d), {"entity": "entity", "card": "card"})
)
query("ag33_degeneracy", f"WITH {EVENTS}, g AS (SELECT card, count(DISTINCT addr1) AS d FROM s GROUP BY 1) SELECT count(*) AS groups, avg(d) AS mean, max(d) AS most, count(*) FILTER (d <= 1) AS degenerate FROM g", d="mean")(lambda spark, d: profile.distinct_per_group(_events(spark, d), "card", "addr1"))
query("ag35_quantile_shift", f"WITH {EVENTS}, {_SPLIT} " + " UNION ALL ".join(f"SELECT 'amount' AS \"column\", {q} AS q, (SELECT quantile_cont(amount, {q}) FROM x WHERE split = 'train') AS x, (SELECT quantile_cont(amount, {q}) FROM x) AS y, (SELECT quantile_cont(amount, {q}) FROM x) - (SELECT quantile_cont(amount, {q}) FROM x WHERE split = 'train') AS shift" for q in (0.05, 0.5, 0.95)), d="q x y shift")(
    lambda spark, d: (lambda x: profile.quantile_shift(x.filter("split = 'train'"), x, ["amount"]))(_split(spark, d))
)
query("ag38_ties", f"WITH {LINES}, g AS (SELECT count(*) AS n FROM s GROUP BY entity, day) SELECT sum(n - 1) AS tied_rows, count(*) FILTER (n > 1) AS groups FROM g", i="tied_rows")(lambda spark, d: profile.ties(tables.lineitem_stream(spark, d), "entity", "day"))


@query(
    "ag39_compare",
    f"WITH {EVENTS}, p AS (SELECT 'amount' AS \"column\", amount AS x, CASE WHEN id % 100 > 0 THEN amount END AS y FROM s "
    "UNION ALL SELECT 'dist', dist, dist FROM s) SELECT \"column\", count(*) AS n, max(abs(x - y)) AS worst, "
    "count(*) FILTER ((x IS NULL) <> (y IS NULL)) AS n_null_mismatch, count(*) FILTER (abs(x - y) > 1e-9) AS n_beyond FROM p GROUP BY 1",
    d="worst",
)
def compare(spark, d):
    events = _events(spark, d)
    holed = events.withColumn("amount", F.when(F.col("id") % 100 > 0, F.col("amount")))
    return profile.compare(events, holed, ["amount", "dist"])


query("ag40_fingerprint")(lambda spark, d: profile.fingerprint(_events(spark, d)))
query("tk03_top_levels", f"WITH {EVENTS} SELECT entity, count(*) AS n FROM s GROUP BY 1 ORDER BY n DESC, entity LIMIT 10")(lambda spark, d: _events(spark, d).groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(10))

# --- scalar functions
query("sf05_clock", f"WITH {EVENTS} SELECT id, ts // 86400000000 AS day, ts // 604800000000 AS week, (ts // 3600000000) % 24 AS hour, (ts // 86400000000) % 7 AS dow FROM s")(
    lambda spark, d: _events(spark, d).withColumn("t", F.col("ts") / 1_000_000).select("id", scalar.day_index(F.col("t")).alias("day"), scalar.week_index(F.col("t")).alias("week"), scalar.hour_position(F.col("t")).alias("hour"), scalar.dow_position(F.col("t")).alias("dow"))
)
query("sf07_amount", f"WITH {EVENTS} SELECT id, ln(1 + amount) AS log_amount, CAST(round_even(amount * 100, 0) AS BIGINT) % 100 AS cents, CAST(round_even(amount * 100, 0) AS BIGINT) % 100 = 0 AS is_round FROM s", d="log_amount")(
    lambda spark, d: _events(spark, d).select("id", F.log1p("amount").alias("log_amount"), scalar.cents(F.col("amount")).alias("cents"), (scalar.cents(F.col("amount")) == 0).alias("is_round"))
)
query("sf16_auc_error", f"WITH {EVENTS}, c AS (SELECT CAST(sum(label) AS DOUBLE) AS p, CAST(count(*) - sum(label) AS DOUBLE) AS n FROM s) SELECT sqrt((0.8 * 0.2 + (p - 1) * (0.8 / 1.2 - 0.64) + (n - 1) * (2 * 0.64 / 1.8 - 0.64)) / (p * n)) AS se FROM c", d="se")(
    lambda spark, d: _events(spark, d).agg(F.sum("label").cast("double").alias("p"), F.count_if(F.col("label") == 0).cast("double").alias("n")).select(scalar.auc_error(F.lit(0.8), F.col("p"), F.col("n")).alias("se"))
)

# --- statistics
query(
    "st01_spearman",
    f"WITH {EVENTS}, r AS (SELECT id, CASE WHEN dist IS NOT NULL THEN rank() OVER (PARTITION BY dist IS NULL ORDER BY dist) + (count(*) OVER (PARTITION BY dist) - 1) / 2.0 END AS a, rank() OVER (ORDER BY amount) + (count(*) OVER (PARTITION BY amount) - 1) / 2.0 AS b, "
    "CASE WHEN tenure IS NOT NULL THEN rank() OVER (PARTITION BY tenure IS NULL ORDER BY tenure) + (count(*) OVER (PARTITION BY tenure) - 1) / 2.0 END AS c FROM s) "
    "SELECT 'amount' AS a, 'dist' AS b, count(*) FILTER (a IS NOT NULL) AS n, corr(CAST(b AS DOUBLE), CAST(a AS DOUBLE)) AS rho FROM r UNION ALL SELECT 'amount', 'tenure', count(c), corr(CAST(b AS DOUBLE), CAST(c AS DOUBLE)) FROM r UNION ALL SELECT 'dist', 'tenure', count(*) FILTER (a IS NOT NULL AND c IS NOT NULL), corr(CAST(a AS DOUBLE), CAST(c AS DOUBLE)) FROM r",
    d="rho",
)(lambda spark, d: correlate.spearman(_events(spark, d), ["amount", "dist", "tenure"]))
query("st02_exact_spearman", f"WITH {EVENTS}, k AS (SELECT * FROM s WHERE dist IS NOT NULL AND tenure IS NOT NULL), r AS (SELECT CAST(rank() OVER (ORDER BY dist) + (count(*) OVER (PARTITION BY dist) - 1) / 2.0 AS DOUBLE) AS a, CAST(rank() OVER (ORDER BY tenure) + (count(*) OVER (PARTITION BY tenure) - 1) / 2.0 AS DOUBLE) AS b FROM k) SELECT 'dist' AS a, 'tenure' AS b, count(*) AS n, corr(a, b) AS rho FROM r", d="rho")(
    lambda spark, d: correlate.exact_spearman(_events(spark, d), "dist", "tenure")
)
query(
    "st05_trend",
    f"WITH {EVENTS}, p AS (SELECT CAST(ts // {DAY} AS DOUBLE) AS t, CAST(count(*) AS DOUBLE) AS n, CAST(sum(label) AS DOUBLE) AS k, sum(label) / count(*) AS r FROM s GROUP BY 1), q AS (SELECT sum(sign(b.r - a.r)) AS d, count(*) AS m, count(*) FILTER (a.r = b.r) AS e FROM p a JOIN p b ON a.t < b.t), z AS (SELECT sum(k) / sum(n) AS o FROM p) "
    "SELECT regr_slope(r, t) AS slope, regr_r2(r, t) AS r2, count(*) AS periods, (SELECT d / sqrt(m * (m - e)) FROM q) AS tau, sum((k - n * o) ** 2 / (n * o * (1 - o))) AS chi2 FROM p, z",
    d="slope r2 tau chi2",
)(lambda spark, d: correlate.trend(_events(spark, d).withColumn("period", F.expr(f"ts div {DAY}").cast("double"))))


@query(
    "st03_screened",
    "WITH v AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), "
    "r AS (SELECT id, i, (rank() OVER (PARTITION BY i ORDER BY x) + (count(*) OVER (PARTITION BY i, x) - 1) / 2.0)::DOUBLE AS r FROM v WHERE x IS NOT NULL) "
    "SELECT 'v' || (p.i - 1) AS a, 'v' || (q.i - 1) AS b, count(*) AS n, corr(p.r, q.r) AS rho "
    "FROM r p JOIN r q ON p.id = q.id AND p.i < q.i GROUP BY p.i, q.i HAVING abs(corr(p.r, q.r)) >= 0.1",
    d="rho",
)
def screened(spark, d):
    return correlate.screened(correlate.spearman(_vectors(spark, d), [f"v{i}" for i in range(64)]), 0.1)




# --- evaluation: the score is the discount-like share of the amount, which is known and tied
def _scored(spark, d):
    return _events(spark, d).select("id", "entity", "product", "ts", "label", (F.rint(F.col("amount") / 5) / 100).alias("score"))


SCORED = f"{EVENTS}, e AS (SELECT id, entity, product, ts, label, round_even(amount / 5, 0) / 100 AS score FROM s)"
query("ev01_average_precision", f"WITH {SCORED}, g AS (SELECT product, score, sum(label) AS t, count(*) AS n FROM e GROUP BY ALL), c AS (SELECT *, sum(t) OVER w AS tp, sum(n) OVER w AS al, sum(t) OVER (PARTITION BY product) AS p FROM g WINDOW w AS (PARTITION BY product ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT product, sum(t / p * tp / al) AS pr_auc FROM c GROUP BY 1", d="pr_auc")(
    lambda spark, d: evaluate.average_precision(_scored(spark, d), "product")
)
query("ev02_roc_auc", f"WITH {SCORED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM e) SELECT (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS roc_auc FROM r", d="roc_auc")(
    lambda spark, d: evaluate.roc_auc(_scored(spark, d))
)
query("ev03_mean_score", f"WITH {SCORED} SELECT label, avg(score) AS mean, (max(ts) - min(ts)) / {DAY} AS days FROM e GROUP BY 1", d="mean days", i="label")(
    lambda spark, d: _scored(spark, d).groupBy("label").agg(F.avg("score").alias("mean"), ((F.max("ts") - F.min("ts")) / DAY).alias("days"))
)
_GRID = [i / 20 for i in range(1, 20)]
query(
    "ev04_sweep",
    f"WITH {SCORED}, t AS (SELECT unnest([{', '.join(map(str, _GRID))}])::DOUBLE AS threshold), c AS (SELECT threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp, count(*) FILTER (score < threshold AND label = 1) AS fn, count(*) FILTER (score < threshold AND label = 0) AS tn FROM e, t GROUP BY 1) "
    "SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, (tp + fp) / (tp + fp + fn + tn) AS alert_rate, fp / nullif(fp + tn, 0) AS false_positive_rate FROM c",
    d="threshold precision recall f1 alert_rate false_positive_rate",
)(lambda spark, d: evaluate.sweep(_scored(spark, d), _GRID))
_CURVE = "g AS (SELECT score, sum(label) AS t, count(*) AS n FROM e GROUP BY ALL), c AS (SELECT score, sum(t) OVER w AS tp, sum(n) OVER w AS al, sum(t) OVER () AS p FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"
query("ev05_best_f1", f"WITH {SCORED}, {_CURVE} SELECT score AS threshold, 2 * tp / (al + p) AS f1, tp, al AS alerts FROM c ORDER BY f1 DESC, score LIMIT 1", d="threshold f1", i="tp alerts")(lambda spark, d: evaluate.best_f1(_scored(spark, d)))
query("ev06_alert_budget", f"WITH {SCORED}, {_CURVE} SELECT score AS threshold, tp, al AS alerts FROM c WHERE al >= 300 ORDER BY score DESC LIMIT 1", d="threshold", i="tp alerts")(lambda spark, d: evaluate.alert_budget(_scored(spark, d), 10, 30))
query("ag30_card_level", f"WITH {SCORED} SELECT entity, max(score) AS score, max(label) AS label, count(*) AS n FROM e GROUP BY 1", d="score", i="label")(lambda spark, d: evaluate.card_level(_scored(spark, d), "entity"))
query("ev10_reliability", f"WITH {SCORED}, b AS (SELECT *, ntile(10) OVER (ORDER BY score, id) - 1 AS bin FROM e) SELECT bin, count(*) AS n, avg(score) AS mean_p, avg(label) AS rate, avg((score - label) ** 2) AS brier, abs(avg(score) - avg(label)) AS gap FROM b GROUP BY 1", d="mean_p rate brier gap")(
    lambda spark, d: evaluate.reliability(_scored(spark, d))
)
query(
    "ev11_bands",
    f"WITH {SCORED}, b AS (SELECT *, CASE WHEN score >= 1 - 2 / 4.0 THEN 2 WHEN score >= 2 / 20.0 THEN 1 ELSE 0 END AS band FROM e), g AS (SELECT band, product, count(*) AS n, sum(label) AS k FROM b GROUP BY ALL) SELECT band, product, n, k, k / n AS rate, CASE band WHEN 0 THEN k * 20 WHEN 1 THEN n * 2 ELSE (n - k) * 4 END AS cost FROM g",
    d="rate cost",
    i="band k",
)(lambda spark, d: evaluate.band_report(_scored(spark, d), (20.0, 4.0, 2.0), "product"))
query("ev07_bootstrap")(lambda spark, d: evaluate.interval(evaluate.bootstrap(_scored(spark, d), 50), "recall"))
query("ev08_paired_difference")(lambda spark, d: evaluate.paired_difference(evaluate.bootstrap(_scored(spark, d), 30), evaluate.bootstrap(_scored(spark, d), 30, threshold=0.4), "recall"))
query("ev09_isotonic")(lambda spark, d: (lambda s: evaluate.isotonic(s).transform(s.select("id", F.col("score").alias("features"))).select("id", F.col("prediction")))(_scored(spark, d)))
query("ev15_logistic")(lambda spark, d: (lambda x: correlate.fit_and_score(x.filter("split = 'train'"), x.filter("split <> 'train'"), ["amount", "f"]))(_split(spark, d).withColumn("f", F.coalesce("dist", F.lit(-1.0)))))

# --- monitoring
_WEEK = f"f AS (SELECT min(ts // {DAY}) * {DAY} AS a FROM s), y AS (SELECT s.*, (ts - a) // {7 * DAY} AS batch FROM s, f), r AS (SELECT * FROM y WHERE batch < 2), c AS (SELECT * FROM y WHERE batch >= 2)"
_PSIS = (
    f"{_WEEK}, rb AS ({_bins('amount', 'r', 'r')} UNION ALL {_bins('dist', 'r', 'r')}), cb AS ({_bins('amount', 'c', 'r').replace('SELECT label', 'SELECT batch')} UNION ALL {_bins('dist', 'c', 'r').replace('SELECT label', 'SELECT batch')}), "
    "rs AS (SELECT \"column\", bin, count(*) / sum(count(*)) OVER (PARTITION BY \"column\") AS e FROM rb GROUP BY \"column\", bin), cs AS (SELECT batch, \"column\", bin, count(*) / sum(count(*)) OVER (PARTITION BY batch, \"column\") AS a FROM cb GROUP BY batch, \"column\", bin), "
    "k AS (SELECT DISTINCT batch, \"column\" FROM cs), bb AS (SELECT \"column\", bin FROM rs UNION SELECT \"column\", bin FROM cs), "
    "p AS (SELECT k.batch, k.\"column\", sum((greatest(coalesce(a, 0), 1e-6) - greatest(coalesce(e, 0), 1e-6)) * ln(greatest(coalesce(a, 0), 1e-6) / greatest(coalesce(e, 0), 1e-6))) AS psi FROM k JOIN bb ON k.\"column\" = bb.\"column\" LEFT JOIN rs ON rs.\"column\" = bb.\"column\" AND rs.bin = bb.bin LEFT JOIN cs ON cs.batch = k.batch AND cs.\"column\" = bb.\"column\" AND cs.bin = bb.bin GROUP BY k.batch, k.\"column\")"
)


def _psis(spark, d):
    s = guards.batch_index(_events(spark, d), 7, DAY)
    ref = s.filter("batch < 2")
    return monitor.psi_by_batch(ref, s.filter("batch >= 2"), profile.quantile_edges(ref, ["amount", "dist"]))


query("mo01_psi_by_batch", f"WITH {EVENTS}, {_PSIS} SELECT batch, \"column\", psi FROM p", d="psi")(_psis)
query("mo02_alert_edges", f"WITH {EVENTS}, {_PSIS} SELECT \"column\", greatest(max(psi), 0.2) AS edge FROM p GROUP BY 1", d="edge")(lambda spark, d: monitor.alert_edges(_psis(spark, d)))
query("mo03_drift_report", f"WITH {EVENTS}, {_PSIS} SELECT batch, count(*) FILTER (psi > 0.02) AS n_past, max(psi) AS worst, count(*) FILTER (psi > 0.02) > 1 AS drifted FROM p GROUP BY 1", d="worst")(
    lambda spark, d: monitor.drift_report(_psis(spark, d), spark.createDataFrame([("amount", 0.02), ("dist", 0.02)], "column string, edge double"), 1)
)
query("mo04_held_out", f"WITH {EVENTS}, {_PSIS} SELECT batch, count(*) FILTER (psi > greatest(0.2, coalesce((SELECT max(psi) FROM p q WHERE q.\"column\" = p.\"column\" AND q.batch <> p.batch), 0))) AS n FROM p GROUP BY 1")(lambda spark, d: monitor.held_out_counts(_psis(spark, d)))
query("mo11_open_labels", f"WITH {EVENTS}, m AS (SELECT max(ts) - {7 * DAY} AS t FROM s) SELECT ts >= t AS open, count(*) AS n, sum(CASE WHEN ts >= t THEN 0 ELSE label END) AS k FROM s, m GROUP BY 1", i="k")(
    lambda spark, d: (lambda s: (lambda t: s.withColumn("open", F.col("ts") >= t).groupBy("open").agg(F.count("*").alias("n"), F.sum(F.when(F.col("open"), 0).otherwise(F.col("label"))).alias("k")))(s.agg(F.max("ts")).first()[0] - 7 * DAY))(_events(spark, d))
)
query("co10_segments", f"WITH {ORDERS} SELECT segment, status, count(*) AS n, sum(label) AS k, grouping(segment) AS gs, grouping(status) AS gt FROM s GROUP BY GROUPING SETS ((segment, status), (segment), (status), ())", i="k gs gt")(
    lambda spark, d: tables.orders_stream(spark, d).cube("segment", "status").agg(F.count("*").alias("n"), F.sum("label").alias("k"), F.grouping("segment").alias("gs"), F.grouping("status").alias("gt"))
)
