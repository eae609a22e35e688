"""Queries of the reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import encode, evaluate, graph, guards, report
from tidemark.plans.features import _SPLIT, _split
from tidemark.plans.profiles import SCORED, _scored, psi_sql
from tidemark.plans.registry import query
from tidemark.sources import tables
from tidemark.sources.tables import DAY, EVENTS, LINES


def _events(spark, d):
    return tables.events_stream(spark, d)


query("pf21_payload", "SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, len(list_filter(json_keys(props), lambda x: x <> 'k')) AS n_unknown FROM events", i="n_unknown")(
    lambda spark, d: report.payload_rows(tables.table(spark, d, "events").withColumnRenamed("event_id", "id"), "props", "k bigint", "id").select("id", "k", F.size("unknown").alias("n_unknown"))
)
query(
    "tk05_contributions",
    "WITH u AS (" + " UNION ALL ".join(f"SELECT vec_id AS id, 'v{i}' AS name, abs(CAST(embedding[{i + 1}] AS DOUBLE)) AS x FROM embeddings" for i in range(64)) + "), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY x DESC, name) AS r FROM u) SELECT id, string_agg(name, ',' ORDER BY r) AS top FROM r WHERE r <= 3 GROUP BY id",
)(lambda spark, d: tables.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.array_join(report.top_contributions({f"v{i}": F.get("embedding", F.lit(i)).cast("double") for i in range(64)}, 3), ",").alias("top")))
query("sf06_origin", f"WITH {EVENTS} SELECT id, floor(ts / {DAY} - tenure) AS origin FROM s", i="origin")(lambda spark, d: _events(spark, d).select("id", scalar.origin(F.col("ts") / 1_000_000, F.col("tenure")).alias("origin")))
query("sf18_interpolate", f"WITH {SCORED} SELECT id, CASE WHEN score <= 0.1 THEN 0.01 WHEN score <= 0.4 THEN 0.01 + (score - 0.1) * (0.2 - 0.01) / 0.3 WHEN score <= 0.9 THEN 0.2 + (score - 0.4) * 0.6 / 0.5 ELSE 0.8 END AS p FROM e", d="p")(
    lambda spark, d: _scored(spark, d).select("id", report.interpolate(F.col("score"), [(0.1, 0.01), (0.4, 0.2), (0.9, 0.8)]).alias("p"))
)
query("ag05_group_spread", f"WITH {LINES}, g AS (SELECT entity, day, count(*) AS n, count(DISTINCT addr1) AS d, max(addr1) - min(addr1) AS spread FROM s GROUP BY ALL HAVING count(*) > 1) SELECT count(*) AS groups, count(*) FILTER (d = 1) AS constant, max(d) AS most, max(spread) AS widest FROM g", i="widest")(
    lambda spark, d: report.group_spread(tables.lineitem_stream(spark, d), "addr1", "entity", "day")
)
query("ag07_day_counts", f"WITH {EVENTS} SELECT min(tenure) AS least, max(tenure) AS most, avg(CASE WHEN tenure IS NULL THEN 1.0 ELSE 0 END) AS null_share, avg(CASE WHEN tenure = 0 THEN 1.0 WHEN tenure IS NOT NULL THEN 0 END) AS zero_share, count(*) FILTER (tenure < 0) AS n_negative, count(*) FILTER (floor(ts / {DAY} - tenure) < 0) AS n_before FROM s", d="null_share zero_share")(
    lambda spark, d: report.day_count_profile(_events(spark, d), "tenure", "ts", DAY)
)
query(
    "ag24_tokens",
    f"WITH {EVENTS}, {_SPLIT}, c AS (SELECT entity AS level, count(*) AS n FROM x WHERE split = 'train' GROUP BY 1), v AS (SELECT *, sum(n) OVER (ORDER BY n, CAST(level AS VARCHAR) ROWS UNBOUNDED PRECEDING) <= 0.3 * sum(n) OVER () AS rare FROM c) "
    "SELECT CASE WHEN v.level IS NULL THEN '(unseen)' WHEN rare THEN '(rare)' ELSE '(level)' END AS token, count(*) AS n FROM x LEFT JOIN v ON x.entity = v.level GROUP BY 1",
)(lambda spark, d: (lambda s, t: report.token_report(encode.apply_vocabulary(s, encode.fit_vocabulary(s.filter(F.col("ts") < t), ["entity"], 0.3, boundary=t), ["entity"]), "entity"))(_events(spark, d), guards.boundaries(_events(spark, d))[0]))
query("ag36_entity_kinds", f"WITH {EVENTS}, g AS (SELECT entity, count(*) AS n, sum(label) AS k FROM s GROUP BY 1) SELECT CASE WHEN n = 1 THEN 'single' WHEN k = 0 THEN 'negative' WHEN k = n THEN 'positive' ELSE 'mixed' END AS kind, count(*) AS entities, sum(n) AS rows, sum(k) AS k FROM g GROUP BY 1", i="rows k")(
    lambda spark, d: report.entity_kinds(_events(spark, d))
)
query("j10_full_data_aggregates", f"WITH {EVENTS} SELECT id, count(*) OVER w AS full_count, avg(amount) OVER w AS full_mean, max(amount) OVER w AS full_max FROM s WINDOW w AS (PARTITION BY entity)", d="full_mean full_max")(
    lambda spark, d: report.full_data_aggregates(_events(spark, d)).select("id", "full_count", "full_mean", "full_max")
)
query(
    "ev12_segments",
    f"WITH {SCORED}, r AS (SELECT *, rank() OVER (PARTITION BY product ORDER BY score) + (count(*) OVER (PARTITION BY product, score) - 1) / 2.0 AS r FROM e), a AS (SELECT product, (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS roc_auc FROM r GROUP BY 1), "
    "g AS (SELECT product, score, sum(label) AS t, count(*) AS n FROM e GROUP BY ALL), c AS (SELECT *, sum(t) OVER w AS tp, sum(n) OVER w AS al, sum(t) OVER (PARTITION BY product) AS p FROM g WINDOW w AS (PARTITION BY product ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), v AS (SELECT product, sum(t / p * tp / al) AS pr_auc FROM c GROUP BY 1), "
    "k AS (SELECT product, count(*) FILTER (score >= 0.3 AND label = 1) AS tp, count(*) FILTER (score >= 0.3 AND label = 0) AS fp, count(*) FILTER (score < 0.3 AND label = 1) AS fn, count(*) FILTER (score < 0.3 AND label = 0) AS tn FROM e GROUP BY 1) "
    "SELECT k.*, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, (tp + fp) / (tp + fp + fn + tn) AS alert_rate, fp / nullif(fp + tn, 0) AS false_positive_rate, pr_auc, roc_auc FROM k JOIN v USING (product) JOIN a USING (product)",
    d="precision recall f1 alert_rate false_positive_rate pr_auc roc_auc",
)(lambda spark, d: report.segment_report(_scored(spark, d), "product", 0.3))
query("co35_saturation", f"WITH {EVENTS}, l AS (SELECT ts // {7 * DAY} AS level, count(*) AS rate FROM s GROUP BY 1), g AS (SELECT *, lag(rate) OVER (ORDER BY level) AS b FROM l) SELECT min(level) AS level FROM g WHERE rate < 1.1 * b")(
    lambda spark, d: report.saturation(_events(spark, d).groupBy(F.expr(f"ts div {7 * DAY}").alias("level")).agg(F.count("*").alias("rate")))
)
_SIDES = "tr AS (SELECT * FROM x WHERE split = 'train'), te AS (SELECT * FROM x WHERE split = 'test')"


@query("co15_stability", f"WITH {EVENTS}, {_SPLIT}, {_SIDES}, {psi_sql(['amount', 'dist', 'tenure'], 'tr', 'te')} SELECT * FROM psi", d="psi")
def stability(spark, d):
    rows = _split(spark, d)
    return report.stability(rows.filter("split = 'train'"), rows.filter("split = 'test'"), ["amount", "dist", "tenure"])


@query("gr09_leave_one_out")
def leave_one_out(spark, d):
    from tidemark.plans.features import static

    return graph.leave_one_out_rate(static(spark, d), _events(spark, d))
