"""Queries of the decisions read from sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import decide, evaluate, profile
from tidemark.plans.features import _SPLIT, _split
from tidemark.plans.registry import query
from tidemark.sources.tables import DAY, EVENTS, HOUR

SWEPT = ["addr1", "card", "device", "product"]
LAGS = [0, 1, 7]
SMOOTHINGS = [5.0, 50.0]
RANKED = ["amount", "dist", "tenure", "card"]
Z = 1.959963984540054
DETECTABLE = f"({Z} + 0.8416212335729143) * sqrt(2)"


def _days(spark, d):
    return _split(spark, d).withColumn("day", F.expr(f"ts div {DAY}"))


def _sweep(spark, d):
    return decide.target_sweep(_days(spark, d), SWEPT, LAGS, SMOOTHINGS)


def _unpivot(columns: list[str], source: str, keep: str, kind: str) -> str:
    return " UNION ALL ".join(f"SELECT {keep}, '{c}' AS \"column\", CAST({c} AS {kind}) AS value FROM {source}" for c in columns)


def _encoded_sql(lag: int) -> str:
    """Rows with what train knew so many days before, of their level and of all."""
    own = (
        "SELECT a.\"column\", a.value, a.day, CAST(coalesce(sum(b.n), 0) AS DOUBLE) AS n, CAST(coalesce(sum(b.y), 0) AS DOUBLE) AS y FROM c a "
        f"LEFT JOIN c b ON a.\"column\" = b.\"column\" AND a.value = b.value AND b.day <= a.day - {lag} GROUP BY ALL"
    )
    before = f"FROM x q WHERE q.split = 'train' AND q.day <= d.day - {lag}"
    prior = f"SELECT day, (SELECT CAST(sum(label) AS DOUBLE) / count(*) {before}) AS prior FROM (SELECT DISTINCT day FROM x) d"
    return f"SELECT {lag} AS lag, l.*, n, y, prior FROM l JOIN ({own}) USING (\"column\", value, day) JOIN ({prior}) USING (day)"


_KEYS = '"column", lag, smoothing'
SWEEP = (
    f"{EVENTS}, {_SPLIT}, x AS (SELECT *, ts // {DAY} AS day FROM x0 WHERE split <> 'test'), ".replace(" x AS (SELECT s.*", " x0 AS (SELECT s.*")
    + f"l AS (SELECT *, CAST(split = 'train' AS INTEGER) AS seen FROM ({_unpivot(SWEPT, 'x', 'split, label, day', 'VARCHAR')}) WHERE value IS NOT NULL), "
    + "c AS (SELECT \"column\", value, day, sum(seen) AS n, sum(seen * label) AS y FROM l GROUP BY ALL), "
    + f"r AS ({' UNION ALL '.join(_encoded_sql(lag) for lag in LAGS)}), "
    + f"m AS (SELECT unnest([{', '.join(f'CAST({m} AS DOUBLE)' for m in SMOOTHINGS)}]) AS smoothing), "
    + "t AS (SELECT \"column\", lag, smoothing, split, label, (y + smoothing * prior) / (n + smoothing) AS te FROM r, m WHERE prior IS NOT NULL), "
    + f"g AS (SELECT {_KEYS}, split, te, CAST(sum(label) AS DOUBLE) AS p, CAST(count(*) - sum(label) AS DOUBLE) AS q FROM t GROUP BY ALL), "
    + f"k AS (SELECT *, sum(q) OVER (PARTITION BY {_KEYS}, split ORDER BY te ROWS UNBOUNDED PRECEDING) - q AS under FROM g), "
    + f"a AS (SELECT {_KEYS}, split, sum(p * (under + q / 2)) / nullif(sum(p) * sum(q), 0) AS auc FROM k GROUP BY ALL), "
    + f"sweep AS (SELECT {_KEYS}, max(auc) FILTER (split = 'train') AS train_auc, max(auc) FILTER (split = 'val') AS validation_auc FROM a GROUP BY ALL)"
)
query("pr04_target_sweep", f"WITH {SWEEP} SELECT * FROM sweep", d="train_auc validation_auc smoothing", i="lag")(_sweep)


def _paired_sql(key: str, source: str) -> str:
    """CTEs that end in ``paired`` (key, validation_auc, best, cost, cost_half)."""
    return (
        f"means AS (SELECT *, row_number() OVER (ORDER BY round(validation_auc, 9) DESC, {key}) = 1 AS best FROM (SELECT {key}, avg(validation_auc) AS validation_auc FROM {source} GROUP BY 1)), "
        f"each AS (SELECT {key}, \"column\", avg(validation_auc) AS v, avg(train_auc) AS u FROM {source} GROUP BY 1, 2), "
        f"less AS (SELECT e.{key}, t.v - e.v AS less FROM each e JOIN each t USING (\"column\") JOIN means ON means.{key} = t.{key} AND best), "
        f"paired AS (SELECT * FROM means JOIN (SELECT {key}, avg(less) AS cost, {Z} * stddev_samp(less) / sqrt(count(*)) AS cost_half FROM less GROUP BY 1) USING ({key}))"
    )


_BAND = (
    "z AS (SELECT CAST(sum(label) AS DOUBLE) AS p, CAST(count(*) - sum(label) AS DOUBLE) AS q, greatest((SELECT validation_auc FROM means WHERE best), 0.51) AS u FROM x WHERE split = 'val'), "
    f"band AS (SELECT {DETECTABLE} * sqrt((u * (1 - u) + (p - 1) * (u / (2 - u) - u * u) + (q - 1) * (2 * u * u / (1 + u) - u * u)) / (p * q)) AS band FROM z)"
)


@query(
    "pr06_lag",
    f"WITH {SWEEP}, {_paired_sql('lag', 'sweep')}, {_BAND}, gaps AS (SELECT lag, avg(u - v) AS gap, {Z} * stddev_samp(u - v) / sqrt(count(*)) AS gap_half FROM each GROUP BY 1), "
    "f AS (SELECT *, abs(gap) <= gap_half AND cost <= band AS eligible FROM paired JOIN gaps USING (lag), band) "
    "SELECT lag, validation_auc, gap, gap_half, cost, band, eligible, lag = coalesce(min(lag) FILTER (eligible) OVER (), max(lag) OVER ()) AS chosen FROM f",
    d="validation_auc gap gap_half cost band", i="lag",
)
def lag(spark, d):
    judged = _split(spark, d).filter("split = 'val'").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q")).first()
    return decide.choose_lag(_sweep(spark, d), judged.p, judged.q)


@query(
    "pr06_smoothing",
    f"WITH {SWEEP}, one AS (SELECT * FROM sweep WHERE lag = 1), {_paired_sql('smoothing', 'one')} "
    "SELECT smoothing, validation_auc, cost, cost_half, cost <= cost_half AS within, best AS chosen, count(*) FILTER (cost > cost_half) OVER () > 0 AS resolved FROM paired",
    d="smoothing validation_auc cost cost_half",
)
def smoothing(spark, d):
    return decide.choose_smoothing(_sweep(spark, d), 1)


@query(
    "ev13_agreement",
    f"WITH {EVENTS}, {_SPLIT}, e AS (SELECT label, \"column\" AS name, coalesce(value, -1) AS score FROM ({_unpivot(RANKED, 'x', 'split, label', 'DOUBLE')}) WHERE split = 'val'), "
    "g AS (SELECT name, score, CAST(sum(label) AS DOUBLE) AS t, count(*) AS n FROM e GROUP BY ALL), "
    "c AS (SELECT name, t, n, sum(t) OVER w AS tp, sum(n) OVER w AS al, sum(t) OVER v AS p, sum(n) OVER v AS al_all FROM g "
    "WINDOW w AS (PARTITION BY name ORDER BY score DESC ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY name)), "
    "m AS (SELECT name, round(sum(t / p * tp / al), 12) AS pr, round(sum(t * (al_all - p - (al - tp) + (n - t) / 2)) / max(p * (al_all - p)), 12) AS roc FROM c GROUP BY 1) "
    "SELECT m.name AS a, o.name AS b, sign(m.roc - o.roc) AS by_first, sign(m.pr - o.pr) AS by_second, sign(m.roc - o.roc) <> sign(m.pr - o.pr) AS discordant FROM m JOIN m o ON m.name < o.name",
    i="by_first by_second",
)
def agreement(spark, d):
    rows = profile.long(_split(spark, d).filter("split = 'val'"), RANKED, "label").select("label", F.col("column").alias("name"), F.coalesce("value", F.lit(-1.0)).alias("score"))
    return decide.metric_agreement(evaluate.roc_auc(rows, "name").join(evaluate.average_precision(rows, "name"), "name"))


@query(
    "ag35_unseen_levels",
    f"WITH {EVENTS}, {_SPLIT}, h AS (SELECT *, ts // {HOUR} AS hour FROM x), l AS ({_unpivot(['entity', 'device', 'hour'], 'h', 'split', 'VARCHAR')}), "
    "c AS (SELECT \"column\", value, count(*) FILTER (split = 'train') AS seen, count(*) FILTER (split <> 'train') AS later FROM l GROUP BY 1, 2) "
    "SELECT \"column\", count(*) FILTER (value IS NOT NULL AND seen > 0) AS in_train, count(*) FILTER (value IS NOT NULL AND seen = 0) AS only_later, "
    "coalesce(sum(later) FILTER (value IS NOT NULL AND seen = 0), 0) AS later_rows, coalesce(sum(later) FILTER (value IS NOT NULL AND seen = 0), 0) / sum(later) AS share FROM c GROUP BY 1",
    d="share", i="in_train only_later later_rows",
)
def unseen(spark, d):
    return decide.unseen_levels(_split(spark, d).withColumn("hour", F.expr(f"ts div {HOUR}")), ["entity", "device", "hour"], F.col("split") == "train")
