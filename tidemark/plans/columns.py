"""Queries of the column operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import columns, profile
from tidemark.plans.features import _SPLIT, _split
from tidemark.plans.registry import query
from tidemark.sources import tables
from tidemark.sources.tables import DAY, EVENTS, HOUR

GROUPS = {"address": ("addr*",), "device": ("device", "browser"), "money": ("amount",)}


def _events(spark, d):
    return tables.events_stream(spark, d)


@query("pf09_attach", f"WITH {EVENTS} SELECT id, amount * 2 AS amount, entity % 3 AS third FROM s", d="amount", i="third")
def attach(spark, d):
    made = {"amount": F.col("amount") * 2, "third": F.col("entity") % 3}
    return columns.attach(_events(spark, d), made).select("id", "amount", "third")


@query(
    "pf10_column_plan",
    f"WITH {EVENTS} SELECT 'addr1' AS \"column\", avg(CAST(addr1 IS NULL AS INTEGER)) > 0.15 AS dropped FROM s UNION ALL SELECT 'addr2', count(*) < 0 FROM s "
    "UNION ALL SELECT 'dist', avg(CAST(dist IS NULL AS INTEGER)) > 0.15 FROM s",
)
def column_plan(spark, d):
    s = _events(spark, d).select("addr1", "addr2", "dist")
    rates = profile.long(s, s.columns).groupBy("column").agg(F.avg(F.col("value").isNull().cast("double")).alias("null_rate"))
    left = columns.apply_plan(s, columns.sparse_plan(rates, 0.15), spare=["addr2"]).columns
    return spark.createDataFrame([(c, c not in left) for c in s.columns], "column string, dropped boolean")


@query("pf12_native_groups", f"WITH {EVENTS} SELECT id, amount, addr1, addr2 FROM s", d="amount", i="addr1 addr2")
def native_groups(spark, d):
    return columns.select_groups(_events(spark, d), GROUPS, ["address", "money"], ["id"])


@query(
    "so04_columns",
    "SELECT column_name AS \"column\" FROM (DESCRIBE SELECT * FROM documents) INTERSECT SELECT column_name FROM (DESCRIBE SELECT * FROM labels)",
)
def shared_columns(spark, d):
    known = tables.table(spark, d, "labels").columns
    return spark.createDataFrame([(c,) for c in columns.permitted(tables.table(spark, d, "documents").columns, known)], "column string")


@query(
    "so05_symmetric_difference",
    f"WITH {EVENTS}, {_SPLIT}, early AS (SELECT addr1, product FROM x WHERE split = 'train'), late AS (SELECT addr1, product FROM x WHERE split = 'test') "
    "SELECT side, addr1, product, count(*) AS n FROM (SELECT 'left' AS side, * FROM (SELECT * FROM early EXCEPT ALL SELECT * FROM late) UNION ALL "
    "SELECT 'right', * FROM (SELECT * FROM late EXCEPT ALL SELECT * FROM early)) GROUP BY ALL",
    i="addr1",
)
def symmetric_difference(spark, d):
    x = _split(spark, d)
    a, b = (x.filter(F.col("split") == s).select("addr1", "product") for s in ("train", "test"))
    return columns.symmetric_difference(a, b).groupBy("side", "addr1", "product").agg(F.count("*").alias("n"))


@query(
    "co04_families",
    "SELECT column_name AS \"column\", CASE WHEN column_type = 'BOOLEAN' THEN 'flag' WHEN column_type LIKE 'TIMESTAMP%' OR column_type = 'DATE' THEN 'time' "
    "WHEN column_type = 'VARCHAR' THEN 'text' WHEN column_type LIKE '%[]' THEN 'other' ELSE 'number' END AS family FROM (DESCRIBE SELECT * FROM lineitem)",
)
def families(spark, d):
    return columns.families(tables.table(spark, d, "lineitem"))


@query("sf03_canonical", f"WITH {EVENTS} SELECT id, CAST(CAST(addr1 AS DOUBLE) AS VARCHAR) AS addr1, CAST(dist AS VARCHAR) AS dist, device FROM s")
def canonical(spark, d):
    named = {"addr1": True, "dist": True, "device": False}
    return _events(spark, d).select("id", *[columns.canonical(F.col(c), n).alias(c) for c, n in named.items()])


@query("sf08_invert_log", f"WITH {EVENTS} SELECT id, amount FROM s", d="amount")
def invert_log(spark, d):
    return _events(spark, d).select("id", columns.amount_of(F.log1p("amount")).alias("amount"))


@query(
    "co01_content_codes",
    f"WITH {EVENTS} SELECT id, dense_rank() OVER (ORDER BY card NULLS FIRST, product NULLS FIRST, addr1 NULLS FIRST) - 1 AS code FROM s",
    i="code",
)
def content_codes(spark, d):
    return columns.codes(_events(spark, d), ["card", "product", "addr1"], "code").select("id", "code")


@query(
    "co02_device_codes",
    f"WITH {EVENTS}, k AS (SELECT *, device IS NOT NULL OR browser IS NOT NULL AS known FROM s) SELECT id, CASE WHEN known THEN "
    "dense_rank() OVER (PARTITION BY known ORDER BY device NULLS FIRST, browser NULLS FIRST) - 1 ELSE -1 END AS code FROM k",
    i="code",
)
def device_codes(spark, d):
    return columns.codes(_events(spark, d), ["device", "browser"], "code", null_level=False).select("id", "code")


@query(
    "ss10_sessions",
    f"WITH {EVENTS}, m AS (SELECT entity, ts, coalesce(ts - lag(ts) OVER w > {6 * HOUR}, true) AS fresh FROM s WINDOW w AS (PARTITION BY entity ORDER BY ts)), "
    "g AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY entity ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM m) "
    "SELECT entity, min(ts) AS start, count(*) AS n FROM g GROUP BY entity, g",
)
def sessions(spark, d):
    return columns.sessions(_events(spark, d), "entity", "ts", "6 hours").select("entity", "start", "n")


@query("gr06_label_source", f"WITH {EVENTS}, {_SPLIT} SELECT id, ts, label, ts + 7 * {DAY} AS readable_from FROM x WHERE split = 'train'", i="label")
def label_source(spark, d):
    return columns.label_source(_split(spark, d).filter("split = 'train'"), 7, DAY)


@query("tk02_positions", f"WITH {EVENTS} SELECT id, entity, row_number() OVER (PARTITION BY entity ORDER BY ts, id) - 1 AS place FROM s", i="place")
def positions(spark, d):
    return _events(spark, d).select("id", "entity", F.expr("row_number() over (partition by entity order by ts, id) - 1").alias("place"))
