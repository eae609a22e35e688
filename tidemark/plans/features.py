"""Queries of scans, splits, joins, the causal families, graph, encoders and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import causal, encode, graph, guards, profile
from tidemark.plans.registry import query
from tidemark.sources import csv, tables
from tidemark.sources.tables import DAY, DOCS, EVENTS, HOURLY, LINES, ORDERS

PRIOR = "(PARTITION BY {} ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
TRAIL = "(PARTITION BY {} ORDER BY ts RANGE BETWEEN {} PRECEDING AND 1 PRECEDING)"


def _hourly(spark, d):
    return tables.events_stream(spark, d, hourly=True)


def _velocity_sql(grain):
    return ", ".join(
        f"count(*) OVER w{n} AS vel_count_{n}_{grain}, coalesce(sum(amount) OVER w{n}, 0) AS vel_amount_sum_{n}_{grain}, avg(amount) OVER w{n} AS vel_amount_mean_{n}_{grain}" for n in causal.WINDOWS
    ) + " FROM s WINDOW " + ", ".join(f"w{n} AS {TRAIL.format(grain, w)}" for n, w in causal.WINDOWS.items())


for _name, _grain, _src, _cte in (("wf01_velocity", "entity", tables.events_stream, EVENTS), ("wf02_velocity_card_ties", "card", _hourly, HOURLY)):
    _doubles = " ".join(f"vel_amount_{k}_{n}_{_grain}" for n in causal.WINDOWS for k in ("sum", "mean"))
    query(_name, f"WITH {_cte} SELECT id, {_velocity_sql(_grain)}", d=_doubles)(lambda spark, d, g=_grain, src=_src: src(spark, d).select("id", *[c.alias(n) for n, c in causal.velocity(g).items()]))

query("wf03_velocity_chunks", f"WITH {HOURLY} SELECT id, count(*) OVER w AS n, coalesce(sum(amount) OVER w, 0) AS total FROM s WINDOW w AS {TRAIL.format('card', DAY)}", d="total")(
    lambda spark, d: causal.velocity_by_chunks(_hourly(spark, d), "card", DAY)
)
query(
    "wf04_recency",
    f"WITH {HOURLY}, p AS (SELECT id, ts, count(*) OVER w AS n, min(ts) OVER w AS a, max(ts) OVER w AS z FROM s WINDOW w AS {PRIOR.format('entity')}) "
    "SELECT id, ts - z AS rec_since_prev, n AS rec_prior_count, CASE WHEN n >= 2 THEN (z - a) / (n - 1) / 1e6::DOUBLE END AS rec_mean_gap, (ts - z) / 1e6::DOUBLE - CASE WHEN n >= 2 THEN (z - a) / (n - 1) / 1e6::DOUBLE END AS rec_gap_deviation FROM p",
    d="rec_mean_gap rec_gap_deviation",
)(lambda spark, d: _hourly(spark, d).select("id", *[c.alias(n) for n, c in causal.recency().items()]))

_MODE = "(SELECT {v} FROM s q WHERE q.card = s.card AND q.ts < s.ts AND {v} IS NOT NULL GROUP BY {v} ORDER BY count(*) DESC, {v} LIMIT 1)"
query(
    "wf09_geography",
    f"WITH {HOURLY} SELECT id, CAST(addr1 <> {_MODE.format(v='addr1')} AS INTEGER) AS geo_addr1_differs, CAST(addr2 <> {_MODE.format(v='addr2')} AS INTEGER) AS geo_addr2_differs, "
    "(SELECT count(DISTINCT addr1) FROM s q WHERE q.card = s.card AND q.ts < s.ts) AS geo_n_addr1 FROM s",
    i="geo_addr1_differs geo_addr2_differs",
)(
    lambda spark, d: causal.with_first_marks(_hourly(spark, d), "card", "addr1").select(
        "id", causal.mode_differs("addr1").alias("geo_addr1_differs"), causal.mode_differs("addr2").alias("geo_addr2_differs"), causal.running_distinct("addr1", "card").alias("geo_n_addr1")
    )
)


@query(
    "wf11_dist_buckets",
    f"WITH {EVENTS}, b AS (SELECT CAST(floor(quantile_cont(ts, 0.7)) AS BIGINT) AS t FROM s), e AS (SELECT list_distinct(quantile_cont(dist, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS e FROM s, b WHERE ts < t) "
    "SELECT id, CASE WHEN dist IS NOT NULL THEN len(list_filter(e, lambda x: x <= dist)) END AS bucket FROM s, e",
)
def dist_buckets(spark, d):
    s = tables.events_stream(spark, d)
    t = guards.boundaries(s)[0]
    edges = encode.fit_buckets(s.filter(F.col("ts") < t), "dist", boundary=t)
    return s.select("id", scalar.left_closed(F.col("dist"), F.array(*[F.lit(float(e)) for e in edges])).alias("bucket"))


@query(
    "wf12_device",
    f"WITH {HOURLY.replace('label FROM', 'label FROM')}, c AS (SELECT *, CASE WHEN coalesce(device, CAST(browser AS VARCHAR)) IS NOT NULL THEN coalesce(device, '~') || '|' || coalesce(CAST(browser AS VARCHAR), '~') END AS combo FROM s), "
    "n AS (SELECT c.*, (SELECT count(DISTINCT combo) FROM c q WHERE q.entity = c.entity AND q.ts < c.ts) AS seen FROM c) "
    "SELECT id, seen AS dev_n_distinct, CASE WHEN combo IS NOT NULL AND seen > 0 THEN CASE WHEN EXISTS (SELECT 1 FROM c q WHERE q.entity = n.entity AND q.ts < n.ts AND q.combo = n.combo) THEN 0 ELSE 1 END END AS dev_is_new FROM n",
    i="dev_is_new",
)
def device(spark, d):
    return causal.build(_hourly(spark, d), families=("device",)).select("id", "dev_n_distinct", "dev_is_new")


query(
    "wf14_amount",
    f"WITH {HOURLY}, p AS (SELECT *, avg(amount) OVER w AS m, stddev_samp(amount) OVER w AS sd, count(*) OVER v AS n24 FROM s WINDOW w AS {PRIOR.format('entity')}, v AS {TRAIL.format('entity', DAY)}) "
    "SELECT id, m AS amt_mean, sd AS amt_std, amount - m AS amt_deviation, CASE WHEN sd > 0 THEN (amount - m) / sd END AS amt_zscore, "
    f"CASE WHEN n24 > 0 THEN CASE WHEN EXISTS (SELECT 1 FROM s q WHERE q.entity = p.entity AND q.amount = p.amount AND q.ts < p.ts AND q.ts >= p.ts - {DAY}) THEN 1 ELSE 0 END END AS amt_repeat_24h FROM p",
    d="amt_mean amt_std amt_deviation amt_zscore",
    i="amt_repeat_24h",
)(lambda spark, d: _hourly(spark, d).select("id", *[c.alias(n) for n, c in causal.amount().items()]))

_CONTENT = "entity, product, addr1, device, rounded"
query(
    "wf17_duplicates",
    f"WITH {HOURLY}, r AS (SELECT *, round_even(amount / 100, 0) AS rounded FROM s) SELECT id, count(*) OVER w AS dup_prior_count, ts - max(ts) OVER w AS dup_since_prev, count(*) OVER v AS dup_prior_count_1h FROM r "
    f"WINDOW w AS {PRIOR.format(_CONTENT)}, v AS {TRAIL.format(_CONTENT, 3_600_000_000)}",
)(lambda spark, d: _hourly(spark, d).withColumn("rounded", F.rint(F.col("amount") / 100)).select("id", *[c.alias(n) for n, c in causal.duplicates().items()]))
query(
    "wf20_degrees",
    f"WITH {HOURLY} SELECT id, count(*) OVER a AS degree_card, CASE WHEN addr1 IS NOT NULL THEN count(*) OVER b END AS degree_addr1, CASE WHEN device IS NOT NULL THEN count(*) OVER c END AS degree_device, "
    "CASE WHEN device IS NOT NULL THEN (SELECT count(DISTINCT entity) FROM s q WHERE q.device = s.device AND q.ts < s.ts) END AS entities_on_device FROM s "
    f"WINDOW a AS {PRIOR.format('card')}, b AS {PRIOR.format('addr1')}, c AS {PRIOR.format('device')}",
)(lambda spark, d: causal.build(_hourly(spark, d), families=("degree",)).select("id", "degree_card", "degree_addr1", "degree_device", "entities_on_device"))


@query("wf19_all_features")
def all_features(spark, d):
    s = tables.events_stream(spark, d)
    t = guards.boundaries(s)[0]
    return causal.build(s, encode.fit_buckets(s.filter(F.col("ts") < t), "dist", boundary=t))


query("wf22_entity_mean", f"WITH {EVENTS} SELECT id, avg(amount) OVER (PARTITION BY entity) AS m FROM s", d="m")(
    lambda spark, d: tables.events_stream(spark, d).select("id", F.avg("amount").over(Window.partitionBy("entity")).alias("m"))
)
query("wf24_gaps", f"WITH {LINES} SELECT id, day - lag(day) OVER (PARTITION BY entity ORDER BY day, id) AS gap FROM s")(
    lambda spark, d: tables.lineitem_stream(spark, d).select("id", (F.col("day") - F.lag("day").over(Window.partitionBy("entity").orderBy("day", "id"))).alias("gap"))
)
query(
    "wf25_longest_run",
    f"WITH {EVENTS}, f AS (SELECT entity, id, amount > 100 AS f FROM s), g AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY id) - row_number() OVER (PARTITION BY entity, f ORDER BY id) AS g FROM f), "
    "r AS (SELECT entity, f, count(*) AS n FROM g GROUP BY entity, f, g) SELECT entity, coalesce(max(CASE WHEN f THEN n END), 0) AS longest FROM r GROUP BY entity",
)(lambda spark, d: guards.longest_run(tables.events_stream(spark, d).withColumn("f", F.col("amount") > 100), "f", "id", "entity"))

# --- splits and guards
_SPLIT = "b AS (SELECT CAST(floor(quantile_cont(ts, 0.7)) AS BIGINT) AS t, CAST(floor(quantile_cont(ts, 0.85)) AS BIGINT) AS v FROM s), x AS (SELECT s.*, CASE WHEN ts < t THEN 'train' WHEN ts < v THEN 'val' ELSE 'test' END AS split FROM s, b)"


def _split(spark, d):
    s = tables.events_stream(spark, d)
    return s.withColumn("split", guards.split_label(F.col("ts"), *guards.boundaries(s)))


query("pf01_split", f"WITH {EVENTS}, {_SPLIT} SELECT id, split FROM x")(lambda spark, d: _split(spark, d).select("id", "split"))
query("pf03_split_summary", f"WITH {EVENTS}, {_SPLIT} SELECT split, count(*) AS n, sum(label) AS k, avg(label) AS rate, min(ts) AS first, max(ts) AS last, count(DISTINCT entity) AS entities FROM x GROUP BY split", d="rate", i="k")(
    lambda spark, d: _split(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.sum("label").alias("k"), F.avg("label").alias("rate"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.countDistinct("entity").alias("entities"))
)
query("pf07_entity_key", f"WITH {EVENTS} SELECT id, floor(ts / 86400000000 - tenure) AS start_day, concat_ws('|', coalesce(CAST(card AS VARCHAR), 'NA'), coalesce(CAST(addr1 AS VARCHAR), 'NA'), coalesce(CAST(CAST(floor(ts / 86400000000 - tenure) AS BIGINT) AS VARCHAR), 'NA')) AS entity_key FROM s", i="start_day")(
    lambda spark, d: tables.events_stream(spark, d).withColumn("start_day", F.floor(F.col("ts") / DAY - F.col("tenure"))).select("id", "start_day", scalar.entity_key(F.col("card"), F.col("addr1"), F.col("start_day")).alias("entity_key"))
)
query(
    "pf14_batches",
    f"WITH {EVENTS}, f AS (SELECT min(ts // {DAY}) * {DAY} AS a, (max(ts) // {DAY} + 1) * {DAY} AS z FROM s) SELECT (ts - a) // {7 * DAY} AS batch, a + (ts - a) // {7 * DAY} * {7 * DAY} AS \"start\", a + (ts - a) // {7 * DAY} * {7 * DAY} + {7 * DAY} > z AS partial, count(*) AS n FROM s, f GROUP BY ALL",
)(lambda spark, d: guards.batch_index(tables.events_stream(spark, d), 7, DAY).groupBy("batch", "start", "partial").agg(F.count("*").alias("n")))
query("pf17_random_split")(lambda spark, d: guards.random_split(tables.events_stream(spark, d), "id").groupBy("split").agg(F.count("*").alias("n")))
query(
    "pf18_folds",
    f"WITH {EVENTS}, e AS (SELECT quantile_cont(ts, [0.25, 0.5, 0.75]) AS q FROM s) SELECT CAST(ts >= floor(q[1]) AS INTEGER) + CAST(ts >= floor(q[2]) AS INTEGER) + CAST(ts >= floor(q[3]) AS INTEGER) AS block, count(*) AS n, sum(label) AS k FROM s, e GROUP BY 1",
    i="block k",
)(lambda spark, d: guards.folds(tables.events_stream(spark, d), 3).groupBy("block").agg(F.count("*").alias("n"), F.sum("label").alias("k")))
query("pf19_inject_drift", f"WITH {EVENTS}, m AS (SELECT CAST(avg(ts) AS BIGINT) // {DAY} * {DAY} AS t FROM s) SELECT id, CASE WHEN ts >= t THEN amount * 100 ELSE amount END AS amount FROM s, m", d="amount")(
    lambda spark, d: (lambda s: guards.inject_drift(s, "amount", s.agg(F.expr(f"cast(avg(ts) as bigint) div {DAY} * {DAY}")).first()[0]))(tables.events_stream(spark, d)).select("id", "amount")
)
query("pf22_mature", f"WITH {ORDERS} SELECT day // 7 AS week, max(day) + 60 <= (SELECT max(day) FROM s) AS mature, count(*) AS n FROM s GROUP BY 1")(
    lambda spark, d: (lambda s: s.groupBy(F.expr("day div 7").alias("week")).agg(F.max("day").alias("e"), F.count("*").alias("n")).select("week", guards.mature(F.col("e"), 60, s.agg(F.max("day")).first()[0], 1).alias("mature"), "n"))(tables.orders_stream(spark, d))
)

# --- joins
query("j01_left_join", f"WITH {DOCS} SELECT doc_id, lang, quality, toxic FROM s", i="quality toxic")(lambda spark, d: tables.documents_labels(spark, d).select("doc_id", "lang", "quality", "toxic"))
query("j02_coverage", f"WITH {DOCS} SELECT lang, count(*) AS n, count(quality) AS covered, count(quality) / count(*) AS share FROM s GROUP BY lang", d="share")(
    lambda spark, d: tables.documents_labels(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("covered"), (F.count("quality") / F.count("*")).alias("share"))
)
query("j03_entity_overlap", f"WITH {EVENTS}, {_SPLIT} SELECT count(*) AS unseen_rows, count(DISTINCT addr2) AS unseen_levels FROM x WHERE split = 'test' AND entity NOT IN (SELECT entity FROM x WHERE split = 'train' AND amount > 200)")(
    lambda spark, d: (lambda x: x.filter("split = 'test'").join(x.filter("split = 'train' and amount > 200").select("entity").distinct(), "entity", "left_anti").agg(F.count("*").alias("unseen_rows"), F.countDistinct("addr2").alias("unseen_levels")))(_split(spark, d))
)
query(
    "j04_seen_unseen",
    f"WITH {EVENTS}, {_SPLIT}, k AS (SELECT DISTINCT entity FROM x WHERE split = 'train' AND amount > 200) SELECT k.entity IS NOT NULL AS seen, count(*) AS n, count(DISTINCT x.entity) AS keys, sum(label) AS k, avg(label) AS rate FROM x LEFT JOIN k ON x.entity = k.entity WHERE split <> 'train' GROUP BY 1",
    d="rate",
    i="k",
)(lambda spark, d: (lambda x: profile.membership(x.filter("split <> 'train'"), x.filter("split = 'train' and amount > 200"), "entity"))(_split(spark, d)))
query("so01_set_operations", f"WITH {EVENTS}, {_SPLIT} SELECT 'both' AS side, count(*) AS n FROM (SELECT addr2, product FROM x WHERE split = 'train' INTERSECT SELECT addr2, product FROM x WHERE split = 'test') UNION ALL SELECT 'gone', count(*) FROM (SELECT entity, product FROM x WHERE split = 'train' EXCEPT SELECT entity, product FROM x WHERE split = 'test')")(
    lambda spark, d: (
        lambda x: (lambda a, b: a.select("addr2", "product").intersect(b.select("addr2", "product")).agg(F.lit("both").alias("side"), F.count("*").alias("n")).unionByName(a.select("entity", "product").subtract(b.select("entity", "product")).agg(F.lit("gone").alias("side"), F.count("*").alias("n"))))(
            x.filter("split = 'train'"), x.filter("split = 'test'")
        )
    )(_split(spark, d))
)

# --- sources
query(
    "sc16_census",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS n_null, min({c}) AS least, max({c}) AS most, count(*) FILTER ({c} = floor({c})) AS n_whole, max(abs(CAST(CAST({c} AS FLOAT) AS DOUBLE) - {c})) AS worst_float_error, count(DISTINCT {c}) AS n_distinct FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")) + ")",
    d="least most worst_float_error",
)(lambda spark, d: csv.census(tables.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))
query("sc04_level_codes", "SELECT level, row_number() OVER (ORDER BY level) - 1 AS code FROM (SELECT DISTINCT p_brand AS level FROM part)")(lambda spark, d: csv.level_codes(tables.table(spark, d, "part"), "p_brand"))

# --- graph
query("gr04_components")(lambda spark, d: graph.incremental_components(_hourly(spark, d).withColumn("day", F.expr(f"ts div {DAY}")), ["entity", "addr2"], 7))


@query("gr07_static_components")
def static(spark, d):
    if not spark.sparkContext.getCheckpointDir():
        import tempfile

        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp())
    return graph.static_components(tables.events_stream(spark, d), ["entity", "amount"])


query("ag28_link_profile", f"WITH {EVENTS} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, count(*) - count({c}) AS n_null, (SELECT max(n) FROM (SELECT count(*) AS n FROM s WHERE {c} IS NOT NULL GROUP BY {c})) AS heaviest FROM s" for c in ("card", "addr1", "device")))(
    lambda spark, d: graph.link_profile(tables.events_stream(spark, d), ["card", "addr1", "device"])
)
query("ag41_hubs", f"WITH {EVENTS}, u AS (SELECT 'addr1' AS \"column\", CAST(addr1 AS VARCHAR) AS value FROM s UNION ALL SELECT 'card', CAST(card AS VARCHAR) FROM s) SELECT \"column\", value FROM u WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) >= 0.05 * (SELECT count(*) FROM s)")(
    lambda spark, d: graph.fit_hubs(tables.events_stream(spark, d), ["addr1", "card"])
)

# --- encoders
query(
    "pr01_vocabulary",
    f"WITH {EVENTS}, {_SPLIT}, c AS (SELECT entity AS level, count(*) AS n FROM x WHERE split = 'train' GROUP BY 1), v AS (SELECT *, sum(n) OVER (ORDER BY n, CAST(level AS VARCHAR) ROWS UNBOUNDED PRECEDING) <= 0.3 * sum(n) OVER () AS rare FROM c) "
    "SELECT id, CASE WHEN v.level IS NULL THEN '(unseen)' WHEN rare THEN '(rare)' ELSE CAST(x.entity AS VARCHAR) END AS entity_cat FROM x LEFT JOIN v ON x.entity = v.level",
)(lambda spark, d: (lambda s, t: encode.apply_vocabulary(s, encode.fit_vocabulary(s.filter(F.col("ts") < t), ["entity"], 0.3, boundary=t), ["entity"]).select("id", "entity_cat"))(tables.events_stream(spark, d), guards.boundaries(tables.events_stream(spark, d))[0]))
query(
    "pr02_frequency",
    f"WITH {EVENTS}, {_SPLIT}, c AS (SELECT amount AS level, count(*) AS n FROM x WHERE split = 'train' GROUP BY 1) SELECT id, coalesce(n, 0) AS amount_freq FROM x LEFT JOIN c ON x.amount = c.level",
)(lambda spark, d: (lambda s, t: encode.apply_frequency(s, encode.fit_frequency(s.filter(F.col("ts") < t), ["amount"], boundary=t), ["amount"]).select("id", "amount_freq"))(tables.events_stream(spark, d), guards.boundaries(tables.events_stream(spark, d))[0]))
query(
    "pr03_target_encoding",
    f"WITH {EVENTS}, y AS (SELECT *, ts // {DAY} AS day FROM s), {_SPLIT.replace('FROM s, b)', 'FROM y AS s, b)')}, "
    "p AS (SELECT d.day, (SELECT sum(label) / count(*) FROM x q WHERE q.split = 'train' AND q.day <= d.day - 3) AS prior FROM (SELECT DISTINCT day FROM x) d) "
    "SELECT id, CASE WHEN addr1 IS NOT NULL THEN ((SELECT coalesce(sum(label), 0) FROM x q WHERE q.split = 'train' AND q.addr1 = x.addr1 AND q.day <= x.day - 3) + 20 * prior) / ((SELECT count(*) FROM x q WHERE q.split = 'train' AND q.addr1 = x.addr1 AND q.day <= x.day - 3) + 20) END AS addr1_te FROM x JOIN p ON x.day = p.day",
    d="addr1_te",
)(lambda spark, d: encode.target_encode(_split(spark, d).withColumn("day", F.expr(f"ts div {DAY}")), "addr1", F.col("split") == "train", 3, 20.0).select("id", "addr1_te"))
query("pr07_imputer", f"WITH {EVENTS}, {_SPLIT}, m AS (SELECT quantile_cont(dist, 0.5) AS m, min(tenure) - 1 AS l FROM x WHERE split = 'train') SELECT id, coalesce(dist, m) AS dist, coalesce(CAST(tenure AS DOUBLE), l) AS tenure FROM x, m", d="dist tenure")(
    lambda spark, d: (lambda s, t: encode.apply_imputer(s, encode.fit_imputer(s.filter(F.col("ts") < t), ["dist"], ["tenure"], boundary=t)).select("id", "dist", "tenure"))(tables.events_stream(spark, d), guards.boundaries(tables.events_stream(spark, d))[0])
)
query("pr09_clip", f"WITH {EVENTS}, {_SPLIT}, q AS (SELECT quantile_cont(amount, 0.01) AS a, quantile_cont(amount, 0.99) AS z FROM x WHERE split = 'train') SELECT id, greatest(least(amount, z), a) AS amount FROM x, q", d="amount")(
    lambda spark, d: (lambda s, t: encode.apply_clip(s, encode.fit_clip(s.filter(F.col("ts") < t), ["amount"], 0.01, boundary=t)).select("id", "amount"))(tables.events_stream(spark, d), guards.boundaries(tables.events_stream(spark, d))[0])
)
query("pr08_indicators", f"WITH {EVENTS} SELECT id, CAST(addr1 IS NULL AS INTEGER) AS addr1_missing, CAST(dist IS NULL AS INTEGER) AS dist_missing FROM s", i="addr1_missing dist_missing")(
    lambda spark, d: encode.missing_indicators(tables.events_stream(spark, d), ["addr1", "dist"]).select("id", "addr1_missing", "dist_missing")
)


def _vectors(spark, d, n=64):
    return tables.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"v{i}") for i in range(n)], (F.col("label") == 0).cast("int").alias("label"))


query(
    "pr13_block_mean",
    "SELECT vec_id AS id, (" + " + ".join(f"(CAST(embedding[{i + 1}] AS DOUBLE) - (SELECT avg(CAST(embedding[{i + 1}] AS DOUBLE)) FROM embeddings)) / (SELECT stddev_samp(CAST(embedding[{i + 1}] AS DOUBLE)) FROM embeddings)" for i in range(64)) + ") / 64 AS block FROM embeddings",
    d="block",
)(lambda spark, d: (lambda v: encode.apply_block_mean(v, encode.fit_block_mean(v.withColumn("ts", F.lit(0)), [f"v{i}" for i in range(64)], boundary=1), "block").select("id", "block"))(_vectors(spark, d)))
query("pr13_block_pca")(lambda spark, d: (lambda v: (lambda m, k: spark.createDataFrame([(i, float(x)) for i, x in enumerate(m.stages[-1].explainedVariance[:k])], "component int, share double"))(*encode.fit_pca(v, [f"v{i}" for i in range(64)])))(_vectors(spark, d)))
query("pr16_contract")(lambda spark, d: encode.declare(tables.events_stream(spark, d), ["amount", "dist", "tenure", "device"]))
query("pr19_smote")(lambda spark, d: encode.smote(_vectors(spark, d), [f"v{i}" for i in range(64)]).select("from_id", "to_id", "draw", F.get("point", F.lit(0)).alias("x0")))
query("pr20_class_weight", f"WITH {EVENTS} SELECT count(*) FILTER (label = 0) / count(*) FILTER (label = 1) AS ratio FROM s", d="ratio")(lambda spark, d: encode.class_weight(tables.events_stream(spark, d)))


@query("ss01_online_store")
def online(spark, d):
    """The stateful store run over the events as one available-now stream; see tests for its parity with the frames."""
    from tidemark.streaming import files
    from tidemark.streaming import online as store

    src = spark.readStream.schema(tables.table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = src.select(F.col("event_id").alias("id"), tables.micros("ts").alias("ts"), F.col("value").alias("amount"), F.nullif("event_type", F.lit("error")).alias("device"), F.col("user_id").alias("entity"), k.alias("k"))
    return files.run(store.features(rows), "store")
