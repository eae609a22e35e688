"""Benchmark decontamination by winnowing.

Every run of ``t`` words has a k-gram that is the least, by hash, of ``w = t - k + 1`` neighbours. Training documents and
benchmark items keep those k-grams only, so any shared run of ``t`` words shares a kept k-gram. Fingerprints are joined,
each hit is extended over all windows that hold its k-gram, and the windows are compared word for word.

A benchmark window has 13 words; an item of fewer words is one window of its own length and gets a lane with its own k and w.

Defined cases: a null, empty or wordless text has no words and no hits; very long texts are read whole; repeated rows and rows
tied in id each get their own result row; null ids are kept; a null item_id marks hits but isn't listed; an empty benchmark marks
nothing, an empty table gives no rows; other columns of either table are not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, let, maybe_broadcast

SPAN = 13
#: All ASCII characters but digits and lower-case letters part words.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A fingerprint packs 33 bits of hash above 30 bits of position, so its order breaks ties by position.
POSITION_BITS, HASH_MASK = 30, (1 << 33) - 1


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; ``lower`` does that for texts of ASCII only."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), BREAK), "")


def lane_shape(t: int) -> tuple[int, int]:
    """k and w for a lane that must catch every shared run of ``t`` words."""
    k = 5 if t >= SPAN else (t + 1) // 2
    return k, t - k + 1


def fingerprints(words: Column, t: int) -> Column:
    """Packed winnowed k-grams of a word array; empty for fewer than ``t`` words."""
    k, w = lane_shape(t)
    n = F.size(words)

    def gram(i: Column) -> Column:
        code = F.xxhash64(*[F.get(words, i + j) for j in range(k)])
        return F.shiftleft(code.bitwiseAND(F.lit(HASH_MASK)), POSITION_BITS) + i.cast("long")

    grams = F.transform(F.sequence(F.lit(0), n - k), gram)
    least = let(grams, lambda g: F.transform(F.sequence(F.lit(1), n - t + 1), lambda j: F.array_min(F.slice(g, j, w))))
    return F.when(n >= t, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))


def _hash(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, POSITION_BITS)


def _position(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int")


def _run(words: Column, start: Column, t: int) -> Column:
    return F.array_join(F.transform(F.sequence(start, start + (t - 1)), lambda j: F.get(words, j)), " ")


def _benchmark_windows(items: DataFrame, t: int) -> DataFrame:
    """Each window of the lane once, with the sorted ids of the items that hold it."""
    n = F.size("words")
    starts = F.sequence(F.lit(0), n - t)
    return (
        items.filter(n >= t if t == SPAN else n == t)
        .select("item_id", "words", F.explode(starts).alias("start"))
        .select("item_id", _run(F.col("words"), F.col("start"), t).alias("window"))
        .groupBy("window")
        .agg(F.collect_set("item_id").alias("item_ids"))
    )


def _lane_hits(docs: DataFrame, items: DataFrame, t: int, limit: int) -> DataFrame:
    """Every (document, start) where a benchmark window of the lane occurs, with the items."""
    k, _ = lane_shape(t)
    n = F.size("words")
    wanted = (
        items.filter(n >= t if t == SPAN else n == t)
        .select(F.explode(fingerprints(F.col("words"), t)).alias("packed"))
        .select(_hash(F.col("packed")).alias("code"))
        .distinct()
    )
    count = wanted.count()
    kept = docs.select("doc_id", "text_hash", "words", F.explode(fingerprints(F.col("words"), t)).alias("packed"))
    if count <= limit:
        seeds = kept.withColumn("code", _hash(F.col("packed"))).join(F.broadcast(wanted), "code", "left_semi")
    else:  # the words stay behind while fingerprints are shuffled
        found = (
            kept.select("doc_id", "text_hash", "packed", _hash(F.col("packed")).alias("code"))
            .join(wanted, "code", "left_semi")
            .select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "packed")
            .distinct()
        )
        whole = docs.dropDuplicates(["doc_id", "text_hash"])
        seeds = found.join(whole, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")))
    at = _position(F.col("packed"))
    windows = (
        seeds.select(
            "doc_id", "text_hash", "words", F.explode(F.sequence(F.greatest(at + (k - t), F.lit(0)), F.least(at, n - t))).alias("start")
        )
        .select("doc_id", "text_hash", "start", _run(F.col("words"), F.col("start"), t).alias("window"))
    )  # a window that holds two seeds comes twice; that changes neither the hit words nor the set of items
    known = _benchmark_windows(items, t)
    known = maybe_broadcast(known, known.count(), limit // 5)
    return windows.join(known, "window").select("doc_id", "text_hash", "start", F.lit(t).alias("span"), "item_ids")


def contamination(docs: DataFrame, benchmark: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document row: doc_id, text_hash, n_words, n_hit, item_ids (sorted strings)."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    lanes = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(SPAN)).alias("t")).distinct().collect())  # 13 values at most
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    base = keyed.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    if not lanes:
        return base.select("*", F.lit(0).cast("long").alias("n_hit"), none.alias("item_ids"))
    hits = reduce(DataFrame.unionByName, [_lane_hits(keyed, items, t, limit) for t in lanes])
    before = Window.partitionBy("doc_id", "text_hash").orderBy("start", "span").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("span")
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))))
    found = (
        hits.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "item_ids", fresh.cast("long").alias("fresh"))
        .groupBy("d", "h")
        .agg(F.sum("fresh").alias("n_hit"), F.flatten(F.collect_set("item_ids")).alias("ids"))
    )
    return base.join(found, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")), "left").select(
        "doc_id",
        "text_hash",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.array_sort(F.transform(F.array_distinct("ids"), lambda x: x.cast("string"))), none).alias("item_ids"),
    )


def contaminated() -> Column:
    """The rule: some word is hit, and at least a twentieth of the words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that the rule leaves clean."""
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("text"))
    bad = contamination(packed, benchmark, limit).filter(contaminated()).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).distinct()
    return packed.join(
        bad, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.xxhash64("text")), "left_anti"
    ).select("row.*")


def op1_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


ORACLE = r"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
lens AS (SELECT DISTINCT least(len(w), 13) AS t FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, t, array_to_string(list_slice(w, s, s + t - 1), ' ') AS win
       FROM (SELECT item_id, w, least(len(w), 13) AS t, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT doc_id, t, s, array_to_string(list_slice(w, s, s + t - 1), ' ') AS win
       FROM (SELECT doc_id, w, t, unnest(range(1, len(w) - t + 2)) AS s FROM d, lens WHERE len(w) >= t)),
h AS (SELECT dw.doc_id, dw.s, dw.t, iw.item_id FROM dw JOIN iw ON dw.t = iw.t AND dw.win = iw.win),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + t)) AS pos FROM (SELECT DISTINCT doc_id, s, t FROM h)) GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(q.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(q.ids, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AND 20 * coalesce(p.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
"""
