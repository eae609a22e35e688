"""Sharding by global byte-size prefix sums.

Rows are put in id order over range partitions; the totals of the partitions give each an offset, running sums inside a
partition do the rest, and the byte line is cut at equal targets. A document goes where its middle lies, so shards are
contiguous and each is within one document of the target.

Rows that are equal in id, size and checksum may be any number (a third of all): those are counted by partition and numbered
in it like others, and a range is cut into as many partitions as the table's size asks for.

Defined cases: a null or empty text has size 1; null ids come first; rows with the same id are ordered by size and checksum, ties
after that are alike; a very long text is one row and may take a whole shard; with fewer bytes than shards some shards stay empty;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stage

SHARDS = 8


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, start (bytes before the document), shard, slot (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    order = ("doc_id", "size", "text_crc32")
    # Range bounds are sampled, so the dealt rows are written once: totals and running sums then see the same partitions.
    dealt = stage(narrow.repartitionByRange(partitions(spark), *order).select("*", F.spark_partition_id().alias("part")), "shard-rows")
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_offset"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row_offset"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    lined = (
        dealt.withColumn("running", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("row", F.row_number().over(inside))
        .join(F.broadcast(offsets), "part")  # as many rows as partitions
        .select(*order, (F.col("byte_offset") + F.col("running") - F.col("size")).alias("start"), (F.col("row_offset") + F.col("row") - 1).alias("line"), "total")
        .withColumn("shard", F.expr(f"cast(least({shards - 1}, (2 * start + size) * {shards} div (2 * total)) as int)"))
    )
    firsts = lined.groupBy("shard").agg(F.min("line").alias("first"))
    return lined.join(F.broadcast(firsts), "shard").select(*order, "start", "shard", (F.col("line") - F.col("first")).alias("slot"))  # a row per shard


def op3_digest(docs: DataFrame) -> DataFrame:
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
