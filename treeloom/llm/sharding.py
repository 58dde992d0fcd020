"""Sharding by bytes: global prefix sums from per-partition totals, cut at equal targets.

Rows are put in one global order (hash of the text, then id), so that equal texts stand
together and fall into one shard unless a cut passes through their group; a group larger
than a shard is therefore split by itself.  The order is made by a range partitioning of
narrow digest rows (no text is moved).  Each range partition's bytes and rows are added
up; the running sums over these totals (a row for each partition) give every partition
its base, and a window inside the partition gives every row its place.  No task holds
more than one range partition, whatever the largest group is.

Edge cases: a null text counts 0 bytes of text (plus the fixed overhead); an empty table
gives no rows; repeated rows are kept, each with a slot of its own; null ids sort first
among equal texts; extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, whole_text

OVERHEAD_BYTES = 8


def shard_by_bytes(docs: DataFrame, shards: int = 24, overhead: int = OVERHEAD_BYTES) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row of ``docs``.

    A row belongs to the shard in whose equal share of the total bytes its middle byte
    falls, so each shard's size differs from the target by less than one row at each end.
    ``slot`` numbers the rows of a shard from 0 without gaps.
    """
    digest = docs.select(
        "doc_id",
        (F.octet_length(whole_text()) + overhead).cast("long").alias("size"),
        F.crc32(whole_text().cast("binary")).alias("text_crc32"),
        F.xxhash64(whole_text()).alias("text_hash"),
    )
    ranged = cut(digest.repartitionByRange("text_hash", "doc_id").withColumn("part", F.spark_partition_id()))

    # one row for each range partition
    every = Window.orderBy("part")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    bases = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("base_bytes"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("base_rows"),
        F.sum("part_bytes").over(whole).alias("total_bytes"),
    )

    inside = Window.partitionBy("part").orderBy("text_hash", "doc_id", "text_crc32", "size")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.select("*", F.sum("size").over(upto).alias("through"), F.row_number().over(inside).alias("nth"))
        .join(F.broadcast(bases), "part")
        .select(
            "doc_id", "size", "text_crc32",
            F.expr(f"cast(least({shards - 1}, (2 * (base_bytes + through) - size) * {shards} div (2 * total_bytes)) as int)").alias("shard"),
            (F.col("base_rows") + F.col("nth") - 1).alias("place"),
        )
    )
    # at most ``shards`` rows: where each shard begins
    begins = placed.groupBy("shard").agg(F.min("place").alias("first_place"))
    return placed.join(F.broadcast(begins), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first_place")).cast("long").alias("slot")
    )
