"""Byte-balanced contiguous shards (operator 9): DataFrame functions only.

Rows are range-partitioned by id and written with the number of their partition, so that a task that runs again reads the
same numbers. The partitions' totals give each one's global start, running sums within a partition do the rest, and the
global byte offset is cut at equal targets. Only fixed-width digests are shuffled, never texts, and no window spans more
than one partition, except the one over the partitions' totals, which has at most MAX_PARTS rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbispan.llm.common import stored, utf8_bytes

PART_ROWS = 20_000
MAX_PARTS = 16_384


def byte_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, part_rows: int = PART_ROWS) -> DataFrame:
    """id, size, text_crc32, shard, slot: contiguous runs of ids, cut where the running size passes equal targets.

    A row goes to the shard in whose equal share of all bytes its middle lies, so a shard misses its target by half a
    row at each end at most. size is the text's UTF-8 bytes plus `overhead`; a null text has none and the checksum of an
    empty one. Ids may be of any type that has an order. Rows with null ids come first; ties on id are ordered by checksum
    and size; rows equal in all three are interchangeable, and their place in the input spreads them over partitions, so
    one id may hold any share of the rows. A very long row makes neighbouring shards smaller or empty; an empty table
    gives none. Further columns are ignored, whatever their names.
    """
    order = ["id", "text_crc32", "size", "at"]
    sized = docs.select(
        F.col(id_col).alias("id"),
        (utf8_bytes(F.col(text_col)) + F.lit(overhead)).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("at"),
    )
    sized = stored(sized, "sizes")
    rows, total = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = min(MAX_PARTS, 1 + rows // part_rows)
    placed = stored(sized.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order]).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    totals = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_start"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row_start"))
    inside = Window.partitionBy("part").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = placed.withColumns({"run_bytes": F.sum("size").over(inside), "run_rows": F.count(F.lit(1)).over(inside)}).join(F.broadcast(totals), "part")
    middle = (F.col("byte_start") + F.col("run_bytes") - F.col("size")) * 2 + F.col("size")
    shard = F.floor(middle.cast("decimal(38,0)") * shards / F.lit(2 * max(1, total)).cast("decimal(38,0)")).cast("int")
    run = run.select("id", "size", "text_crc32", F.least(shard, F.lit(shards - 1)).alias("shard"), (F.col("row_start") + F.col("run_rows") - 1).alias("place"))
    run = stored(run, "placed")
    first = run.groupBy("shard").agg(F.min("place").alias("first"))  # one row a shard
    return run.join(F.broadcast(first), "shard").select("id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))
