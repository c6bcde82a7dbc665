"""The order of rows in files. Spark reads files in blocks, in any order; a block's rows come one after another.

Only a row for each block goes through a window. Blocks are told by file and first byte, so a block that two scans cut
differently is an error and no wrong number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbispan.scratch import checkpointed

#: Blocks that are broadcast; beyond, the rows are shuffled to their blocks.
BROADCAST_BLOCKS = 100_000


def tagged(df: DataFrame) -> DataFrame:
    """df, as a reader gave it, with _file, _block (first byte) and _at, which grows within a block."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))


def with_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows with the columns of their block, of which blocks has one row each; a block's rows stay together and in order."""
    if blocks.count() <= BROADCAST_BLOCKS:
        out = rows.join(F.broadcast(blocks), ["_file", "_block"], "left")
    else:
        out = rows.join(blocks, ["_file", "_block"], "left").repartition("_file", "_block").sortWithinPartitions("_file", "_block", "_at")
    lost: Column = F.raise_error(F.lit("the files were cut into other blocks meanwhile"))
    return out.withColumn("_known", F.coalesce("_known", lost.cast("boolean"))).drop("_known")


def with_ordinals(df: DataFrame, out: str = "ordinal", in_file: str | None = None, file: str | None = None) -> DataFrame:
    """df, straight from a reader, with each row's place from 0 over all files, by path; if asked for, its place in its own
    file and that file."""
    rows = tagged(df)
    blocks = checkpointed(rows.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("_file", "_block", "_first", before(Window.orderBy("_file", "_block")).alias("_all"), before(Window.partitionBy("_file").orderBy("_block")).alias("_own"), F.lit(True).alias("_known"))
    placed = with_blocks(rows, checkpointed(blocks))
    inside = F.col("_at") - F.col("_first")
    placed = placed.withColumn(out, F.col("_all") + inside)
    if in_file:
        placed = placed.withColumn(in_file, F.col("_own") + inside)
    if file:
        placed = placed.withColumn(file, F.col("_file"))
    return placed.drop("_file", "_block", "_at", "_first", "_all", "_own")
