"""Merkle fixity audit of WARC records (operator 4).

Records are laid out in files: each has an ordinal and a byte offset. A leaf is the digest of one record with its place;
a node hashes the digests of `fanout` ordered children, that is, of one range of offsets. Two replicas are compared root
by root, and only children of mismatching nodes are read further down, so an intact file costs one comparison. All steps
are joins and aggregates of fixed-width digests; the records themselves are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbispan.llm.common import stored

FANOUT = 16


def warc_records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html") -> DataFrame:
    """id, uri, header, block: a WARC 1.1 resource record for each page; null bodies are empty blocks, null URIs '-'."""
    block = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    uri = F.coalesce(F.col(uri_col), F.lit("-"))
    digest = F.concat(F.lit("sha256:"), F.sha2(block, 256))
    lines = ["WARC/1.1", "WARC-Type: resource", F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(">")), F.concat(F.lit("WARC-Target-URI: "), uri), F.concat(F.lit("WARC-Block-Digest: "), digest), F.concat(F.lit("Content-Length: "), F.length(block).cast("string")), "", ""]
    header = F.concat_ws("\r\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])
    return pages.select(F.col(id_col).alias("id"), uri.alias("uri"), header.alias("header"), block.alias("block"))


def record_bytes() -> Column:
    """A record as stored: header, block and two line ends."""
    return F.concat(F.col("header").cast("binary"), F.col("block"), F.lit("\r\n\r\n").cast("binary"))


def laid_out(records: DataFrame, files: int, file: Column | None = None) -> DataFrame:
    """file, ordinal, id, offset, length, digest: records dealt to files by a hash of id and URI, or by `file`, and by id within a file.

    A file holds some thousands of records, so a window over one file is bounded, unless most records are copies with one id
    and one URI: those are one resource and stay together. Null ids come first; rows of one id are ordered by digest.
    """
    body = record_bytes()
    file = F.pmod(F.xxhash64(F.col("id").cast("string"), "uri"), F.lit(files)).cast("int") if file is None else F.coalesce(file, F.lit(0))
    slim = records.select("id", file.alias("file"), F.length(body).cast("long").alias("length"), F.sha2(body, 256).alias("digest"))
    w = Window.partitionBy("file").orderBy(F.col("id").asc_nulls_first(), "digest")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return slim.select("file", (F.row_number().over(w) - 1).alias("ordinal"), "id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "digest")


def tree_levels(leaves: DataFrame, height: int, fanout: int = FANOUT) -> list[DataFrame]:
    """[leaves, ..., roots]: file, node, hash. A node covers `fanout` ordered children; its hash is over theirs in order.

    leaves: file, ordinal, offset, length, digest. All files have the same height; level `height` is one node a file.
    """
    place = F.concat_ws(":", "offset", "length", "digest")
    levels = [leaves.select("file", F.col("ordinal").cast("long").alias("node"), F.sha2(place.cast("binary"), 256).alias("hash"))]
    for _ in range(height):
        child = F.struct("node", "hash")
        up = levels[-1].groupBy("file", F.floor(F.col("node") / fanout).alias("up")).agg(F.sort_array(F.collect_list(child)).alias("c"))
        joined = F.array_join(F.transform("c", lambda x: F.concat_ws("=", (x["node"] % fanout).cast("string"), x["hash"])), ",")
        levels.append(up.select("file", F.col("up").alias("node"), F.sha2(joined.cast("binary"), 256).alias("hash")))
    return levels


def height_for(rows_in_a_file: int, fanout: int = FANOUT) -> int:
    height, room = 1, fanout
    while room < rows_in_a_file:
        height, room = height + 1, room * fanout
    return height


def _mismatching(a: DataFrame, b: DataFrame) -> DataFrame:
    """file, node of the nodes that differ or that only one replica has."""
    both = a.withColumnRenamed("hash", "ha").join(b.withColumnRenamed("hash", "hb"), ["file", "node"], "full_outer")
    return both.where(~F.col("ha").eqNullSafe(F.col("hb"))).select("file", "node")


def _aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records of both sides (columns l and r, structs) paired by file and id: those of one digest first, then in order."""
    count = lambda df, by: df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("at.ordinal")))
    side = lambda df: df.select("file", F.struct("id").alias("who"), "digest", F.struct("ordinal", "offset", "length").alias("at"))
    keys = ["file", "who", "digest", "k"]
    a, b = count(side(left), keys[:3]).withColumnRenamed("at", "l"), count(side(right), keys[:3]).withColumnRenamed("at", "r")
    both = stored(a.join(b, keys, "full_outer").select("file", "who", "digest", "l", "r"), "aligned")
    same = both.where("l is not null and r is not null").withColumn("equal", F.lit(True)).drop("digest")
    alone = lambda here, gone: count(both.where(f"{gone} is null").select("file", "who", F.col(here).alias("at")), ["file", "who"]).withColumnRenamed("at", here)
    rest = alone("l", "r").join(alone("r", "l"), ["file", "who", "k"], "full_outer").select("file", "who", "l", "r", F.lit(False).alias("equal"))
    return same.unionByName(rest)


def audit(primary: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """file, id, ordinal, offset, length, replica_ordinal, replica_offset, replica_length, kind: what differs.

    Both sides: file, ordinal, id, offset, length, digest. kind: 'corrupt' (same id, other bytes), 'missing' (only in the
    primary), 'extra' (only in the replica), 'moved' (same bytes, at an offset that lost, added and changed records before it
    do not explain). Nodes are compared from the roots down and only records under mismatching leaves are then aligned by
    id, so one lost record is one row, though all later ones lie elsewhere. Null ids are aligned like any other; copies
    pair up in order. Equal replicas, and two empty ones, give no rows.
    """
    a, b = stored(primary, "primary"), stored(replica, "replica")
    most = a.select("ordinal").union(b.select("ordinal")).agg(F.max("ordinal")).first()[0]
    height = height_for((most or 0) + 1, fanout)
    up_a = [stored(x, "tree") for x in tree_levels(a, height, fanout)]
    up_b = [stored(x, "tree") for x in tree_levels(b, height, fanout)]
    bad = stored(_mismatching(up_a[-1], up_b[-1]), "mismatches")
    for level in range(height - 1, -1, -1):  # only children of mismatching nodes
        under = lambda side: side.withColumn("up", F.floor(F.col("node") / fanout)).join(bad.withColumnRenamed("node", "up"), ["file", "up"], "left_semi").drop("up")
        bad = stored(_mismatching(under(up_a[level]), under(up_b[level])), "mismatches")
    at = bad.select("file", F.col("node").cast("int").alias("ordinal"))
    pairs = _aligned(a.join(at, ["file", "ordinal"], "left_semi"), b.join(at, ["file", "ordinal"], "left_semi"))
    lost, added = F.col("r").isNull(), F.col("l").isNull()
    change = F.when(lost, -F.col("l.length")).when(~added, F.col("r.length") - F.col("l.length")).otherwise(0)
    before = lambda place: Window.partitionBy("file").orderBy(F.col(place).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    shifts = pairs.withColumns({"shift": F.coalesce(F.sum(change).over(before("l.offset")), F.lit(0)), "grown": F.coalesce(F.sum(F.when(added, F.col("r.length")).otherwise(0)).over(before("r.offset")), F.lit(0))})
    moved = F.col("r.offset") != F.col("l.offset") + F.col("shift") + F.col("grown")
    kind = F.when(lost, "missing").when(added, "extra").when(~F.col("equal"), "corrupt").when(moved, "moved")
    named = shifts.select("file", "who.id", "l.*", *[F.col(f"r.{c}").alias(f"replica_{c}") for c in ("ordinal", "offset", "length")], kind.alias("kind"))
    return named.where("kind is not null")
