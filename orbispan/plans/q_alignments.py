"""Queries over binary alignment files that they write to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbispan.operators.sequences import junction_support
from orbispan.plans.q_files import _place
from orbispan.plans.registry import query
from orbispan.plans.views import SIZE, ctes, ecc, table
from orbispan.sources.alignments import read_bam, read_bam_references, write_bam

_READS = (
    ctes("ecc")
    + """, a AS (SELECT *, start % 5 AS k, substr(translate(md5(name), '0123456789abcdef', 'ACGTNACGTACGTACG'), 1, CAST(12 + start % 21 AS BIGINT)) AS s FROM ecc),
b AS (SELECT name, CAST(CASE k WHEN 0 THEN 4 WHEN 1 THEN 16 WHEN 2 THEN 1040 ELSE 99 END AS INTEGER) AS flag, CASE WHEN k > 0 THEN chrom END AS contig, CASE WHEN k > 0 THEN start END AS start,
CASE WHEN k = 0 THEN NULL WHEN k = 2 THEN start + length(s) + 900 WHEN k = 3 THEN start + length(s) - 5 ELSE start + length(s) END AS "end", CAST(start % 61 AS INTEGER) AS mapq,
CASE k WHEN 1 THEN length(s) || 'M' WHEN 2 THEN '10M900N' || (length(s) - 10) || 'M' WHEN 3 THEN '5S' || (length(s) - 5) || '=' WHEN 4 THEN '8M2I2D' || (length(s) - 10) || 'X' END AS cigar,
CASE WHEN k = 4 THEN chrom END AS next_contig, CASE WHEN k = 4 THEN "end" END AS next_start, CASE WHEN k = 4 THEN "end" - start ELSE 0 END AS template_length, s AS seq,
CASE WHEN k < 4 THEN translate(s, 'ACGTN', 'I5?!+') END AS quality, CASE WHEN k = 3 THEN concat_ws(' ', 'SA:Z:' || chrom || ',' || (start + 1) || ',-,9M,60,0;', 'NM:i:-' || (start % 300), 'XF:f:0.5', 'XB:B:s,-3,' || (start % 1000)) ELSE '' END AS tags FROM a)"""
)


def _reads(spark, d):
    """Alignments of the calls: without a place, reverse, spliced duplicates, clipped with tags, and paired without qualities."""
    k = F.col("start") % 5
    e = ecc(spark, d).withColumn("s", F.substring(F.translate(F.md5(F.col("name").cast("binary")), "0123456789abcdef", "ACGTNACGTACGTACG"), F.lit(1), (F.col("start") % 21 + 12).cast("int")))
    n = F.length("s")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    cigar = F.when(k == 1, text(n, "M")).when(k == 2, text("10M900N", n - 10, "M")).when(k == 3, text("5S", n - 5, "=")).when(k == 4, text("8M2I2D", n - 10, "X"))
    tags = F.array(text("SA:Z:", F.col("chrom"), ",", F.col("start") + 1, ",-,9M,60,0;"), text("NM:i:-", F.col("start") % 300), F.lit("XF:f:0.5"), text("XB:B:s,-3,", F.col("start") % 1000))
    return e.select(
        "name", F.when(k == 0, 4).when(k == 1, 16).when(k == 2, 1040).otherwise(99).alias("flag"), F.when(k > 0, F.col("chrom")).alias("contig"), F.when(k > 0, F.col("start")).alias("start"),
        (F.col("start") % 61).alias("mapq"), cigar.alias("cigar"), F.when(k == 4, F.col("chrom")).alias("next_contig"), F.when(k == 4, F.col("end")).alias("next_start"),
        F.when(k == 4, F.col("end") - F.col("start")).alias("template_length"), F.col("s").alias("seq"), F.when(k < 4, F.translate("s", "ACGTN", "I5?!+")).alias("quality"), F.when(k == 3, tags).alias("tags"),
    )


_CHROMOSOMES = [(f"chr{i}", SIZE) for i in range(1, 23)]


@query(_READS + """ SELECT * REPLACE (coalesce(start, -1) AS start, coalesce("end", -1) AS "end", coalesce(next_start, -1) AS next_start) FROM b""")
def file_bam(spark, d):
    """Every field of alignments that were written as files in order of their places, absent places as -1; ranges of 512 kB
    cut the files anywhere."""
    path = _place(spark, "bam")
    write_bam(_reads(spark, d), path, _CHROMOSOMES)
    return read_bam(spark, path, range_bytes=1 << 19).withColumn("tags", F.concat_ws(" ", "tags")).fillna(-1, ["start", "end", "next_start"])


@query(_READS + " SELECT name, contig, start, cigar FROM b WHERE contig IN ('chr3', 'chr17') AND start >= 6000000")
def fetch_alignments(spark, d):
    """Part of two chromosomes, of which only the ranges that the index names are read."""
    path = _place(spark, "bam")
    write_bam(_reads(spark, d), path, _CHROMOSOMES)
    return read_bam(spark, path, index=True, range_bytes=1 << 16, contigs=["chr3", "chr17"], least_start=6_000_000).select("name", "contig", "start", "cigar")


@query("""WITH a AS (SELECT 'amplicon' || (l_suppkey % 90) AS contig, l_orderkey AS name, l_partkey % 900 AS start, l_partkey % 900 + CAST(l_quantity AS BIGINT) * 5 AS "end", l_linenumber % 4 AS k, 500 + (l_suppkey % 90) // 20 AS mid, (l_partkey * 7) % 1000 AS part FROM lineitem WHERE l_returnflag <> 'R' AND l_suppkey % 90 < l_partkey % 100),
u AS (SELECT contig, name, k IN (1, 2) AS split, (start < mid - 20 AND "end" > mid + 20) OR (k = 1 AND (("end" < mid - 20 AND part > mid + 20) OR (start > mid + 20 AND part < mid - 20))) AS crosses FROM a),
n AS (SELECT contig, count(DISTINCT name) AS unique_reads, CAST(count(*) FILTER (split) AS BIGINT) AS split_reads, count(DISTINCT CASE WHEN crosses THEN name END) AS crossing_reads FROM u GROUP BY 1),
r AS (SELECT 'amplicon' || i AS contig, CAST(1000 + (i // 20) * 2 AS BIGINT) AS ref_length FROM range(0, 95) t(i)),
z AS (SELECT contig, coalesce(unique_reads, 0) AS unique_reads, coalesce(split_reads, 0) AS split_reads, coalesce(crossing_reads, 0) AS crossing_reads, ref_length FROM r LEFT JOIN n USING (contig))
SELECT *, CASE WHEN (unique_reads >= 20 AND split_reads >= 3) OR crossing_reads >= 3 THEN 'Detected' ELSE 'Not_detected' END AS status,
CASE WHEN unique_reads >= 20 AND split_reads >= 3 AND crossing_reads >= 3 THEN 'High' WHEN (unique_reads >= 20 AND split_reads >= 3) OR crossing_reads >= 3 THEN 'Medium' ELSE 'Low' END AS confidence FROM z""")
def file_junction_support(spark, d):
    """Reads over the junctions of amplicons, from a binary file and its header; five amplicons have no reads."""
    t, path = table(spark, d, "lineitem").where(F.col("l_suppkey") % 90 < F.col("l_partkey") % 100), _place(spark, "amplicons")
    own, k, n = F.col("l_suppkey") % 90, F.col("l_linenumber") % 4, F.col("l_quantity").cast("bigint") * 5
    cigar = F.when(k == 2, F.concat(n.cast("string"), F.lit("M4S"))).otherwise(F.concat(n.cast("string"), F.lit("M")))
    sa = F.concat(F.lit("SA:Z:x,"), (F.col("l_partkey") * 7 % 1000 + 1).cast("string"), F.lit(",+,9M,60,0;"))
    a = t.select(F.concat(F.lit("amplicon"), own).alias("contig"), F.col("l_orderkey").cast("string").alias("name"), (F.col("l_partkey") % 900).alias("start"), F.when(F.col("l_returnflag") == "R", F.when(k == 0, 4).otherwise(1024)).otherwise(0).alias("flag"), cigar.alias("cigar"), F.when(k == 1, F.array(sa)).alias("tags"))
    write_bam(a, path, [(f"amplicon{i}", 1000 + i // 20 * 2) for i in range(95)])
    return junction_support(read_bam(spark, path), read_bam_references(spark, path))
