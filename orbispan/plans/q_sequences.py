"""Queries on sequences, alignments and circles; documents' letters stand for bases."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbispan.functions import sequence as seq
from orbispan.operators import sequences
from orbispan.plans.registry import query
from orbispan.plans.views import ctes, ecc, table

_GC = "(length({0}) - length(translate({0}, 'GC', '')))::DOUBLE / nullif(length({0}) - length(translate({0}, 'ACGT', '')), 0)"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.upper("text").alias("seq"))


@query(f"SELECT doc_id, round({_GC.format('upper(text)')}, 8) AS gc FROM documents")
def gc_content(spark, d):
    return sequences.gc_of(_docs(spark, d)).select("doc_id", F.round("gc", 8).alias("gc"))


@query("""WITH b AS (SELECT CAST(i AS INTEGER) AS bin, translate(substr(text, i * length(text) // 50 + 1, (i + 1) * length(text) // 50 - i * length(text) // 50), 'acgt', 'ACGT') AS s FROM documents, range(0, 50) t(i) WHERE length(text) > 0),
k AS (SELECT bin, CAST(sum(length(s) - length(translate(s, 'GC', ''))) AS BIGINT) AS gc, CAST(sum(length(s) - length(translate(s, 'ACGT', ''))) AS BIGINT) AS acgt FROM b GROUP BY 1)
SELECT bin, gc, acgt, round(gc::DOUBLE / acgt, 8) AS mean_gc FROM k""")
def gc_metagene(spark, d):
    t = table(spark, d, "documents").select(F.translate("text", "acgt", "ACGT").alias("seq"))
    return sequences.gc_metagene(t, 50).withColumn("mean_gc", F.round("mean_gc", 8))


@query(ctes("ecc") + """, h AS (SELECT chrom, (start + "end") // 2 // 100000 AS idx, count(*) AS n FROM ecc GROUP BY 1, 2)
SELECT chrom, idx, n, round(sum(n) OVER (PARTITION BY chrom ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0::DOUBLE, 6) AS smooth FROM h""")
def moving_average(spark, d):
    from orbispan.functions.regions import midpoint
    from orbispan.operators.stats import moving_average as smoothed

    h = ecc(spark, d).groupBy("chrom", F.floor(midpoint() / 100_000).alias("idx")).agg(F.count(F.lit(1)).alias("n"))
    return smoothed(h, "n", "idx", 5, ["chrom"]).withColumn("smooth", F.round("smooth", 6))


@query("""SELECT doc_id, md5(reverse(translate(s, 'ACGTNacgtn', 'TGCANtgcan'))) AS revcomp, md5(CASE WHEN n <= 100 THEN s || s ELSE right(s, 50) || left(s, 50) END) AS template, CAST(CASE WHEN n <= 100 THEN n ELSE 50 END AS INTEGER) AS junction,
md5(substr(s, 8) || left(s, 7) || substr(s, 8) || left(s, 7)) AS doubled FROM (SELECT doc_id, s, length(s) AS n FROM (SELECT doc_id, regexp_replace(text, '[^\x01-\x7F]', 'N', 'g') AS s FROM documents) WHERE length(s) > 0)""")
def sequence_transforms(spark, d):
    """Letters outside ASCII stand for unknown bases."""
    t = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"[^\x01-\x7F]", "N").alias("s")).where("length(s) > 0")
    j = seq.junction_template("s", 50)
    m = lambda c: F.md5(c.cast("binary"))
    return t.select("doc_id", m(seq.reverse_complement("s")).alias("revcomp"), m(j["template"]).alias("template"), j["junction"].alias("junction"), m(seq.rotated_and_doubled("s", F.lit(7))).alias("doubled"))


@query("""SELECT doc_id, n::BIGINT AS bases, md5(left(substr(s, doc_id % n + 1) || s || s || s, 2 * n + 3)) AS wrapped FROM (SELECT doc_id, text AS s, length(text) AS n FROM documents WHERE length(text) > 0)""")
def circular_slices(spark, d):
    t = table(spark, d, "documents").where("length(text) > 0").select("doc_id", F.col("text").alias("s"))
    n = F.length("s")
    s = seq.circular_slice("s", F.col("doc_id"), 2 * n + 3)
    return t.select("doc_id", n.cast("bigint").alias("bases"), F.md5(s.cast("binary")).alias("wrapped"))


@query("""WITH t AS (SELECT doc_id, translate(text, 'acgt', 'ACGT') AS s, length(text) AS n FROM documents WHERE length(text) > 0), r AS (SELECT doc_id, s, n, i, doc_id * 7919 * (i + 1) % n AS start FROM t, range(0, 3) g(i))
SELECT doc_id || ':' || i AS name, length(substr(s, start + 1, 2500))::INTEGER AS n, md5(substr(s, start + 1, 2500)) AS seq_md5 FROM r""")
def fetch_regions(spark, d):
    """Three regions of each document, which stands for a contig, fetched from its chunks of 1,000 bases."""
    t = table(spark, d, "documents").select("doc_id", F.translate("text", "acgt", "ACGT").alias("seq")).withColumn("n", F.length("seq")).where("n > 0").withColumn("chrom", F.col("doc_id").cast("string"))
    chunks = t.select("chrom", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 1000).cast("int")), lambda i: F.substring(F.col("seq"), i * 1000 + 1, F.lit(1000)))).alias("chunk", "seq"))
    e = t.select("doc_id", "chrom", "n", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    start = F.col("doc_id") * 7919 * (F.col("i") + 1) % F.col("n")
    e = e.select(F.concat_ws(":", "doc_id", "i").alias("name"), "chrom", start.alias("start"), F.least(start + 2500, F.col("n")).cast("bigint").alias("end"))
    return sequences.fetched(e, chunks.withColumn("chunk", F.col("chunk").cast("bigint")), 1000).select("name", F.length("seq").alias("n"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


@query("""WITH h AS (SELECT l_orderkey AS name, l_linenumber, l_tax * 100 + 90 AS pident, CAST(l_quantity AS BIGINT) AS length, l_extendedprice AS bitscore FROM lineitem),
d AS (SELECT name, max(bitscore) AS b FROM h WHERE l_linenumber = 1 GROUP BY 1), i AS (SELECT name, max(bitscore) AS b FROM h WHERE l_linenumber = 2 GROUP BY 1)
SELECT CASE WHEN d.name IS NOT NULL AND i.name IS NOT NULL THEN 'Both' WHEN d.name IS NOT NULL THEN 'Direct' WHEN i.name IS NOT NULL THEN 'Inverted' ELSE 'No_Repeat' END AS repeat_type, count(*) AS n
FROM orders o LEFT JOIN d ON d.name = o_orderkey LEFT JOIN i ON i.name = o_orderkey GROUP BY 1""")
def terminal_repeats(spark, d):
    h = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("name"), "l_linenumber", (F.col("l_tax") * 100 + 90).alias("pident"), F.col("l_quantity").cast("bigint").alias("length"), F.col("l_extendedprice").alias("bitscore"))
    names = table(spark, d, "orders").select(F.col("o_orderkey").alias("name"))
    return sequences.terminal_repeats(h.where("l_linenumber = 1"), h.where("l_linenumber = 2"), names).groupBy("repeat_type").agg(F.count(F.lit(1)).alias("n"))


_PAF = """WITH p AS (SELECT l_orderkey AS name, 'chr' || (l_suppkey % 22 + 1) AS chrom, l_partkey * 1000 AS start, l_partkey * 1000 + CAST(l_quantity AS BIGINT) * 20 AS "end", CASE WHEN l_linenumber % 2 = 0 THEN l_discount END AS de, CAST(l_quantity AS BIGINT) * 19 AS m, CAST(l_quantity AS BIGINT) * 20 AS al FROM lineitem),
q AS (SELECT *, coalesce(1 - de, m::DOUBLE / al) AS identity, least(100.0, 100.0::DOUBLE * ("end" - start) / 1000) AS coverage FROM p), h AS (SELECT * FROM q WHERE identity >= 0.95 AND coverage >= 50)"""


def _paf(spark, d):
    q = F.col("l_quantity").cast("bigint")
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("name"), F.concat(F.lit("chr"), F.col("l_suppkey") % 22 + 1).alias("chrom"), (F.col("l_partkey") * 1000).alias("start"), (F.col("l_partkey") * 1000 + q * 20).alias("end"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount")).alias("divergence"), (q * 19).alias("matches"), (q * 20).alias("aligned"), F.lit(1000).alias("original"))
    return sequences.paf_hits(t.withColumns({"target_start": F.col("start"), "target_end": F.col("end")}), 0.95, 50.0)


@query(_PAF + """ SELECT name, chrom, start, "end", round(identity, 6) AS identity, round(coverage, 6) AS coverage FROM h""")
def alignment_hits(spark, d):
    return _paf(spark, d).select("name", "chrom", "start", "end", F.round("identity", 6).alias("identity"), F.round("coverage", 6).alias("coverage"))


@query(_PAF + """, r AS (SELECT o_orderkey AS name, 'chr' || (o_custkey % 22 + 1) AS chrom, (o_custkey % 1000) * 1000 AS start, (o_custkey % 1000) * 1000 + 900 AS "end" FROM orders),
j AS (SELECT r.name, count(h.name) FILTER (NOT (h.chrom = r.chrom AND greatest(0, least(h."end", r."end") - greatest(h.start, r.start))::DOUBLE / greatest(1, r."end" - r.start) >= 0.9)) AS n_other FROM r LEFT JOIN h USING (name) GROUP BY 1)
SELECT name, n_other, CASE WHEN n_other > 0 THEN 'M' ELSE 'U' END AS copy_class FROM j""")
def copy_classes(spark, d):
    c = F.col("o_custkey")
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("name"), F.concat(F.lit("chr"), c % 22 + 1).alias("chrom"), (c % 1000 * 1000).alias("start"), (c % 1000 * 1000 + 900).alias("end"))
    return sequences.copy_class(r, _paf(spark, d))


_ALN = """WITH a AS (SELECT l_suppkey AS name, l_orderkey AS read_id, l_partkey % 900 AS start, l_partkey % 900 + CAST(l_quantity AS BIGINT) * 5 AS "end", l_returnflag = 'R' AS is_split FROM lineitem)"""


@query(_ALN + """, k AS (SELECT name, count(DISTINCT read_id) AS reads, count(DISTINCT CASE WHEN is_split THEN read_id END) AS split_reads, count(DISTINCT CASE WHEN start <= 490 AND "end" >= 510 THEN read_id END) AS crossing_reads FROM a GROUP BY 1)
SELECT name, reads, split_reads, crossing_reads, CASE WHEN split_reads > 0 OR crossing_reads > 0 THEN 'validated' ELSE 'not_validated' END AS status, CASE WHEN crossing_reads >= 3 THEN 'high' WHEN split_reads > 0 OR crossing_reads > 0 THEN 'low' ELSE 'none' END AS confidence FROM k""")
def amplicon_validation(spark, d):
    s = F.col("l_partkey") % 900
    a = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("name"), F.col("l_orderkey").alias("read_id"), s.alias("start"), (s + F.col("l_quantity").cast("bigint") * 5).alias("end"), (F.col("l_returnflag") == "R").alias("is_split"), F.lit(500).alias("junction"))
    return sequences.validation(a)


@query(_ALN + """, f AS (SELECT name, start, least("end", 1000) AS "end" FROM a UNION ALL SELECT name, 0, least("end" - 1000, 1000) FROM a WHERE "end" > 1000),
b AS (SELECT n.name, i AS pos, count(f.name) AS depth FROM (SELECT DISTINCT name FROM a) n CROSS JOIN range(0, 1000) t(i) LEFT JOIN f ON f.name = n.name AND f.start <= i AND i < f."end" GROUP BY 1, 2)
SELECT name, min(depth) AS min_depth, max(depth) AS max_depth, round(avg(depth), 6) AS mean_depth, count(*) FILTER (depth = 0) AS zero_bp FROM b GROUP BY 1""")
def circular_coverage(spark, d):
    s = F.col("l_partkey") % 900
    a = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("name"), s.alias("start"), (s + F.col("l_quantity").cast("bigint") * 5).alias("end"), F.lit(1000).cast("bigint").alias("length"))
    return sequences.circular_depth(a).withColumn("mean_depth", F.round("mean_depth", 6))


@query("""WITH s AS (SELECT p_partkey AS name, repeat(substr(translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 2 + p_partkey % 9), CAST(1 + p_partkey % 7 AS BIGINT)) || substr(md5(CAST(p_partkey AS VARCHAR)), 1, p_partkey % 5) AS s FROM part),
u AS (SELECT name, s, length(s) AS n, unnest(range(4, least(60, length(s) // 2) + 1)) AS u FROM s), k AS (SELECT name, s, n, u, unnest(range(0, CAST(ceil((n - u) / u::DOUBLE) AS BIGINT))) AS i FROM u),
m AS (SELECT name, u, count(*) AS most, min(i) FILTER (substr(s, CAST(i * u + 1 AS BIGINT), CAST(u AS BIGINT)) <> substr(s, 1, CAST(u AS BIGINT))) AS miss FROM k GROUP BY 1, 2)
SELECT name, CAST(u AS INTEGER) AS unit_length, CAST(coalesce(miss, most) AS INTEGER) AS repeat_count, CAST(coalesce(miss, most) * u AS INTEGER) AS total_length FROM m WHERE coalesce(miss, most) >= 2""")
def tandem_units(spark, d):
    h = F.md5(F.col("p_partkey").cast("string").cast("binary"))
    unit = F.substring(F.translate(h, "0123456789abcdef", "ACGT" * 4), F.lit(1), (2 + F.col("p_partkey") % 9).cast("int"))
    s = F.concat(F.repeat(unit, (1 + F.col("p_partkey") % 7).cast("int")), F.left(h, (F.col("p_partkey") % 5).cast("int")))
    t = table(spark, d, "part").select(F.col("p_partkey").alias("name"), s.alias("s"))
    return t.select("name", F.explode(seq.tandem_units("s", 4, 60)).alias("u")).select("name", "u.*")
