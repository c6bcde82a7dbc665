"""Queries that parse tool outputs built from the tables, and quality statistics of simulated sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbispan.functions.regions import length_bin
from orbispan.operators.process import link_colour
from orbispan.operators.stats import exact_quantiles
from orbispan.plans.registry import query
from orbispan.plans.views import ctes, ecc, genome, table
from orbispan.sources import detectors, tables


@query(ctes("ecc") + """ SELECT name AS det_id, 'U' AS type, 'Confirmed' AS state, length, chrom, start, "end" FROM ecc""")
def detector_native(spark, d):
    e = ecc(spark, d)
    raw = e.select(F.col("name").alias("eccDNA_id"), F.concat_ws("-", F.concat_ws(":", "chrom", "start"), "end").alias("Regions"), F.lit("UeccDNA").alias("eccDNA_type"), F.lit("Confirmed").alias("State"), F.lit(None).cast("string").alias("Length"))
    return detectors.from_native(raw).select("det_id", "type", "state", "length", F.col("segs")[0]["chrom"].alias("chrom"), F.col("segs")[0]["start"].alias("start"), F.col("segs")[0]["end"].alias("end"))


@query(ctes("ecc") + """, o AS (SELECT chrom, start, "end", length, row_number() OVER (ORDER BY chrom, start, "end", name) AS k FROM ecc) SELECT 'circlemap_' || k AS det_id, chrom, length FROM o""")
def detector_intervals(spark, d):
    out = detectors.from_intervals(ecc(spark, d).select("name", "chrom", "start", "end"), "circlemap", ("start", "end", "name"))
    return out.select("det_id", F.col("segs")[0]["chrom"].alias("chrom"), "length")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS det_id, CASE WHEN count(*) > 1 THEN 'M' ELSE 'U' END AS type, CAST(sum(100 + CAST(l_quantity AS BIGINT) * 40) AS BIGINT) AS length, count(*)::INTEGER AS n_segs FROM lineitem GROUP BY l_orderkey""")
def detector_long_reads(spark, d):
    t = table(spark, d, "lineitem")
    start = (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729) % 10_000_000
    part = F.concat(F.lit("chr"), F.col("l_suppkey") % 22 + 1, F.lit(":"), start, F.lit("-"), start + 100 + F.col("l_quantity").cast("bigint") * 40, F.when(start % 2 == 0, "_+").otherwise("_-"))
    raw = t.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.collect_list(part), ";").alias("merge_region"), F.count(F.lit(1)).cast("string").alias("num_region")).withColumn("merge_len", F.lit(None).cast("string"))
    return detectors.from_long_reads(raw).select("det_id", "type", "length", F.size("segs").alias("n_segs"))


@query(ctes("ecc") + """, b AS (SELECT CASE WHEN length < 500 THEN '<500bp' WHEN length < 1000 THEN '500-1kb' WHEN length < 5000 THEN '1-5kb' WHEN length < 10000 THEN '5-10kb' ELSE '>10kb' END AS k, count(*)::DOUBLE AS v FROM ecc GROUP BY 1),
c AS (SELECT chrom AS k, count(*)::DOUBLE AS v FROM ecc GROUP BY 1 ORDER BY v DESC, k LIMIT 15)
SELECT 'length_bin' AS scope, k AS key, v AS value FROM b UNION ALL SELECT 'top_chrom', k, v FROM c
UNION ALL SELECT 'percentile', CAST(p AS VARCHAR), round(v, 4) FROM (SELECT unnest(quantile_cont(length::DOUBLE, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])) AS v, unnest([1, 5, 25, 50, 75, 95, 99]) AS p FROM ecc)
UNION ALL SELECT 'mean_log10', type, round(avg(log10(length)), 6) FROM ecc GROUP BY type""")
def region_quality(spark, d):
    e = ecc(spark, d)
    cell = lambda scope, k, v: (F.lit(scope).alias("scope"), k.cast("string").alias("key"), v.cast("double").alias("value"))
    bins = e.groupBy(length_bin("length").alias("k")).count().select(*cell("length_bin", F.col("k"), F.col("count")))
    top = e.groupBy("chrom").count().orderBy(F.desc("count"), "chrom").limit(15).select(*cell("top_chrom", F.col("chrom"), F.col("count")))
    marks = [1, 5, 25, 50, 75, 95, 99]
    pct = exact_quantiles(e, "length", [p / 100 for p in marks]).select(F.posexplode("q").alias("i", "v")).select(*cell("percentile", F.element_at(F.array(*map(F.lit, marks)), F.col("i") + 1), F.round("v", 4)))
    logs = e.groupBy("type").agg(F.round(F.avg(F.log10("length")), 6).alias("v")).select(*cell("mean_log10", F.col("type"), F.col("v")))
    return bins.unionByName(top).unionByName(pct).unionByName(logs)


@query("""SELECT event_type AS platform, count(*) AS reads, count(DISTINCT user_id) AS molecules, round_even(avg(value), 4) AS mean_value, round_even(count(*) FILTER (user_id % 5 = 0)::DOUBLE / count(*), 6) AS background_rate FROM events GROUP BY 1""")
def truth_statistics(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("platform")).agg(F.count(F.lit(1)).alias("reads"), F.countDistinct("user_id").alias("molecules"), F.bround(F.avg("value"), 4).alias("mean_value"), F.bround(F.count_if(F.col("user_id") % 5 == 0) / F.count(F.lit(1)), 6).alias("background_rate"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'user_' || user_id AS gene FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50""")
def attribute_lookup(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("ID="), "event_id", F.lit(";Name=user_"), "user_id", F.lit(';k "'), F.get_json_object("props", "$.k"), F.lit('"')).alias("attributes"))
    k = tables.gff_attribute("attributes", "k").cast("bigint")
    return e.select("event_id", k.alias("k"), tables.gff_attribute("attributes", "Name").alias("gene")).where("k >= 50")


@query(ctes("ecc", "genome") + """, g AS (SELECT CASE WHEN chrom = 'chr3' THEN '3' ELSE chrom END AS chrom FROM genome), n AS (SELECT name, CASE WHEN chrom IN ('chr3', 'chr5') THEN replace(chrom, 'chr', '') ELSE chrom END AS c FROM ecc)
SELECT name, CASE WHEN c = '3' THEN '3' WHEN c = '5' THEN 'chr5' ELSE c END AS chrom FROM n""")
def chromosome_names(spark, d):
    g = genome(spark).withColumn("chrom", F.when(F.col("chrom") == "chr3", "3").otherwise(F.col("chrom")))
    n = ecc(spark, d).select("name", F.when(F.col("chrom").isin("chr3", "chr5"), F.regexp_replace("chrom", "chr", "")).otherwise(F.col("chrom")).alias("chrom"))
    return tables.resolve_names(n, g).select("name", "chrom")


@query(ctes("ecc") + """ SELECT name, (('0x' || substr(md5(name), 1, 4))::BIGINT % 181 + 50) || ',' || (('0x' || substr(md5(name), 5, 4))::BIGINT % 181 + 50) || ',' || (('0x' || substr(md5(name), 9, 4))::BIGINT % 181 + 50) AS colour FROM ecc""")
def genolink_colours(spark, d):
    return ecc(spark, d).select("name", link_colour("name").alias("colour"))
