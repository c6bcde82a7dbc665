"""Queries on interval joins, merging, tiles and overlap between samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbispan.functions.regions import cnv_category, midpoint
from orbispan.operators import enrich, intervals, overlaps
from orbispan.plans.registry import query
from orbispan.plans.views import annot, ctes, ecc, genome

_W = 100_000
_RECIP = """(SELECT DISTINCT a.sample AS sa, b.sample AS sb, a.name FROM ecc a JOIN ecc b ON a.chrom = b.chrom AND a.sample <> b.sample AND a.start < b."end" AND b.start < a."end"
  WHERE least(a."end", b."end") - greatest(a.start, b.start) >= 0.5::DOUBLE * a.length AND least(a."end", b."end") - greatest(a.start, b.start) >= 0.5::DOUBLE * b.length)"""
_TILES = """tiles AS (SELECT chrom, i AS idx, i * 100000 AS start, least((i + 1) * 100000, size) AS "end" FROM genome, range(0, 101) t(i) WHERE i * 100000 < size)"""
_MERGED = """m0 AS (SELECT chrom, start, "end", max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM annot),
m1 AS (SELECT *, sum(CASE WHEN seen IS NULL OR start > seen THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM m0),
merged AS (SELECT chrom, min(start) AS start, max("end") AS "end" FROM m1 GROUP BY chrom, island)"""


@query(ctes("ecc", "annot") + """ SELECT e.sample, count(*) AS n FROM ecc e WHERE EXISTS (SELECT 1 FROM annot a WHERE a.chrom = e.chrom AND a.start < e."end" AND e.start < a."end") GROUP BY 1""")
def overlap_semi_count(spark, d):
    hit = intervals.overlap_join(ecc(spark, d).select("name", "chrom", "start", "end", "sample"), annot(spark, d).select("chrom", "start", "end"), ("a_", "b_"))
    return hit.select("a_name", "a_sample").distinct().groupBy(F.col("a_sample").alias("sample")).agg(F.count(F.lit(1)).alias("n"))


@query(ctes("ecc", "annot") + """ SELECT name FROM ecc e WHERE NOT EXISTS (SELECT 1 FROM annot a WHERE a.chrom = e.chrom AND a.start < e."end" AND e.start < a."end")""")
def overlap_anti(spark, d):
    names = intervals.overlapping_names(ecc(spark, d).select("name", "chrom", "start", "end"), annot(spark, d).select("chrom", "start", "end"))
    return ecc(spark, d).select("name").join(names, "name", "left_anti")


@query(ctes("ecc", "annot") + """, r AS (SELECT *, CASE WHEN cnv > 1.2 THEN 'gain' WHEN cnv < 0.8 THEN 'loss' ELSE 'neutral' END AS category FROM annot)
SELECT category, count(DISTINCT name) AS count FROM ecc e JOIN r ON r.chrom = e.chrom AND r.start < e."end" AND e.start < r."end" GROUP BY 1""")
def cnv_category_overlap(spark, d):
    regions = annot(spark, d).withColumn("category", cnv_category("cnv"))
    return enrich.count_by_category(ecc(spark, d), regions, "category")


@query(ctes("annot") + ", " + _MERGED + " SELECT * FROM merged")
def interval_merge(spark, d):
    return intervals.merged(annot(spark, d))


@query(ctes("annot", "genome") + ", " + _MERGED + """,
gaps AS (SELECT chrom, coalesce(lag("end") OVER (PARTITION BY chrom ORDER BY start), 0) AS start, start AS "end" FROM merged
  UNION ALL SELECT m.chrom, max("end"), any_value(size) FROM merged m JOIN genome USING (chrom) GROUP BY m.chrom)
SELECT chrom, start, "end" FROM gaps WHERE "end" > start UNION ALL SELECT chrom, 0, size FROM genome WHERE chrom NOT IN (SELECT chrom FROM gaps WHERE "end" > start)""")
def interval_complement(spark, d):
    return intervals.complement(annot(spark, d), genome(spark))


@query(ctes("ecc", "genome") + ", " + _TILES + """, c AS (SELECT chrom, (start + "end") // 2 // 100000 AS idx, count(*) AS n FROM ecc GROUP BY 1, 2)
SELECT t.chrom, t.idx, t.start, t."end", coalesce(n, 0) AS count FROM tiles t LEFT JOIN c USING (chrom, idx)""")
def window_assignment(spark, d):
    return intervals.window_counts(ecc(spark, d).withColumn("pos", midpoint()), genome(spark), _W)


@query(ctes("annot", "genome") + ", " + _TILES + """ SELECT t.chrom, t.idx, t.start, t."end", round(coalesce(sum(CASE WHEN a.start IS NOT NULL THEN least(a."end", t."end") - greatest(a.start, t.start) END), 0)::DOUBLE / (t."end" - t.start), 8) AS coverage
FROM tiles t LEFT JOIN annot a ON a.chrom = t.chrom AND a.start < t."end" AND t.start < a."end" GROUP BY t.chrom, t.idx, t.start, t."end\"""")
def tile_coverage(spark, d):
    return intervals.tile_coverage(annot(spark, d), genome(spark), _W).withColumn("coverage", F.round("coverage", 8))


@query(ctes("annot", "genome") + ", " + _TILES + """ SELECT t.chrom, t.idx, t.start, t."end", round(coalesce(sum(cnv * (least(a."end", t."end") - greatest(a.start, t.start))) / sum(least(a."end", t."end") - greatest(a.start, t.start)), 1.0), 6) AS mean
FROM tiles t LEFT JOIN annot a ON a.chrom = t.chrom AND a.start < t."end" AND t.start < a."end" GROUP BY t.chrom, t.idx, t.start, t."end\"""")
def tile_weighted_cnv(spark, d):
    return intervals.tile_weighted_mean(annot(spark, d), genome(spark), _W, "cnv").withColumn("mean", F.round("mean", 6))


@query(ctes("annot", "genome") + """ SELECT g.chrom, round(coalesce(sum(cnv * (a."end" - a.start)) / sum(a."end" - a.start), 1.0), 6) AS cnv FROM genome g LEFT JOIN annot a USING (chrom) GROUP BY g.chrom""")
def chromosome_cnv(spark, d):
    return enrich.chromosome_cnv(annot(spark, d), genome(spark)).withColumn("cnv", F.round("cnv", 6))


@query(ctes("annot") + """ SELECT DISTINCT chrom, unnest(range(start // 2000, ("end" - 1) // 2000 + 1)) AS idx FROM annot""")
def regions_to_tiles(spark, d):
    return enrich.regions_to_tiles(annot(spark, d), 2000)


@query(ctes("ecc", "annot") + """, b AS (SELECT DISTINCT chrom, unnest([start, "end"]) AS p FROM annot), t AS (SELECT chrom, (greatest(0, p - 50000) + p + 50000) // 2 AS p FROM b),
q AS (SELECT name, chrom, (start + "end") // 2 AS pos FROM ecc),
x AS (SELECT q.name, q.pos, q.chrom, t.p AS lo FROM q ASOF LEFT JOIN t ON q.chrom = t.chrom AND q.pos >= t.p),
y AS (SELECT q.name, t.p AS hi FROM q ASOF LEFT JOIN t ON q.chrom = t.chrom AND q.pos <= t.p)
SELECT name, chrom, pos, least(coalesce(pos - lo, hi - pos), coalesce(hi - pos, pos - lo)) AS distance FROM x JOIN y USING (name) WHERE lo IS NOT NULL OR hi IS NOT NULL""")
def nearest_boundary(spark, d):
    return enrich.boundary_distances(ecc(spark, d), annot(spark, d)).select("name", "chrom", "pos", "distance")


@query(ctes("ecc", "annot") + """, q AS (SELECT name, chrom, (start + "end") // 2 AS pos FROM ecc), t AS (SELECT te_name, chrom, start // 500 * 500 AS pos FROM annot),
p AS (SELECT DISTINCT chrom, pos FROM t), x AS (SELECT q.*, p.pos AS lo FROM q ASOF LEFT JOIN p ON q.chrom = p.chrom AND q.pos >= p.pos), y AS (SELECT q.name, p.pos AS hi FROM q ASOF LEFT JOIN p ON q.chrom = p.chrom AND q.pos <= p.pos),
d AS (SELECT name, chrom, pos, least(coalesce(pos - lo, hi - pos), coalesce(hi - pos, pos - lo)) AS distance FROM x JOIN y USING (name))
SELECT d.name, d.distance, count(*) AS n_targets, min(t.te_name) AS first_target, max(t.te_name) AS last_target FROM d JOIN t ON d.chrom = t.chrom AND abs(t.pos - d.pos) = d.distance GROUP BY 1, 2""")
def nearest_targets(spark, d):
    """All nearest starts of annotations, many of which stand at one place, for each call's middle."""
    t = annot(spark, d).select("te_name", "chrom", (F.floor(F.col("start") / 500) * 500).alias("pos"))
    q = ecc(spark, d).select("name", "chrom", F.floor((F.col("start") + F.col("end")) / 2).alias("pos"))
    found = intervals.nearest_targets(q, t)
    return found.groupBy("name", "distance").agg(F.count(F.lit(1)).alias("n_targets"), F.min("target_te_name").alias("first_target"), F.max("target_te_name").alias("last_target"))


@query(ctes("ecc") + ", s AS (SELECT sa, sb, count(*) AS n FROM " + _RECIP + """ GROUP BY 1, 2), k AS (SELECT sample, count(*) AS n FROM ecc GROUP BY 1)
SELECT a.sample AS sample_a, b.sample AS sample_b, a.n AS n_a, b.n AS n_b, coalesce(s.n, 0) AS n_shared, round_even(coalesce(s.n, 0)::DOUBLE / a.n, 6) AS overlap_fraction
FROM k a JOIN k b ON a.sample <> b.sample LEFT JOIN s ON s.sa = a.sample AND s.sb = b.sample""")
def sample_overlap(spark, d):
    return overlaps.pair_overlap(ecc(spark, d), "sample", 0.5)


@query(ctes("ecc") + ", s AS (SELECT sa, sb, count(*) AS n FROM " + _RECIP + """ GROUP BY 1, 2), k AS (SELECT sample, count(*) AS n FROM ecc GROUP BY 1),
p AS (SELECT a.sample AS sa, b.sample AS sb, CASE WHEN a.sample = b.sample THEN 100.0 ELSE 100 * round_even(coalesce(s.n, 0)::DOUBLE / a.n, 6) END AS pct FROM k a CROSS JOIN k b LEFT JOIN s ON s.sa = a.sample AND s.sb = b.sample)
SELECT sa AS sample, round(max(pct) FILTER (sb = 'F'), 6) AS "F", round(max(pct) FILTER (sb = 'O'), 6) AS "O" FROM p GROUP BY 1""")
def sample_overlap_matrix(spark, d):
    m = overlaps.overlap_matrix(sample_overlap(spark, d), ["F", "O"])
    return m.select("sample", F.round("F", 6).alias("F"), F.round("O", 6).alias("O"))


_NWAY = ctes("ecc") + """, p AS (SELECT DISTINCT a.rep, a.name, b.rep AS other FROM ecc a JOIN ecc b ON a.chrom = b.chrom AND a.rep <> b.rep AND a.start < b."end" AND b.start < a."end"
  WHERE least(a."end", b."end") - greatest(a.start, b.start) >= 0.5::DOUBLE * a.length AND least(a."end", b."end") - greatest(a.start, b.start) >= 0.5::DOUBLE * b.length),
o AS (SELECT rep, name, string_agg(other, '+' ORDER BY other) AS others, count(*) AS n FROM p GROUP BY 1, 2),
w AS (SELECT e.rep, e.name, coalesce(others, '') AS others, CAST(coalesce(n, 0) AS INTEGER) AS n_others, CASE WHEN n IS NULL THEN e.rep || '_only' ELSE e.rep || '+' || others END AS category FROM ecc e LEFT JOIN o USING (rep, name))"""


@query(_NWAY + " SELECT * FROM w")
def nway_classification(spark, d):
    return overlaps.nway(ecc(spark, d), "rep", 0.5)


@query(_NWAY + " SELECT rep, category, count(*) AS count FROM w GROUP BY 1, 2")
def nway_summary(spark, d):
    return overlaps.nway_summary(nway_classification(spark, d), "rep")
