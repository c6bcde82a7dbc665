"""Queries on windowed hotspots."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbispan.operators import hotspots, stats
from orbispan.operators.intervals import window_counts
from orbispan.plans.registry import query
from orbispan.plans.views import ctes, ecc, genome

_W = 100_000
_COUNTS = ctes("ecc", "genome") + """, c AS (SELECT rep, chrom, (start + "end") // 2 // 100000 AS idx, count(*) AS n FROM ecc GROUP BY 1, 2, 3),
g AS (SELECT rep, chrom, i AS idx, i * 100000 AS start, least((i + 1) * 100000, size) AS "end" FROM genome, range(0, 101) t(i), (SELECT DISTINCT rep FROM ecc) WHERE i * 100000 < size),
counts AS (SELECT g.rep, g.chrom, g.idx, g.start, g."end", coalesce(n, 0) AS count FROM g LEFT JOIN c ON g.rep = c.rep AND g.chrom = c.chrom AND g.idx = c.idx),
med AS (SELECT rep, quantile_cont(count, 0.5) AS median FROM counts WHERE count > 0 GROUP BY 1),
hot AS (SELECT counts.*, median, count / median AS fold, count > 0 AND count >= 1.6::DOUBLE * median AS is_hotspot FROM counts JOIN med USING (rep))"""
_CLASSES = _COUNTS + """, w AS (SELECT substr(rep, 2, 1) AS grp, rep, chrom, start, "end" FROM hot WHERE is_hotspot),
tot AS (SELECT substr(rep, 2, 1) AS grp, count(DISTINCT rep) AS total FROM ecc GROUP BY 1),
per AS (SELECT grp, chrom, start, "end", count(*) AS hits FROM w GROUP BY 1, 2, 3, 4),
cls AS (SELECT per.*, total, CASE WHEN hits = total THEN 'core' WHEN hits >= 2 THEN 'recurrent' ELSE 'sporadic' END AS cat FROM per JOIN tot USING (grp)),
full_ AS (SELECT a.grp, a.chrom, a.start, a."end", a.cat AS replicate_category, a.hits AS n_replicates_hit, a.total AS n_replicates_total,
  coalesce((SELECT string_agg(b.grp, ';' ORDER BY b.grp) FROM cls b WHERE b.cat = 'core' AND b.grp <> a.grp AND b.chrom = a.chrom AND b.start = a.start), '') AS shared_with FROM cls a)"""


@query(ctes("ecc", "genome") + """, s AS (SELECT * FROM (VALUES (10000, '10kb'), (100000, '100kb'), (1000000, '1Mb')) t(size_, window_size)),
g AS (SELECT window_size, size_, chrom, i AS idx, i * size_ AS start, least((i + 1) * size_, size) AS "end" FROM genome, s, range(0, 1001) t(i) WHERE i * size_ < size),
c AS (SELECT size_, chrom, (start + "end") // 2 // size_ AS idx, count(*) AS n FROM ecc, s GROUP BY 1, 2, 3)
SELECT window_size, g.chrom, start, "end", coalesce(n, 0) AS count FROM g LEFT JOIN c ON g.size_ = c.size_ AND g.chrom = c.chrom AND g.idx = c.idx""")
def multiscale_matrix(spark, d):
    return hotspots.multiscale_counts(ecc(spark, d), genome(spark), (10_000, 100_000, 1_000_000))


def _hot(spark, d):
    counts = window_counts(hotspots.with_midpoints(ecc(spark, d)), genome(spark), _W, keys=["rep"])
    return hotspots.fold_hotspots(counts, 1.6, ["rep"])


@query(_COUNTS + """ SELECT rep, chrom, idx, start, "end", count, median, round(fold, 6) AS fold, is_hotspot FROM hot""")
def fold_hotspots(spark, d):
    return _hot(spark, d).withColumn("fold", F.round("fold", 6))


def _classes(spark, d):
    grp = F.substring("rep", 2, 1).alias("grp")
    windows = _hot(spark, d).where("is_hotspot").select(grp, "rep", "chrom", "start", "end")
    totals = ecc(spark, d).groupBy(grp).agg(F.countDistinct("rep").alias("n_replicates_total"))
    return hotspots.replicate_classes(windows, totals)


@query(_CLASSES + """ SELECT grp, chrom, start, "end", replicate_category, n_replicates_hit, n_replicates_total, CASE WHEN shared_with = '' THEN 'group_specific' ELSE 'shared' END AS specificity, shared_with FROM full_""")
def hotspot_replicates(spark, d):
    return _classes(spark, d)


@query(_CLASSES + """, wide AS (SELECT chrom, start, max(count) FILTER (rep = 'AF') AS a, max(count) FILTER (rep = 'NF') AS n, max(count) FILTER (rep = 'RF') AS r FROM counts GROUP BY 1, 2)
SELECT grp, chrom, start, "end", replicate_category, coalesce(a, 0) AS "AF_count", coalesce(n, 0) AS "NF_count", coalesce(r, 0) AS "RF_count" FROM full_ JOIN wide USING (chrom, start) WHERE grp = 'F'""")
def hotspot_replicate_counts(spark, d):
    counts = _hot(spark, d).select("rep", "chrom", "start", "count")
    out = hotspots.replicate_counts(_classes(spark, d).where("grp = 'F'"), counts, ["AF", "NF", "RF"])
    return out.select("grp", "chrom", "start", "end", "replicate_category", "AF_count", "NF_count", "RF_count")


@query(_CLASSES + """ SELECT grp, count(*) AS total_hotspots, count(*) FILTER (replicate_category = 'core') AS core, count(*) FILTER (replicate_category = 'recurrent') AS recurrent, count(*) FILTER (replicate_category = 'sporadic') AS sporadic FROM full_ GROUP BY 1""")
def hotspot_summary(spark, d):
    return hotspots.hotspot_summary(_classes(spark, d))


@query(_COUNTS + """, h AS (SELECT DISTINCT chrom, start, "end" FROM hot WHERE is_hotspot), m AS (SELECT chrom, (start + "end") // 2 AS pos FROM ecc),
s AS (SELECT h.chrom, h.start, h."end", least((pos - h.start) // 5000, greatest(1, CAST(ceil((h."end" - h.start) / 5000.0) AS BIGINT)) - 1) AS sub, count(*) AS n FROM h JOIN m ON h.chrom = m.chrom AND pos >= h.start AND pos < h."end" GROUP BY 1, 2, 3, 4),
p AS (SELECT *, max(n) OVER (PARTITION BY chrom, start, "end") AS peak FROM s),
k AS (SELECT chrom, start, "end", min(sub) AS lo, max(sub) AS hi FROM p WHERE n >= 0.5::DOUBLE * peak GROUP BY 1, 2, 3),
r AS (SELECT h.chrom, h.start, h."end", coalesce(h.start + lo * 5000, h.start) AS refined_start, coalesce(CASE WHEN hi IS NOT NULL THEN least(h.start + (hi + 1) * 5000, h."end") END, h."end") AS refined_end FROM h LEFT JOIN k ON h.chrom = k.chrom AND h.start = k.start AND h."end" = k."end")
SELECT *, refined_start <> start OR refined_end <> "end" AS refined FROM r""")
def hotspot_refine(spark, d):
    hot = _hot(spark, d).where("is_hotspot").select("chrom", "start", "end").distinct()
    return hotspots.refine(hot, ecc(spark, d), 5000, 0.5)


def _halved(levels: int) -> str:
    """Permuted counts of windows: the points of a stretch of windows fall to its first half by a binomial draw, level by level."""
    out = ctes("ecc", "genome") + """, c AS (SELECT chrom, (start + "end") // 2 // 100000 AS idx, count(*) AS n FROM ecc GROUP BY 1, 2),
w AS (SELECT g.chrom, i AS idx, i * 100000 AS start, least((i + 1) * 100000, size) AS "end", coalesce(n, 0) AS count FROM genome g, range(0, 101) t(i) LEFT JOIN c ON c.chrom = g.chrom AND c.idx = i WHERE i * 100000 < size),
l0 AS (SELECT chrom, perm, CAST(0 AS BIGINT) AS lo, max(idx) + 1 AS hi, CAST(sum(count) AS BIGINT) AS n FROM w, range(0, 1000) x(perm) GROUP BY 1, 2 HAVING sum(count) > 0)"""
    for i in range(levels):
        out += f""",
h{i} AS (SELECT l.*, m, s FROM l{i} l JOIN (SELECT chrom, lo, hi, (lo + hi) // 2 AS m, (least((lo + hi) // 2 * 100000, size) - lo * 100000)::DOUBLE / (least(hi * 100000, size) - lo * 100000) AS s FROM (SELECT DISTINCT chrom, lo, hi FROM l{i} WHERE hi - lo > 1) JOIN genome USING (chrom)) USING (chrom, lo, hi)),
b{i} AS (SELECT n, s, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(s) + (n - k) * ln(1 - s)) AS pmf FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM (SELECT DISTINCT n, s FROM h{i}))),
t{i} AS (SELECT n, s, k, coalesce(sum(pmf) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) / sum(pmf) OVER (PARTITION BY n, s) AS below FROM b{i} WINDOW v AS (PARTITION BY n, s ORDER BY k)),
d{i} AS (SELECT *, CAST('0x' || substr(md5('42:' || chrom || ':' || perm || ':' || lo || ':' || hi), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS u FROM h{i}),
k{i} AS (SELECT d.*, t.k FROM d{i} d ASOF JOIN t{i} t ON d.n = t.n AND d.s = t.s AND d.u >= t.below),
l{i + 1} AS (SELECT chrom, perm, lo, hi, n FROM l{i} WHERE hi - lo = 1 UNION ALL SELECT chrom, perm, lo, m, k FROM k{i} UNION ALL SELECT chrom, perm, m, hi, n - k FROM k{i})"""
    return out


@query(_halved(7) + """, o AS (SELECT w.chrom, w.idx, count(*) FILTER (n >= count) AS reached FROM w JOIN l7 ON l7.chrom = w.chrom AND l7.lo = w.idx WHERE count > 0 GROUP BY 1, 2),
p AS (SELECT w.*, (coalesce(reached, 1000) + 1) / 1001.0::DOUBLE AS p FROM w LEFT JOIN o USING (chrom, idx)),
r AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS raw FROM p),
q AS (SELECT *, least(1.0::DOUBLE, min(raw) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS q FROM r)
SELECT chrom, idx, start, "end", CAST(count AS INTEGER) AS count, round(p, 9) AS p_value, round(q, 9) AS q_value, count > 0 AND count >= 1.6::DOUBLE * (SELECT quantile_cont(count, 0.5) FROM w WHERE count > 0) AND q < 0.05 AS is_hotspot FROM q""")
def hotspot_permutation_test(spark, d):
    out = hotspots.permutation_test(ecc(spark, d), genome(spark), _W, fold=1.6)
    return out.select("chrom", "idx", "start", "end", "count", F.round("p_value", 9).alias("p_value"), F.round("q_value", 9).alias("q_value"), "is_hotspot")


@query("""WITH p AS (SELECT o_orderkey, (o_orderkey * 7919 % 1000 + 1) / 1001.0::DOUBLE AS p FROM orders), r AS (SELECT *, count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS rk, count(*) OVER () AS n FROM p)
SELECT o_orderkey, round(p, 9) AS p_value, round(min(least(1.0, p * n / rk)) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING), 9) AS q_value FROM r""")
def benjamini_hochberg(spark, d):
    p = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", ((F.col("o_orderkey") * 7919 % 1000 + 1) / F.lit(1001.0)).alias("p_value"))
    return stats.benjamini_hochberg(p).select("o_orderkey", F.round("p_value", 9).alias("p_value"), F.round("q_value", 9).alias("q_value"))
