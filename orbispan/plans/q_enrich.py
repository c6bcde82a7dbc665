"""Queries on enrichment, correlation, expression and capture-recapture statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbispan.functions.regions import cnv_category
from orbispan.operators import cecc, enrich, expression, overlaps, stats
from orbispan.plans.registry import query
from orbispan.plans.views import annot, ctes, ecc, genome, table

_FEATURES = ctes("ecc", "annot", "genome") + """, tiles AS (SELECT chrom, i AS idx, i * 100000 AS start, least((i + 1) * 100000, size) AS "end" FROM genome, range(0, 101) t(i) WHERE i * 100000 < size),
c AS (SELECT chrom, (start + "end") // 2 // 100000 AS idx, count(*) AS n FROM ecc GROUP BY 1, 2),
w AS (SELECT t.*, coalesce(n, 0) AS count FROM tiles t LEFT JOIN c USING (chrom, idx)),
h AS (SELECT *, count > 0 AND count >= 1.3::DOUBLE * (SELECT quantile_cont(count, 0.5) FROM w WHERE count > 0) AS is_hotspot FROM w),
cov AS (SELECT t.chrom, t.idx, a.te_class, sum(least(a."end", t."end") - greatest(a.start, t.start)) AS bp FROM tiles t JOIN annot a ON a.chrom = t.chrom AND a.start < t."end" AND t.start < a."end" GROUP BY 1, 2, 3),
fm AS (SELECT h.chrom, h.idx, h.start, h."end", h.count, h.is_hotspot, k.te_class, coalesce(bp, 0)::DOUBLE / (h."end" - h.start) AS coverage FROM h CROSS JOIN (SELECT DISTINCT te_class FROM annot) k LEFT JOIN cov ON cov.chrom = h.chrom AND cov.idx = h.idx AND cov.te_class = k.te_class)"""
_PAIRS = ctes("ecc", "annot", "genome") + """, tiles AS (SELECT chrom, i AS idx, i * 100000 AS start, least((i + 1) * 100000, size) AS "end" FROM genome, range(0, 101) t(i) WHERE i * 100000 < size),
cn AS (SELECT t.chrom, t.idx, coalesce(sum(cnv * (least(a."end", t."end") - greatest(a.start, t.start))) / sum(least(a."end", t."end") - greatest(a.start, t.start)), 1.0) AS mean FROM tiles t LEFT JOIN annot a ON a.chrom = t.chrom AND a.start < t."end" AND t.start < a."end" GROUP BY 1, 2),
c AS (SELECT rep, chrom, (start + "end") // 2 // 100000 AS idx, count(*) AS n FROM ecc GROUP BY 1, 2, 3),
dd AS (SELECT r.rep, t.chrom, t.idx, coalesce(n, 0) AS x, coalesce(n, 0) / greatest(mean, 0.1) AS nx FROM tiles t CROSS JOIN (SELECT DISTINCT rep FROM ecc) r JOIN cn USING (chrom, idx) LEFT JOIN c ON c.rep = r.rep AND c.chrom = t.chrom AND c.idx = t.idx),
pr AS (SELECT a.rep AS rep_a, b.rep AS rep_b, a.chrom, a.idx, a.x, b.x AS y, a.nx, b.nx AS ny FROM dd a JOIN dd b ON a.chrom = b.chrom AND a.idx = b.idx AND a.rep < b.rep)"""


@query(_FEATURES + """ SELECT chrom, idx, start, "end", count, is_hotspot, te_class, round(coverage, 8) AS coverage FROM fm""")
def feature_matrix(spark, d):
    return enrich.feature_matrix(ecc(spark, d), annot(spark, d), genome(spark), 100_000, 1.3).withColumn("coverage", F.round("coverage", 8))


@query(_FEATURES + """, r AS (SELECT *, rank() OVER (PARTITION BY te_class ORDER BY coverage) + (count(*) OVER (PARTITION BY te_class, coverage) - 1) / 2.0::DOUBLE AS rk FROM fm)
SELECT te_class, count(*) FILTER (is_hotspot) AS n1, count(*) FILTER (NOT is_hotspot) AS n2, sum(rk) FILTER (is_hotspot) - count(*) FILTER (is_hotspot) * (count(*) FILTER (is_hotspot) + 1) / 2.0::DOUBLE AS u,
round(avg(coverage) FILTER (is_hotspot), 8) AS mean_hotspot, round(avg(coverage) FILTER (NOT is_hotspot), 8) AS mean_other FROM r GROUP BY 1""")
def feature_enrichment(spark, d):
    m = enrich.feature_matrix(ecc(spark, d), annot(spark, d), genome(spark), 100_000, 1.3)
    return enrich.feature_enrichment(m).select("te_class", "n1", "n2", F.when(F.col("n1") > 0, F.col("u")).alias("u"), F.round("mean_hotspot", 8).alias("mean_hotspot"), F.round("mean_other", 8).alias("mean_other"))


# the normal form of the test, with ties; 1 - erf(x) from the series of erf, whose terms are all positive
@query(_FEATURES + """, r AS (SELECT *, rank() OVER (PARTITION BY te_class ORDER BY coverage) + (count(*) OVER (PARTITION BY te_class, coverage) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY te_class, coverage) AS ties FROM fm),
k AS (SELECT te_class, count(*) FILTER (is_hotspot) AS n1, count(*) FILTER (NOT is_hotspot) AS n2, coalesce(sum(rk) FILTER (is_hotspot), 0) AS s, sum(ties::DOUBLE * ties - 1) AS t, avg(coverage) FILTER (is_hotspot) AS mh, avg(coverage) FILTER (NOT is_hotspot) AS mo FROM r GROUP BY 1),
u AS (SELECT *, s - n1 * (n1 + 1) / 2.0::DOUBLE AS u, n1 + n2 AS n FROM k),
z AS (SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2.0::DOUBLE - 0.5::DOUBLE) / sqrt(n1 * n2 / 12.0::DOUBLE * (n + 1 - t / (n * (n - 1)))) / sqrt(2.0::DOUBLE) AS x FROM u),
e AS (SELECT te_class, sum(CASE WHEN i = 0 THEN x ELSE sign(x) * exp(i * ln(2 * x * x) + ln(abs(x)) + (lgamma(i + 1) + i * ln(2.0::DOUBLE) - lgamma(2 * i + 2))) END) AS series FROM z, range(0, 400) t(i) GROUP BY 1),
p AS (SELECT z.*, greatest(0.0, least(1.0, 1 - 2 / sqrt(pi()) * exp(-x * x) * series)) AS p FROM z JOIN e USING (te_class)),
q AS (SELECT *, p * count(*) OVER () / rank() OVER (ORDER BY p) AS raw FROM p)
SELECT te_class, n1, n2, u, round(p, 8) AS p_value, round(least(1.0, min(raw) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), 8) AS q_value, round(mh, 8) AS mean_hotspot, round(mo, 8) AS mean_other FROM q""")
def feature_enrichment_p(spark, d):
    m = enrich.feature_matrix(ecc(spark, d), annot(spark, d), genome(spark), 100_000, 1.3)
    out = enrich.feature_enrichment(m)
    return out.select("te_class", "n1", "n2", "u", *[F.round(c, 8).alias(c) for c in ("p_value", "q_value", "mean_hotspot", "mean_other")])


@query(_PAIRS + """, r AS (SELECT *, rank() OVER (PARTITION BY rep_a, rep_b ORDER BY x) + (count(*) OVER (PARTITION BY rep_a, rep_b, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY rep_a, rep_b ORDER BY y) + (count(*) OVER (PARTITION BY rep_a, rep_b, y) - 1) / 2.0::DOUBLE AS ry FROM pr)
SELECT rep_a, rep_b, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(corr(nx, ny), 6) AS norm_pearson FROM r GROUP BY 1, 2""")
def cnv_correlation(spark, d):
    p = enrich.density_pairs(ecc(spark, d), annot(spark, d), genome(spark), 100_000)
    r = lambda c: F.round(c, 6).alias(c)
    return enrich.replicate_correlations(p).select("rep_a", "rep_b", "n", r("pearson"), r("spearman"), r("norm_pearson"))


@query(_PAIRS + """, per AS (SELECT chrom, rep_a, rep_b, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS r FROM pr GROUP BY 1, 2, 3 HAVING count(*) >= 20) SELECT chrom, round(avg(r), 6) AS pearson, count(r) AS n_pairs FROM per GROUP BY 1""")
def cnv_intra_chromosome(spark, d):
    p = enrich.density_pairs(ecc(spark, d), annot(spark, d), genome(spark), 100_000)
    return enrich.intra_chromosome_correlations(p).withColumn("pearson", F.round("pearson", 6))


@query(_PAIRS + """, cc AS (SELECT g.chrom, coalesce(sum(cnv * (a."end" - a.start)) / sum(a."end" - a.start), 1.0) AS cnv FROM genome g LEFT JOIN annot a USING (chrom) GROUP BY 1),
far AS (SELECT chrom FROM cc ORDER BY abs(cnv - 1) DESC, chrom LIMIT 1)
SELECT rep_a, rep_b, count(*) AS n, round(corr(x, y), 6) AS pearson FROM pr WHERE chrom NOT IN (SELECT chrom FROM far) GROUP BY 1, 2""")
def cnv_correlation_excluding(spark, d):
    p = enrich.density_pairs(ecc(spark, d), annot(spark, d), genome(spark), 100_000)
    far = enrich.most_altered(enrich.chromosome_cnv(annot(spark, d), genome(spark)))
    kept = p.join(F.broadcast(far.select("chrom")), "chrom", "left_anti")
    return kept.groupBy("rep_a", "rep_b").agg(F.count(F.lit(1)).alias("n"), F.round(stats.pearson("x", "y"), 6).alias("pearson"))


# chances from the gaps between regions, binomial distributions by length, and draws by digests through their inverses
_PLACED = ctes("ecc", "annot", "genome") + """, r AS (SELECT chrom, greatest(start, 0) AS start, least("end", size) AS "end", size, {0} AS category FROM annot JOIN genome USING (chrom)),
g AS (SELECT chrom, category, start - coalesce(max("end") OVER (PARTITION BY chrom, category ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap FROM r
  UNION ALL SELECT k.chrom, k.category, k.size - coalesce(max(r."end"), 0) FROM (SELECT chrom, size, category FROM genome, (SELECT DISTINCT category FROM r)) k LEFT JOIN r ON r.chrom = k.chrom AND r.category = k.category GROUP BY k.chrom, k.category, k.size),
l AS (SELECT "end" - start AS length, count(*) AS n FROM ecc GROUP BY 1),
f AS (SELECT chrom, category, length, n, CAST(sum(greatest(0, gap - length + 1)) AS DOUBLE) AS free FROM g, l GROUP BY 1, 2, 3, 4),
c AS (SELECT category, length, n, CAST(1 - sum(size * least(1.0::DOUBLE, free / greatest(1, size - length + 1))) / sum(size) AS DOUBLE) AS p FROM f JOIN genome USING (chrom) GROUP BY 1, 2, 3),
b AS (SELECT category, length, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p)) AS pmf FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM c)),
t AS (SELECT category, length, k, coalesce(sum(pmf) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) / sum(pmf) OVER (PARTITION BY category, length) AS below FROM b WINDOW w AS (PARTITION BY category, length ORDER BY k)),
d AS (SELECT category, length, perm, CAST('0x' || substr(md5('42:' || category || ':' || length || ':' || perm), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS u FROM c, range(0, 1000) x(perm)),
m AS (SELECT d.category, d.perm, sum(t.k) AS hits FROM d ASOF JOIN t ON d.category = t.category AND d.length = t.length AND d.u >= t.below GROUP BY 1, 2),
o AS (SELECT category, count(DISTINCT name) AS observed FROM ecc JOIN r ON r.chrom = ecc.chrom AND ecc.start < r."end" AND r.start < ecc."end" GROUP BY 1),
s AS (SELECT category, coalesce(max(observed), 0) AS observed, count(*) AS n_perm, avg(hits) AS mean, stddev_pop(hits) AS sd, (count(*) FILTER (hits >= coalesce(observed, 0)) + 1) / (count(*) + 1.0::DOUBLE) AS p FROM m LEFT JOIN o USING (category) GROUP BY 1),
q AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS raw FROM s)
SELECT category, observed, n_perm, round(mean, 6) AS mean, round(sd, 6) AS sd, round(p, 9) AS p_value, round(observed / mean, 6) AS fold, round(least(1.0::DOUBLE, min(raw) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 9) AS q_value FROM q"""


def _placed(out):
    return out.select("category", "observed", "n_perm", *[F.round(c, k).alias(c) for c, k in (("mean", 6), ("sd", 6), ("p_value", 9), ("fold", 6), ("q_value", 9))])


@query(_PLACED.format("CASE WHEN cnv > 1.2 THEN 'gain' WHEN cnv < 0.8 THEN 'loss' ELSE 'neutral' END"))
def cnv_enrichment(spark, d):
    """Observed against random placement for each copy number category."""
    regions = annot(spark, d).withColumn("category", cnv_category("cnv"))
    return _placed(enrich.overlap_test(ecc(spark, d), regions, genome(spark), category="category"))


@query(_PLACED.format("'all'"))
def overlap_enrichment(spark, d):
    return _placed(enrich.overlap_test(ecc(spark, d), annot(spark, d), genome(spark)))


@query()
def boundary_enrichment(spark, d):
    return enrich.boundary_test(ecc(spark, d), annot(spark, d), genome(spark))


_DEG = """WITH deg AS (SELECT 'g' || user_id AS gene_name, round(avg(value) / 25.0 - 2.0, 6) AS log2fc, (user_id % 97) / 970.0::DOUBLE AS padj FROM events GROUP BY user_id),
gs AS (SELECT DISTINCT 'g' || user_id AS gene_name FROM events WHERE event_type = 'error' AND user_id % 3 = 0)"""


def _deg(spark, d):
    e = table(spark, d, "events")
    deg = e.groupBy("user_id").agg(F.round(F.avg("value") / 25.0 - 2.0, 6).alias("log2fc")).select(F.concat(F.lit("g"), "user_id").alias("gene_name"), "log2fc", (F.col("user_id") % 97 / F.lit(970.0)).alias("padj"))
    genes = expression.gene_set(e.where("event_type = 'error' AND user_id % 3 = 0").select(F.concat(F.lit("g"), "user_id").alias("gene_name")))
    return deg, genes


@query(_DEG + """, t AS (SELECT * FROM (VALUES ('up', 1), ('down', -1)) a(direction, sign), (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) b(threshold)),
f AS (SELECT direction, threshold, log2fc * sign >= threshold AND padj < 0.05 AS hit, gene_name IN (SELECT gene_name FROM gs) AS ins FROM deg, t),
k AS (SELECT direction, threshold, count(*) FILTER (hit AND ins) AS a, count(*) FILTER (hit AND NOT ins) AS b, count(*) FILTER (NOT hit AND ins) AS c, count(*) FILTER (NOT hit AND NOT ins) AS d FROM f GROUP BY 1, 2)
SELECT direction, threshold, a, b, c, d, round(CASE WHEN a + c > 0 AND a + b > 0 THEN (a::DOUBLE / (a + c)) / ((a + b)::DOUBLE / (a + b + c + d)) ELSE 0 END, 6) AS enrichment FROM k""")
def deg_enrichment(spark, d):
    out = expression.deg_enrichment(*_deg(spark, d), thresholds=(0.25, 0.5, 1.0))
    return out.withColumn("enrichment", F.round("enrichment", 6)).drop("p_value")


_LOG_P = "lgamma(a + c + 1) - lgamma({0} + 1) - lgamma(a + c - {0} + 1) + lgamma(b + d + 1) - lgamma(a + b - {0} + 1) - lgamma(d - a + {0} + 1) - lgamma(a + b + c + d + 1) + lgamma(a + b + 1) + lgamma(c + d + 1)"


@query(_DEG + f""", t AS (SELECT * FROM (VALUES ('up', 1), ('down', -1)) a(direction, sign), (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) b(threshold)),
f AS (SELECT direction, threshold, log2fc * sign >= threshold AND padj < 0.05 AS hit, gene_name IN (SELECT gene_name FROM gs) AS ins FROM deg, t),
k AS (SELECT direction, threshold, count(*) FILTER (hit AND ins) AS a, count(*) FILTER (hit AND NOT ins) AS b, count(*) FILTER (NOT hit AND ins) AS c, count(*) FILTER (NOT hit AND NOT ins) AS d FROM f GROUP BY 1, 2),
x AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS i FROM k),
p AS (SELECT direction, threshold, a, b, c, d, {_LOG_P.format('i')} AS lp, {_LOG_P.format('a')} AS own FROM x)
SELECT direction, threshold, a, b, c, d, round(least(1.0, sum(exp(lp)) FILTER (lp <= own + 1e-7)), 7) AS p_value FROM p GROUP BY 1, 2, 3, 4, 5, 6""")
def deg_fisher(spark, d):
    out = expression.deg_enrichment(*_deg(spark, d), thresholds=(0.25, 0.5, 1.0))
    return out.select("direction", "threshold", "a", "b", "c", "d", F.round("p_value", 7).alias("p_value"))


_LP = ctes("ecc") + """, s AS (SELECT a.rep AS ra, b.rep AS rb, count(DISTINCT a.name) AS n FROM ecc a JOIN ecc b ON a.chrom = b.chrom AND a.rep <> b.rep AND a.start < b."end" AND b.start < a."end"
  WHERE least(a."end", b."end") - greatest(a.start, b.start) >= 0.3::DOUBLE * a.length AND least(a."end", b."end") - greatest(a.start, b.start) >= 0.3::DOUBLE * b.length GROUP BY 1, 2),
k AS (SELECT rep, count(*) AS n FROM ecc GROUP BY 1),
p AS (SELECT a.rep AS sample_a, b.rep AS sample_b, a.n AS n_a, b.n AS n_b, coalesce(s.n, 0) AS n_shared, round_even(coalesce(s.n, 0)::DOUBLE / a.n, 6) AS overlap_fraction FROM k a JOIN k b ON a.rep <> b.rep LEFT JOIN s ON s.ra = a.rep AND s.rb = b.rep),
lp AS (SELECT *, CASE WHEN n_shared > 0 THEN n_a::DOUBLE * n_b / n_shared ELSE 'infinity'::DOUBLE END AS lp_estimate FROM p)"""


@query(_LP + " SELECT sample_a, sample_b, n_a, n_b, n_shared, round(lp_estimate, 3) AS lp_estimate FROM lp")
def lincoln_petersen(spark, d):
    pairs = overlaps.pair_overlap(ecc(spark, d), "rep", 0.3)
    return stats.lincoln_petersen(pairs).select("sample_a", "sample_b", "n_a", "n_b", "n_shared", F.round("lp_estimate", 3).alias("lp_estimate"))


@query(_LP + """, m AS (SELECT avg(lp_estimate) AS mean FROM lp WHERE lp_estimate < 'infinity'::DOUBLE)
SELECT sample_a, sample_b, round(n_b / mean, 6) AS expected_fraction, round(overlap_fraction / (n_b / mean), 4) AS overlap_ratio FROM lp, m""")
def expected_overlap(spark, d):
    out = stats.expected_overlap(overlaps.pair_overlap(ecc(spark, d), "rep", 0.3))
    return out.select("sample_a", "sample_b", F.round("expected_fraction", 6).alias("expected_fraction"), F.round("overlap_ratio", 4).alias("overlap_ratio"))


_CURVE = """WITH f AS (SELECT l_returnflag AS sample, i / 10.0::DOUBLE AS fraction, count(DISTINCT l_partkey) AS n FROM lineitem, range(1, 11) t(i) WHERE l_orderkey % 10 < i GROUP BY 1, 2)"""


def _curve(spark, d):
    t = table(spark, d, "lineitem").select("l_returnflag", "l_partkey", F.explode(F.sequence((F.col("l_orderkey") % 10 + 1).cast("int"), F.lit(10))).alias("i"))
    return t.groupBy(F.col("l_returnflag").alias("sample"), (F.col("i") / 10.0).alias("fraction")).agg(F.countDistinct("l_partkey").alias("n"))


@query(_CURVE + " SELECT * FROM f")
def saturation_curve(spark, d):
    return _curve(spark, d)


# for each rate the best ceiling is linear; the rate is where the slope of the squares turns, by halving
@query(_CURVE.replace("WITH ", "WITH RECURSIVE ", 1) + """, b AS (SELECT DISTINCT sample, 0.01::DOUBLE AS lo, 200.0::DOUBLE AS hi, 0 AS step FROM f
  UNION ALL SELECT sample, CASE WHEN slope > 0 THEN c ELSE lo END, CASE WHEN slope > 0 THEN hi ELSE c END, step + 1 FROM (
    SELECT b.sample, lo, hi, step, (lo + hi) / 2 AS c, sum((n - top * (1 - exp(-(lo + hi) / 2 * fraction))) * fraction * exp(-(lo + hi) / 2 * fraction)) AS slope FROM b JOIN f ON f.sample = b.sample
    JOIN (SELECT b.sample, sum(n * (1 - exp(-(lo + hi) / 2 * fraction))) / sum((1 - exp(-(lo + hi) / 2 * fraction)) ** 2) AS top FROM b JOIN f ON f.sample = b.sample GROUP BY b.sample) t ON t.sample = b.sample GROUP BY b.sample, lo, hi, step) WHERE step < 70),
c AS (SELECT sample, (lo + hi) / 2 AS c FROM b WHERE step = 70),
t AS (SELECT sample, any_value(c) AS c, sum(n * (1 - exp(-c * fraction))) / sum((1 - exp(-c * fraction)) ** 2) AS top, avg(n) AS mean FROM f JOIN c USING (sample) GROUP BY 1),
q AS (SELECT sample, any_value(top) AS top, any_value(c) AS c, count(*) AS k, sum((n - top * (1 - exp(-c * fraction))) ** 2) AS cost, sum((n - mean) ** 2) AS spread, sum((1 - exp(-c * fraction)) ** 2) AS aa, sum((1 - exp(-c * fraction)) * top * fraction * exp(-c * fraction)) AS ab, sum((top * fraction * exp(-c * fraction)) ** 2) AS bb FROM f JOIN t USING (sample) GROUP BY 1)
SELECT sample, round(top, 2) AS n_max, round(c, 4) AS rate, round(sqrt(bb / (aa * bb - ab * ab) * cost / (k - 2)), 2) AS n_max_se, round(sqrt(aa / (aa * bb - ab * ab) * cost / (k - 2)), 4) AS rate_se, round(1 - cost / spread, 6) AS r2 FROM q""")
def saturation_fit(spark, d):
    out = stats.saturation_curves(_curve(spark, d), "sample", "fraction", "n")
    return out.select("sample", *[F.round(c, k).alias(c) for c, k in (("n_max", 2), ("rate", 4), ("n_max_se", 2), ("rate_se", 4), ("r2", 6))])


@query(_CURVE + """, i AS (SELECT *, n - lag(n) OVER w AS dn FROM f WINDOW w AS (PARTITION BY sample ORDER BY fraction)), r AS (SELECT *, dn / greatest(lag(dn) OVER (PARTITION BY sample ORDER BY fraction), 1)::DOUBLE AS r FROM i),
l AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY fraction DESC) AS k FROM r), a AS (SELECT sample, max(n) FILTER (k = 1) AS last_value, max(dn) FILTER (k = 1) AS ld, avg(CASE WHEN k <= 3 THEN r END) AS mean_ratio FROM l GROUP BY 1)
SELECT sample, last_value, round(mean_ratio, 6) AS mean_ratio, round(last_value + CASE WHEN mean_ratio > 0 AND mean_ratio < 1 THEN ld * mean_ratio / (1 - mean_ratio) ELSE 0 END, 4) AS expected_total FROM a""")
def saturation_geometric(spark, d):
    out = stats.geometric_extrapolation(_curve(spark, d), "sample", "fraction", "n")
    return out.select("sample", "last_value", F.round("mean_ratio", 6).alias("mean_ratio"), F.round("expected_total", 4).alias("expected_total"))


_FDR = """WITH spike AS (SELECT n_nationkey AS s, 900 + n_nationkey AS a, 800 + n_nationkey * 2 AS b, 5 + n_nationkey % 4 AS ab FROM nation),
f AS (SELECT avg(ab::DOUBLE / (a + b + ab)) AS m FROM spike), smp AS (SELECT c_mktsegment AS sample, CAST(sum(c_acctbal) AS BIGINT) AS reads, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1)"""


def _fdr(spark, d, least):
    n = F.col("n_nationkey")
    spike = table(spark, d, "nation").select((n + 900).alias("A"), (n * 2 + 800).alias("B"), (n % 4 + 5).alias("AB"))
    smp = table(spark, d, "customer").where("c_acctbal > 0").groupBy(F.col("c_mktsegment").alias("sample")).agg(F.round(F.sum("c_acctbal")).cast("bigint").alias("total_reads"), F.count(F.lit(1)).alias("ceccdna_count"))
    return cecc.false_discovery(smp, spike, least)


@query(_FDR + """ SELECT sample, reads AS total_reads, n AS observed, round(m, 9) AS chimeric_fraction, round(reads * m, 4) AS expected_false_reads, round(reads * m / n, 6) AS fdr_no_filter,
round((reads * m) * (reads * m - 1) / (2 * 1.9219999690000000e15) * 1e6, 6) AS expected_false_per_million FROM smp, f""")
def cecc_fdr(spark, d):
    out = _fdr(spark, d, 2)
    r = lambda c, k, n: F.round(c, k).alias(n)
    return out.select("sample", "total_reads", "observed", r("chimeric_fraction", 9, "chimeric_fraction"), r("expected_false_reads", 4, "expected_false_reads"), r("fdr_no_filter", 6, "fdr_no_filter"), r(F.col("expected_false_filtered") * 1e6, 6, "expected_false_per_million"))


@query(_FDR + """, x AS (SELECT sample, reads, n, m, reads * m / 1.9219999690000000e15 AS mu FROM smp, f),
t AS (SELECT sample, sum(exp(i * ln(mu) - mu - lgamma(i + 1))) AS tail FROM x, range(3, 60) r(i) GROUP BY 1)
SELECT sample, reads AS total_reads, n AS observed, round(m, 9) AS chimeric_fraction, round(log10(1.9219999690000000e15 * tail), 6) AS log10_expected_false, round(log10(1.9219999690000000e15 * tail / n), 6) AS log10_fdr FROM x JOIN t USING (sample)""")
def cecc_fdr_poisson(spark, d):
    """At least three reads on a pair: expected numbers are far below one, so their logarithms are given."""
    r = lambda c, k, n: F.round(c, k).alias(n)
    return _fdr(spark, d, 3).select("sample", "total_reads", "observed", r("chimeric_fraction", 9, "chimeric_fraction"), r(F.log10("expected_false_filtered"), 6, "log10_expected_false"), r(F.log10("fdr_filtered"), 6, "log10_fdr"))


_UNIT = "CAST('0x' || substr(md5('42:' || {0} || ':' || {1} || ':' || name), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE"
_SPANS = """, s AS (SELECT chrom, size, sum(size) OVER (ORDER BY chrom) - size AS lo, sum(size) OVER () AS total FROM genome)"""


@query(ctes("ecc", "genome") + _SPANS + f""", p AS (SELECT name, "end" - start AS len, perm, CAST(floor({_UNIT.format(1, 'perm')} * (SELECT max(total) FROM s)) AS BIGINT) AS at FROM ecc, range(1, 3) r(perm)),
q AS (SELECT p.name, p.len, CAST(p.perm AS INTEGER) AS perm, s.chrom, CAST(floor({_UNIT.format(2, 'perm').replace('name', 'p.name')} * greatest(1, s.size - p.len + 1)) AS BIGINT) AS start FROM p ASOF JOIN s ON p.at >= s.lo)
SELECT perm, name, chrom, start, start + len AS "end" FROM q""")
def shuffled_regions(spark, d):
    return enrich.placed_at_random(ecc(spark, d), genome(spark), 2)


@query(ctes("ecc", "genome") + f""", q AS (SELECT name, "end" - start AS len, CAST(perm AS INTEGER) AS perm, chrom, CAST(floor({_UNIT.format(2, 'perm')} * greatest(1, size - ("end" - start) + 1)) AS BIGINT) AS start FROM ecc JOIN genome USING (chrom), range(1, 3) r(perm))
SELECT perm, name, chrom, start, start + len AS "end" FROM q""")
def shuffled_within_chromosomes(spark, d):
    return enrich.placed_at_random(ecc(spark, d), genome(spark), 2, keep_chrom=True)


def _document_contigs(spark, d):
    """chrom, seq, size of documents, and their chunks of 1,000 bases."""
    t = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chrom"), F.translate("text", "acgt", "ACGT").alias("seq"), F.length("text").cast("bigint").alias("size")).where("size > 0")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / 1000).cast("int")), lambda i: F.substring(F.col("seq"), i * 1000 + 1, F.lit(1000)))
    return t, t.select("chrom", F.posexplode(parts).alias("chunk", "seq")).withColumn("chunk", F.col("chunk").cast("bigint"))


@query(ctes("ecc") + f""", k AS (SELECT greatest(1, CAST(ceil(50000.0 / count(*)) AS BIGINT)) AS rounds FROM ecc), r AS (SELECT name, length, i AS rnd FROM ecc, k, range(1, 50001) t(i) WHERE i <= rounds),
u AS (SELECT *, printf('%.17f', {_UNIT.format(0, 'rnd')}) || ':' || name || ':' || rnd || ':' || length AS attempt FROM r ORDER BY attempt LIMIT 50000),
c AS (SELECT CAST(doc_id AS VARCHAR) AS chrom, translate(text, 'acgt', 'ACGT') AS s, length(text) AS size FROM documents WHERE length(text) > 0),
s AS (SELECT *, sum(size) OVER (ORDER BY chrom) - size AS lo, sum(size) OVER () AS total FROM c),
a AS (SELECT *, CAST(floor({_UNIT.format(1, 'rnd')} * (SELECT max(total) FROM s)) AS BIGINT) AS at FROM u),
p AS (SELECT attempt, a.name, s.chrom, length, CAST(floor({_UNIT.format(2, 'rnd').replace('|| name', '|| a.name')} * (size - length + 1)) AS BIGINT) AS start, s FROM a ASOF JOIN s ON a.at >= s.lo WHERE size > length),
g AS (SELECT attempt, name, chrom, start, start + length AS "end", substr(s, start + 1, length) AS q FROM p),
h AS (SELECT attempt, name, chrom, start, "end", length(q) - length(translate(q, 'GC', '')) AS gc, length(q) - length(translate(q, 'ACGT', '')) AS acgt FROM g)
SELECT name, chrom, start, "end", round(gc::DOUBLE / acgt, 8) AS gc FROM h WHERE acgt > 0 ORDER BY attempt LIMIT 10000""")
def gc_background(spark, d):
    """Documents stand for contigs, in chunks of 1,000 bases."""
    t, chunks = _document_contigs(spark, d)
    found = enrich.background_gc(ecc(spark, d).select("name", "length"), t.select("chrom", "size"), chunks, 1000)
    return found.select("name", "chrom", "start", "end", F.round("gc", 8).alias("gc"))


_CUT = """WITH c AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS chrom, translate(text, 'acgt', 'ACGT') AS s, CAST(length(text) AS BIGINT) AS size FROM documents WHERE length(text) > 0),
r AS (SELECT doc_id || ':' || i AS name, chrom, s, size, doc_id * 7919 * (i + 1) % size AS start, least(doc_id * 7919 * (i + 1) % size + 20 + doc_id % 200, size) AS "end" FROM c, range(0, 3) t(i)),
j AS (SELECT s, start AS spot, true AS first FROM r WHERE start >= 30 AND start + 30 <= size UNION ALL SELECT s, "end", false FROM r WHERE "end" >= 30 AND "end" + 30 <= size),
b AS (SELECT pos, first, CASE WHEN substr(s, spot + pos + 1, 1) IN ('G', 'C') THEN 1 WHEN substr(s, spot + pos + 1, 1) IN ('A', 'T') THEN 0 END AS gc FROM j, range(-30, 30) x(pos)),
g AS (SELECT pos, avg(gc) FILTER (first) AS start_gc, avg(gc) FILTER (NOT first) AS end_gc, (avg(gc) FILTER (first) + avg(gc) FILTER (NOT first)) / 2 AS both_gc FROM b GROUP BY 1)"""


def _cut(spark, d):
    """Three regions of each document, and the documents as contigs."""
    t, chunks = _document_contigs(spark, d)
    start = F.col("chrom").cast("bigint") * 7919 * (F.col("i") + 1) % F.col("size")
    r = t.select("chrom", "size", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    return r.select(F.concat_ws(":", "chrom", "i").alias("name"), "chrom", start.alias("start"), F.least(start + 20 + F.col("chrom").cast("bigint") % 200, F.col("size")).alias("end")), t.select("chrom", "size"), chunks


@query(_CUT + """ SELECT pos AS "position", round(start_gc, 8) AS start_gc, round(end_gc, 8) AS end_gc, round(both_gc, 8) AS both_gc,
round(sum(start_gc) OVER w / 10, 8) AS start_gc_smooth, round(sum(end_gc) OVER w / 10, 8) AS end_gc_smooth, round(sum(both_gc) OVER w / 10, 8) AS both_gc_smooth FROM g WINDOW w AS (ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)""")
def junction_composition(spark, d):
    p = enrich.junction_profile(*_cut(spark, d), 1000, flank=30)
    return p.select("position", *[F.round(c, 8).alias(c) for c in p.columns[1:]])


@query(_CUT + f""", k AS (SELECT greatest(1, CAST(ceil(50000.0 / count(*)) AS BIGINT)) AS rounds FROM r), n AS (SELECT name, "end" - start AS length, i AS rnd FROM r, k, range(1, 50001) t(i) WHERE i <= rounds),
u AS (SELECT *, printf('%.17f', {_UNIT.format(0, 'rnd')}) || ':' || name || ':' || rnd || ':' || length AS attempt FROM n ORDER BY attempt LIMIT 50000),
s AS (SELECT *, sum(size) OVER (ORDER BY chrom) - size AS lo, sum(size) OVER () AS total FROM c),
a AS (SELECT *, CAST(floor({_UNIT.format(1, 'rnd')} * (SELECT max(total) FROM s)) AS BIGINT) AS at FROM u),
p AS (SELECT attempt, length, CAST(floor({_UNIT.format(2, 'rnd').replace('|| name', '|| a.name')} * (size - length + 1)) AS BIGINT) AS start, s FROM a ASOF JOIN s ON a.at >= s.lo WHERE size > length),
h AS (SELECT attempt, substr(s, start + 1, length) AS q FROM p),
v AS (SELECT true AS own, substr(s, start + 1, "end" - start) AS q FROM r UNION ALL (SELECT false, q FROM h WHERE length(q) > length(translate(q, 'ACGT', '')) ORDER BY attempt LIMIT 10000)),
x AS (SELECT own, (length(q) - length(translate(q, 'GC', '')))::DOUBLE / (length(q) - length(translate(q, 'ACGT', ''))) AS gc FROM v WHERE length(q) > length(translate(q, 'ACGT', ''))),
y AS (SELECT *, rank() OVER (ORDER BY gc) + (count(*) OVER (PARTITION BY gc) - 1) / 2.0::DOUBLE AS rk FROM x)
SELECT (SELECT count(*) FROM r) AS n_regions, round(avg(gc) FILTER (own), 8) AS gc_mean, round(quantile_cont(gc, 0.5) FILTER (own), 8) AS gc_median, round(stddev_samp(gc) FILTER (own), 8) AS gc_sd, count(*) FILTER (NOT own) AS n_background,
round(avg(gc) FILTER (NOT own), 8) AS background_mean, round(quantile_cont(gc, 0.5) FILTER (NOT own), 8) AS background_median, round(stddev_pop(gc) FILTER (NOT own), 8) AS background_sd,
(SELECT round(avg(both_gc), 8) FROM g WHERE pos >= 0) AS inside_gc, (SELECT round(avg(both_gc), 8) FROM g WHERE pos < 0) AS outside_gc,
round(sum(rk) FILTER (own) - count(*) FILTER (own) * (count(*) FILTER (own) + 1) / 2.0::DOUBLE, 1) AS u FROM y""")
def composition_against_background(spark, d):
    s = enrich.composition_summary(*_cut(spark, d), 1000, flank=30)
    whole = ("n_regions", "n_background")
    return s.select(*[c if c in whole else F.round(c, 1 if c == "u" else 8).alias(c) for c in s.columns if c != "p_value"])
