"""Queries on region tables: reports, lengths, de-duplication, sampling, links and conversions."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbispan.functions import reads, regions
from orbispan.operators import cecc, process
from orbispan.operators.benchmark import ranked
from orbispan.plans.registry import query
from orbispan.plans.views import annot, ctes, ecc, genome, table


@query(ctes("ecc") + " SELECT sample, count(*) AS count FROM ecc GROUP BY 1")
def report_sample_counts(spark, d):
    return process.sample_counts(ecc(spark, d))


@query(ctes("ecc") + """ SELECT sample, type, count(*) AS count, round(avg(length), 6) AS mean, round(stddev_samp(length), 6) AS std, min(length)::DOUBLE AS min, quantile_cont(length, 0.25) AS q25,
quantile_cont(length, 0.5) AS median, quantile_cont(length, 0.75) AS q75, max(length)::DOUBLE AS max FROM ecc GROUP BY 1, 2""")
def report_length_stats(spark, d):
    return process.describe(ecc(spark, d), by=("sample", "type")).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(ctes("ecc") + """, c AS (SELECT CAST(least(least(length, 2000) // 100, 19) AS INTEGER) AS bin, count(*) AS n FROM ecc WHERE length > 0 GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, CAST(i * 100 AS INTEGER) AS bin_start, CAST((i + 1) * 100 AS INTEGER) AS bin_end, coalesce(n, 0) AS count FROM range(20) t(i) LEFT JOIN c ON c.bin = i""")
def quantify_histogram(spark, d):
    return process.length_histogram(ecc(spark, d), 100, 2000)


_HIST = ctes("ecc") + """, c AS (SELECT least(least(length, 2000) // 20, 99) AS bin, count(*) AS n FROM ecc WHERE length > 0 GROUP BY 1), h AS (SELECT i AS bin, coalesce(n, 0) AS count FROM range(100) t(i) LEFT JOIN c ON c.bin = i),
x AS (SELECT bin, count - avg(count) OVER () AS x FROM h)"""


@query(_HIST + """ SELECT CAST(l AS INTEGER) AS lag, round(sum(a.x * b.x) / (SELECT sum(x * x) FROM x), 6) AS acf FROM range(0, 31) t(l) JOIN x a ON true JOIN x b ON b.bin = a.bin + l GROUP BY 1""")
def quantify_autocorrelation(spark, d):
    h = process.length_histogram(ecc(spark, d), 20, 2000)
    return process.autocorrelation(h, 30).withColumn("acf", F.round("acf", 6))


@query(_HIST + """, f AS (SELECT k, sqrt(pow(sum(x * cos(2 * pi() * k * bin / 100)), 2) + pow(sum(x * sin(2 * pi() * k * bin / 100)), 2)) AS m FROM x, range(1, 51) t(k) GROUP BY 1)
SELECT round(m, 2) AS fft_magnitude FROM f ORDER BY m DESC LIMIT 10""")
def quantify_periodicity(spark, d):
    """The ten strongest magnitudes; periods of equal ones differ by rounding alone."""
    found = process.periodicity(process.length_histogram(ecc(spark, d), 20, 2000), 20)
    return found.select(F.round("fft_magnitude", 2).alias("fft_magnitude"))


@query(ctes("ecc") + """ SELECT name, chrom AS "eChr", start AS "eStart", "end" AS "eEnd", length AS "eLength" FROM ecc""")
def parse_names(spark, d):
    e = ecc(spark, d).select("name", F.concat_ws("-", F.concat_ws(":", "chrom", "start"), "end").alias("seqname"))
    return process.parse_names(e).drop("seqname")


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_size >= 30")
def filter_annotation(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_retailprice", F.col("p_size").alias("anno_Percent"))
    return process.filter_annotation(p, 30).drop("anno_Percent")


@query(ctes("ecc") + " SELECT chrom, count(*) AS n FROM ecc WHERE chrom NOT IN ('chr1', 'chr21') GROUP BY 1")
def chromosome_allow_list(spark, d):
    allowed = genome(spark).where(~F.col("chrom").isin("chr1", "chr21")).select("chrom")
    return ecc(spark, d).join(F.broadcast(allowed), "chrom", "left_semi").groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


@query(ctes("ecc") + " SELECT rep AS sample, chrom, count(*) AS n, sum(length)::BIGINT AS bp FROM ecc GROUP BY 1, 2")
def merge_samples(spark, d):
    parts = {r: ecc(spark, d).where(F.col("rep") == r).drop("sample", "rep") for r in ("AF", "AO", "NF", "NO", "RF", "RO")}
    return process.union_samples(parts).groupBy("sample", "chrom").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bp"))


# rounds over all places: one goes when an earlier survivor can absorb it, and survives when all that could are gone
@query(ctes("ecc").replace("WITH ", "WITH RECURSIVE ", 1) + """, n AS (SELECT chrom, start, "end", row_number() OVER (ORDER BY chrom, start, "end") AS id FROM (SELECT DISTINCT chrom, start, "end" FROM ecc)),
p AS (SELECT a.id AS first, b.id AS later FROM n a JOIN n b ON a.chrom = b.chrom AND a.id < b.id AND a.start < b."end" AND b.start < a."end"
  WHERE least(a."end", b."end") - greatest(a.start, b.start) >= 0.8::DOUBLE * (a."end" - a.start) AND least(a."end", b."end") - greatest(a.start, b.start) >= 0.8::DOUBLE * (b."end" - b.start)),
st AS (SELECT id, 0 AS step, CASE WHEN id IN (SELECT later FROM p) THEN 'open' ELSE 'stays' END AS fate FROM n
  UNION ALL SELECT s.id, s.step + 1, CASE WHEN s.fate <> 'open' THEN s.fate WHEN bool_or(e.fate = 'stays') THEN 'goes' WHEN bool_and(e.fate = 'goes') THEN 'stays' ELSE 'open' END
  FROM st s LEFT JOIN p ON p.later = s.id LEFT JOIN st e ON e.id = p.first WHERE EXISTS (SELECT 1 FROM st WHERE fate = 'open') GROUP BY s.id, s.step, s.fate),
done AS (SELECT id, fate FROM st WHERE step = (SELECT max(step) FROM st)),
owner AS (SELECT d.id, CASE WHEN d.fate = 'stays' THEN d.id ELSE min(e.id) END AS first FROM done d LEFT JOIN p ON p.later = d.id LEFT JOIN done e ON e.id = p.first AND e.fate = 'stays' GROUP BY d.id, d.fate),
m AS (SELECT first, e.sample AS tool, e.type AS sample, row_number() OVER (PARTITION BY first ORDER BY e.start, e."end", e.sample, e.type) AS k FROM ecc e JOIN n USING (chrom, start, "end") JOIN owner USING (id)),
f AS (SELECT *, bool_or(sample <> head) OVER (PARTITION BY first ORDER BY k ROWS UNBOUNDED PRECEDING) AS changed FROM (SELECT *, first_value(sample) OVER (PARTITION BY first ORDER BY k) AS head FROM m))
SELECT chrom, start, "end", tool, sample FROM (SELECT first, CASE WHEN count(DISTINCT tool) = 1 THEN min(tool) ELSE 'merged' END AS tool, string_agg(sample, ';' ORDER BY k) FILTER (k = 1 OR changed) AS sample FROM f GROUP BY 1) g JOIN n ON n.id = g.first""")
def combine_deduplicated(spark, d):
    e = ecc(spark, d).select("chrom", "start", "end", F.col("sample").alias("tool"), F.col("type").alias("sample"))
    return process.deduplicated(e, 0.8)


def _segments(spark, d):
    """Chimeric calls: an order's items are its segments, in the order of their keys."""
    t = table(spark, d, "lineitem")
    start = (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_linenumber") * 15485863) % 10_000_000
    return t.select(F.col("l_orderkey").cast("string").alias("name"), F.concat(F.lit("chr"), F.col("l_suppkey") % 22 + 1).alias("chrom"), start.alias("start"), (start + 100 + F.col("l_quantity").cast("bigint") * 40).alias("end"), F.col("l_returnflag").alias("type"), (F.col("l_linenumber") * 10_000_000_000 + start).alias("ord"))


_SEG = """WITH seg AS (SELECT CAST(l_orderkey AS VARCHAR) AS name, 'chr' || (l_suppkey % 22 + 1) AS chrom, (l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 15485863) % 10000000 AS start,
  (l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 15485863) % 10000000 + 100 + CAST(l_quantity AS BIGINT) * 40 AS "end", l_linenumber * 10000000000 + (l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 15485863) % 10000000 AS ord FROM lineitem)"""


@query(_SEG + """ SELECT a.name, a.chrom AS chrom1, a.start AS start1, a."end" AS end1, b.chrom AS chrom2, b.start AS start2, b."end" AS end2 FROM seg a JOIN seg b ON a.name = b.name AND a.ord < b.ord""")
def genolink_pairs(spark, d):
    return process.link_pairs(_segments(spark, d))


_REC = _SEG + """, g AS (SELECT name, list(struct_pack(chrom := chrom, s := start, e := "end") ORDER BY ord) AS segs FROM seg GROUP BY 1),
r AS (SELECT name, len(segs) AS n, len(list_distinct(list_transform(segs, lambda x: x.chrom))) AS nc, list_min(list_transform(segs, lambda x: x.s)) AS lo, list_max(list_transform(segs, lambda x: x.e)) AS hi,
  list_sum(list_transform(segs, lambda x: x.e - x.s)) AS total, array_to_string(list_sort(list_distinct(list_transform(segs, lambda x: x.chrom))), ',') AS chroms FROM g)"""


def _calls(spark, d):
    text = F.concat_ws("", F.concat_ws(":", "chrom", "start"), F.lit("-"), "end", F.when(F.col("start") % 2 == 0, "(+)").otherwise("(-)"))
    seg = _segments(spark, d).withColumn("text", text).groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), ";").alias("location"))
    return seg.withColumns({"type": F.lit("Cecc"), "sample": F.concat(F.lit("s"), F.col("name").cast("bigint") % 3)})


@query(_REC + """ SELECT name, CAST(n AS INTEGER) AS n_segments, CASE WHEN n < 2 THEN 'unknown' WHEN nc > 1 THEN 'inter-chromosomal' ELSE 'intra-chromosomal' END AS fusion_type, CASE WHEN nc = 1 THEN hi - lo ELSE -1 END AS intra_distance, chroms AS chromosomes, CAST(total AS BIGINT) AS total_length FROM r""")
def cecc_records(spark, d):
    return cecc.records(_calls(spark, d)).select("name", "n_segments", "fusion_type", F.coalesce("intra_distance", F.lit(-1)).alias("intra_distance"), "chromosomes", "total_length")


@query(_REC + """, k AS (SELECT CAST(name AS BIGINT) % 3 AS s, n, nc, total, CASE WHEN nc = 1 THEN hi - lo END AS dist FROM r)
SELECT 's' || s AS sample, count(*) AS total, count(*) FILTER (n = 2) AS segments_2, count(*) FILTER (n = 3) AS segments_3, count(*) FILTER (n >= 4) AS segments_4plus, count(*) FILTER (n >= 2 AND nc > 1) AS inter, count(*) FILTER (n >= 2 AND nc = 1) AS intra,
round_even(count(*) FILTER (n >= 2 AND nc > 1)::DOUBLE / count(*), 6) AS inter_fraction, round_even(avg(n), 6) AS mean_segments, CAST(max(n) AS INTEGER) AS max_segments, quantile_cont(total::DOUBLE, 0.5) AS median_length, quantile_cont(dist::DOUBLE, 0.5) AS median_intra_distance FROM k GROUP BY 1""")
def cecc_sample_summary(spark, d):
    return cecc.sample_summary(cecc.records(_calls(spark, d)))


@query(_SEG + """ SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY ord, chrom || ':' || start || '-' || "end") - 1 AS INTEGER) AS seg, chrom, start, "end", CASE WHEN start % 2 = 0 THEN '+' ELSE '-' END AS strand, "end" - start AS seg_length FROM seg""")
def cecc_segments(spark, d):
    return cecc.segment_stats(cecc.records(_calls(spark, d)))


_MD5 = "md5('42:' || name)"


@query(ctes("ecc") + f" SELECT name, chrom FROM ecc ORDER BY {_MD5}, name LIMIT 50")
def sample_rows(spark, d):
    return process.sampled(ecc(spark, d), 50, "name").select("name", "chrom")


@query(ctes("ecc") + f" SELECT name FROM ecc WHERE ('0x' || substr({_MD5}, 1, 8))::BIGINT < CAST(0.1::DOUBLE * 4294967296 AS BIGINT)")
def sample_fraction(spark, d):
    return process.fraction_sampled(ecc(spark, d), 0.1, "name").select("name")


@query(ctes("ecc") + f" SELECT sample, type, name FROM (SELECT *, row_number() OVER (PARTITION BY sample, type ORDER BY {_MD5}, name) AS k FROM ecc) WHERE k <= 20")
def sample_stratified(spark, d):
    return process.stratified(ecc(spark, d), 20, ["sample", "type"], "name").select("sample", "type", "name")


@query(ctes("ecc") + f" SELECT name, length FROM ecc WHERE length > 0 ORDER BY ln((('0x' || substr({_MD5}, 1, 12))::BIGINT + 1)::DOUBLE / 281474976710657.0::DOUBLE) / length DESC, name LIMIT 100")
def sample_weighted(spark, d):
    return process.weighted_sample(ecc(spark, d), 100, "length", "name").select("name", "length")


@query(ctes("ecc") + """, q AS (SELECT DISTINCT unnest(quantile_cont(length::DOUBLE, [i / 16.0::DOUBLE FOR i IN range(1, 16)])) AS e FROM ecc), b AS (SELECT e.name, e.length, (SELECT count(*) FROM q WHERE q.e < e.length) AS b FROM ecc e)
SELECT name, length, quantile_cont(length::DOUBLE, 0.5) OVER (PARTITION BY b) AS batch_value FROM b""")
def quantile_batches(spark, d):
    return process.quantile_batches(ecc(spark, d).select("name", "length"), "length", 16)


@query(ctes("ecc") + """ SELECT type || 'eccDNA_' || lpad(CAST(row_number() OVER (PARTITION BY type ORDER BY name) AS VARCHAR), 6, '0') AS id, name FROM ecc""")
def renumbered(spark, d):
    return process.renumbered(ecc(spark, d).select("type", "name"), "type", "name").select("id", "name")


@query(ctes("ecc") + """ SELECT chrom, b, name, start, "end" FROM (SELECT *, start // 1000 AS b, row_number() OVER (PARTITION BY chrom, start // 1000, "end" // 1000 ORDER BY start, "end", name) AS k FROM ecc) WHERE k = 1""")
def first_in_bin(spark, d):
    e = ecc(spark, d).select("chrom", "name", "start", "end", F.floor(F.col("start") / 1000).alias("b"), F.floor(F.col("end") / 1000).alias("b2"))
    return ranked(e, ["chrom", "b", "b2"], [F.col("start"), F.col("end"), F.col("name")]).drop("b2")


@query(ctes("annot") + """ SELECT te_name, chrom, start, "end", CAST(round_even(pct_div * 10, 0) AS INTEGER) AS milli_div, CASE WHEN start % 2 = 0 THEN '+' ELSE '-' END AS strand, split_part(te_class || '/' || te_family, '/', 1) AS rep_class, split_part(te_class || '/' || te_family, '/', 2) AS rep_family FROM annot""")
def convert_rmsk(spark, d):
    from orbispan.sources.repeats import ucsc_record

    raw = annot(spark, d).select("te_name", "chrom", (F.col("start") + 1).alias("begin"), "end", F.col("pct_div").alias("div"), F.when(F.col("start") % 2 == 0, "+").otherwise("C").alias("strand"), F.concat_ws("/", "te_class", "te_family").alias("class_family"))
    return ucsc_record(raw).select("te_name", "chrom", "start", "end", "milli_div", "strand", "rep_class", "rep_family")


@query(ctes("ecc") + """ SELECT CASE WHEN length >= 0 AND length < 500 THEN '<500bp' WHEN length < 1000 THEN '500-1kb' WHEN length < 5000 THEN '1-5kb' WHEN length < 10000 THEN '5-10kb' ELSE '>10kb' END AS length_bin, count(*) AS n FROM ecc GROUP BY 1""")
def length_bins(spark, d):
    return ecc(spark, d).groupBy(regions.length_bin("length").alias("length_bin")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'mol_' || user_id WHEN 'view' THEN 'mol_' || user_id WHEN 'error' THEN 'mol_' || user_id END AS molecule,
(('0x' || substr(m, 7, 2) || substr(m, 5, 2) || substr(m, 3, 2) || substr(m, 1, 2))::BIGINT % 2147483648) AS seed FROM (SELECT *, md5('42:mol_' || user_id || ':NGS') AS m FROM events)""")
def read_molecules(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    mol = F.concat(F.lit("mol_"), "user_id")
    platform = F.when(F.col("event_type") == "click", "NGS").when(F.col("event_type") == "view", "ONT").when(F.col("event_type") == "error", "HiFi")
    read = F.when(platform == "NGS", F.concat(F.lit("@"), mol, F.lit("-"), "event_id", F.lit("/1"))).when(platform == "ONT", F.concat(mol, F.lit(".seq_"), "event_id")).otherwise(F.concat(mol, F.lit("_hifi_"), "event_id"))
    return e.select("event_id", reads.molecule_of_read(read, platform).alias("molecule"), reads.molecule_seed(42, mol, F.lit("NGS")).alias("seed"))
