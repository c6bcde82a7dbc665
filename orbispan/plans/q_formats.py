"""Queries that write tables of tools to the shared folder and read them back, formats detected where readers can."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbispan.functions.reads import paf_coverage, paf_identity, repeat_count, template_coverage
from orbispan.functions.regions import clamp
from orbispan.functions.sequence import cs_stats
from orbispan.operators import benchmark, process
from orbispan.operators.intervals import merged
from orbispan.plans.q_files import _place, _text_file
from orbispan.plans.registry import query
from orbispan.plans.views import SIZE, annot, ctes, ecc, genome, table
from orbispan.sources import detectors, repeats, sequences, sinks, tables


def _s(column: str):
    return F.col(column).cast("string")


@query(ctes("ecc") + """ SELECT name AS query, chrom AS target, start AS target_start, "end" AS target_end, round(CASE WHEN start % 2 = 0 THEN 1 - (start % 1000) / 10000.0::DOUBLE ELSE (length - 10)::DOUBLE / length END, 8) AS identity,
round(least(100.0, 100.0 * length / 900), 6) AS coverage, CAST(start % 4 + 1 AS INTEGER) AS mismatches, CAST(1 + start % 3 AS INTEGER) AS gap_opens, CAST(2 + 4 * (start % 3) AS INTEGER) AS gap_bases FROM ecc""")
def file_paf(spark, d):
    """Half of the alignments have a divergence tag; all have a difference string after another tag."""
    cs = F.concat(F.lit("cs:Z::20*ct"), F.expr("repeat('*ag:3', CAST(start % 4 AS INT))"), F.lit(":5-tt:7"), F.expr("repeat('+acgt:2', CAST(start % 3 AS INT))"))
    de = F.when(F.col("start") % 2 == 0, F.format_string("de:f:%.4f", (F.col("start") % 1000) / 10000.0))
    length, zero = _s("length"), F.lit("0")
    path = _text_file(ecc(spark, d), "paf", "name", length, zero, length, F.lit("+"), "chrom", F.lit(str(SIZE)), _s("start"), _s("end"), (F.col("length") - 10).cast("string"), length, F.lit("60"), F.lit("tp:A:P"), de, cs)
    t = sequences.read_paf(spark, path).withColumn("_d", cs_stats("cs"))
    covered = paf_coverage(F.col("target_end") - F.col("target_start"), F.lit(900))
    return t.select("query", "target", "target_start", "target_end", F.round(paf_identity("divergence", "matches", "aligned"), 8).alias("identity"), F.round(covered, 6).alias("coverage"), "_d.mismatches", "_d.gap_opens", "_d.gap_bases")


@query(ctes("ecc") + """ SELECT name, chrom AS sseqid, (80 + start % 20)::DOUBLE AS pident, length, start AS sstart, "end" AS send FROM ecc WHERE 80 + start % 20 >= 90 AND length >= 1000""")
def file_blast(spark, d):
    zero = F.lit("0")
    path = _text_file(ecc(spark, d), "blast", "name", "chrom", (F.col("start") % 20 + 80).cast("string"), _s("length"), zero, zero, F.lit("1"), _s("length"), _s("start"), _s("end"), F.lit("1e-30"), F.lit("200.5"), _s("length"), F.lit(str(SIZE)))
    return sequences.read_blast(spark, path, 90.0, 1000).select("name", "sseqid", "pident", "length", "sstart", "send")


@query(ctes("ecc") + """, r AS (SELECT split_part(name, '_', 3) AS name, substr(translate(md5(name), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 8 + start % 24) AS c FROM ecc)
SELECT name, c AS consensus, length(c) AS length FROM r QUALIFY row_number() OVER (PARTITION BY name ORDER BY length(c) DESC, c) = 1""")
def file_consensus(spark, d):
    """The longest consensus of each part's reads; of equals, the first by its letters."""
    whole = F.translate(F.md5(F.col("name").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")
    path = _text_file(ecc(spark, d), "consensus", F.split("name", "_")[2], F.lit("rep0"), _s("length"), F.substring(whole, F.lit(1), (F.col("start") % 24 + 8).cast("int")))
    return detectors.longest_consensus(detectors.read_consensus(spark, path)).withColumn("length", F.length("consensus").cast("bigint"))


@query("""SELECT 'd' || doc_id AS chrom, CAST(n_chars AS BIGINT) AS size, t.source FROM documents, (VALUES ('table'), ('index')) t(source)""")
def file_sizes(spark, d):
    """Documents stand for contigs; their sizes from a two-column table and from an index of a sequence file."""
    g = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("chrom"), _s("n_chars").alias("size"))
    two = _text_file(g, "sizes", "chrom", "size")
    five = _text_file(g, "fai", "chrom", "size", F.lit("6"), F.lit("60"), F.lit("61"))
    return tables.read_sizes(spark, two).withColumn("source", F.lit("table")).unionByName(tables.read_sizes(spark, five).withColumn("source", F.lit("index")))


@query(ctes("ecc") + ' SELECT name, chrom, start, "end", length FROM ecc')
def file_mixed_regions(spark, d):
    """Calls of one sample as BED and of the other as CSV, told apart by their first lines."""
    e = ecc(spark, d)
    bed, csv = _place(spark, "mixed-a"), _place(spark, "mixed-b")
    sinks.write_bed(e.where("sample = 'F'").select("chrom", "start", "end", "name"), bed)
    sinks.write_csv(e.where("sample <> 'F'").select(F.col("chrom").alias("Chromosome"), F.col("start").alias("chromStart"), F.col("end").alias("Stop"), F.col("name").alias("eccDNA_name"), "type"), csv)
    return tables.read_regions(spark, bed, csv).select("name", "chrom", "start", "end", "length")


@query(ctes("annot") + """, f AS (SELECT * FROM (VALUES ('ucsc'), ('gff'), ('bed'), ('repeatmasker')) t(format))
SELECT format, te_name, chrom, start, "end", te_class, te_family, CASE WHEN format = 'bed' THEN 0.0 ELSE pct_div END::DOUBLE AS pct_div FROM (SELECT te_name, chrom, start, "end", substr(te_class, 1, 1) || 'X' AS te_class, te_family, pct_div FROM annot), f""")
def file_detected_repeats(spark, d):
    """One annotation in four formats, each read by what its first lines look like."""
    a, zero, one, plus = annot(spark, d).withColumn("te_class", F.concat(F.substring("te_class", 1, 1), F.lit("X"))), F.lit("0"), F.lit("1"), F.lit("+")
    begin, start, end, both = (F.col("start") + 1).cast("string"), _s("start"), _s("end"), F.concat_ws("/", "te_class", "te_family")
    tenths, div = F.round(F.col("pct_div") * 10).cast("int").cast("string"), F.format_string("%.1f", "pct_div")
    tags = F.concat(F.lit("ID="), "te_name", F.lit(";class="), "te_class", F.lit(";family="), "te_family", F.lit(";divergence="), div)
    paths = {
        "ucsc": _text_file(a, "any-ucsc", one, one, tenths, zero, zero, "chrom", start, end, zero, plus, "te_name", "te_class", "te_family", one, one, zero, one),
        "gff": _text_file(a, "any-gff", "chrom", F.lit("maker"), F.lit("repeat"), begin, end, F.lit("."), plus, F.lit("."), tags),
        "bed": _text_file(a, "any-bed", "chrom", start, end, "te_name", zero, plus, "te_class", "te_family"),
        "repeatmasker": _text_file(a, "any-out", F.lit("463"), div, F.lit("0.0"), F.lit("0.0"), "chrom", begin, end, F.lit("(0)"), plus, "te_name", both, one, one, F.lit("(0)"), one, sep="  "),
    }
    out = None
    for path in paths.values():
        part = repeats.read_repeats(spark, path).withColumn("format", F.lit(repeats.sniff(spark, path)))
        out = part if out is None else out.unionByName(part)
    return out.select("format", "te_name", "chrom", "start", "end", "te_class", "te_family", F.round("pct_div", 6).alias("pct_div"))


@query(ctes("annot") + """, a AS (SELECT chrom, start, "end" FROM annot WHERE start % 3 = 0),
m AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM a),
i AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT chrom, min(start) AS start, max("end") AS "end" FROM i GROUP BY chrom, island""")
def file_excluded(spark, d):
    """Only the centromeres of a table of bands are left out, joined where they meet."""
    stain = F.when(F.col("start") % 3 == 0, "acen").otherwise("gneg")
    path = _text_file(annot(spark, d), "bands", "chrom", _s("start"), _s("end"), "te_name", stain)
    return merged(tables.read_excluded(spark, path)).select("chrom", "start", "end")


@query(ctes("ecc") + """ SELECT name, CASE WHEN CAST(substr(chrom, 4) AS INTEGER) <= 20 THEN 'NC_' || lpad(substr(chrom, 4), 6, '0') ELSE chrom END AS chrom FROM ecc""")
def file_alias(spark, d):
    """Contigs by the names of another archive; two are not in its table and keep theirs."""
    number = F.substring("chrom", 4, 9)
    known = genome(spark).where(number.cast("int") <= 20)
    path = _place(spark, "alias")
    sinks.write_csv(known.select(F.col("chrom").alias("name"), F.concat(F.lit("NC_"), F.lpad(number, 6, "0")).alias("alias")), path)
    return repeats.with_alias(ecc(spark, d).select("name", "chrom"), spark.read.csv(path, header=True)).select("name", "chrom")


@query(ctes("ecc") + """, m AS (SELECT sample AS scope, type AS key, count(*)::DOUBLE AS n, sum(length)::DOUBLE AS bp FROM ecc GROUP BY 1, 2)
SELECT scope, key, 'n' AS metric, n AS value FROM m UNION ALL SELECT scope, key, 'bp', bp FROM m""")
def file_nested_report(spark, d):
    m = ecc(spark, d).groupBy("sample", "type").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("length").cast("double").alias("bp"))
    long = m.select(F.col("sample").alias("scope"), F.col("type").alias("key"), F.explode(F.create_map(F.lit("n"), "n", F.lit("bp"), "bp")).alias("metric", "value"))
    path = _place(spark, "nested")
    sinks.write_report(long, path)
    return detectors.read_reports(spark, path).select("scope", "key", "metric", "value")


@query(ctes("ecc") + """ SELECT format, chrom, start, "end", CASE WHEN format = 'native' THEN CASE type WHEN 'A' THEN 'U' WHEN 'N' THEN 'M' ELSE 'other' END WHEN format = 'cresil' AND start % 2 = 0 THEN 'M' ELSE 'U' END AS type,
CASE WHEN format = 'native' AND start % 5 = 0 THEN 'Inferred' ELSE 'Confirmed' END AS state, length FROM ecc, (VALUES ('native'), ('cresil'), ('circlemap'), ('csv')) f(format)""")
def file_detections(spark, d):
    """The same calls in the formats of four detectors."""
    e, out = ecc(spark, d), None
    paths = {f: _place(spark, f) for f in ("native", "cresil", "circlemap", "csv")}
    where = F.concat("chrom", F.lit(":"), _s("start"), F.lit("-"), _s("end"))
    kind = F.when(F.col("type") == "A", "UeccDNA").when(F.col("type") == "N", "Mecc").otherwise("none")
    sinks.write_csv(e.select(F.col("name").alias("eccDNA_id"), where.alias("Regions"), kind.alias("eccDNA_type"), F.when(F.col("start") % 5 == 0, "Inferred").otherwise("Confirmed").alias("State"), F.when(F.col("start") % 2 == 0, F.col("length")).alias("Length")), paths["native"])
    sinks.write_csv(e.select(F.col("name").alias("id"), F.concat(where, F.lit("_+")).alias("merge_region"), F.col("length").alias("merge_len"), F.when(F.col("start") % 2 == 0, 2).otherwise(1).alias("num_region")), paths["cresil"], sep="\t")
    sinks.write_bed(e.select("chrom", "start", "end", "name"), paths["circlemap"])
    sinks.write_csv(e.select(F.col("chrom").alias("seqnames"), F.col("start").alias("begin"), F.col("end").alias("stop")), paths["csv"])
    for f, path in paths.items():
        part = detectors.read_detections(spark, path, f).select(F.lit(f).alias("format"), F.inline("segs"), "type", "state", "length")
        out = part if out is None else out.unionByName(part)
    return out.select("format", "chrom", "start", "end", "type", "state", "length")


@query(ctes("ecc", "genome") + """, c AS (SELECT name, chrom, greatest(0, least(start - 5000, size)) AS start, greatest(0, least("end" + 9000000, size)) AS "end" FROM ecc JOIN genome USING (chrom)) SELECT *, "end" > start AS valid FROM c""")
def clamped_regions(spark, d):
    e = ecc(spark, d).join(F.broadcast(genome(spark)), "chrom")
    c = clamp(F.col("start") - 5000, F.col("end") + 9_000_000, F.col("size"))
    return e.select("name", "chrom", F.inline(F.array(c)))


@query(ctes("ecc") + """ SELECT name, CAST(length // (60 + start % 50) AS INTEGER) AS repeats, round(30.0 * (60 + start % 50) / length, 8)::DOUBLE AS template_coverage FROM ecc""")
def rolled_coverage(spark, d):
    """Copies of a unit in each product, and the templates' coverage that gives 30 reads a base."""
    unit = F.col("start") % 50 + 60
    return ecc(spark, d).select("name", repeat_count("length", unit).alias("repeats"), F.round(template_coverage(F.lit(30.0), unit, "length"), 8).alias("template_coverage"))


@query(ctes("ecc") + """, r AS (SELECT CASE chrom WHEN 'chr20' THEN 'chrX' WHEN 'chr21' THEN 'chrM' WHEN 'chr22' THEN 'chr4_GL000008v2_random' WHEN 'chr19' THEN 'chrUn_KI270302v1' ELSE chrom END AS chrom FROM ecc),
k AS (SELECT * FROM (VALUES ('sex'), ('mito'), ('alt'), ('all')) t(dropped))
SELECT dropped, chrom, count(*) AS n FROM r, k WHERE NOT (dropped IN ('sex', 'all') AND chrom = 'chrX') AND NOT (dropped IN ('mito', 'all') AND chrom = 'chrM') AND NOT (dropped IN ('alt', 'all') AND chrom IN ('chr4_GL000008v2_random', 'chrUn_KI270302v1')) GROUP BY 1, 2""")
def chromosome_classes(spark, d):
    """Calls left by chromosome when sex, mitochondrial or unplaced contigs are dropped, and all of these."""
    other = {"chr20": "chrX", "chr21": "chrM", "chr22": "chr4_GL000008v2_random", "chr19": "chrUn_KI270302v1"}
    e, out = ecc(spark, d).select("chrom").replace(other, subset=["chrom"]).groupBy("chrom").agg(F.count(F.lit(1)).alias("n")), None
    for name in ("sex", "mito", "alt", "all"):
        part = process.keep_chromosomes(e, sex=name not in ("sex", "all"), mito=name not in ("mito", "all"), alt=name not in ("alt", "all")).withColumn("dropped", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("dropped", "chrom", "n")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS read_id, CASE WHEN bool_or(l_returnflag = 'R') THEN 'C' WHEN bool_or(l_returnflag = 'N') THEN 'M' ELSE 'U' END AS type FROM lineitem GROUP BY 1""")
def read_predictions(spark, d):
    """One class for each read over three tables of predictions; reads may stand in several, several times."""
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("read_id"), "l_returnflag")
    return benchmark.prediction_map(*[t.where(F.col("l_returnflag") == f) for f in "ANR"])
