"""Queries that write the tables in a file format to the shared folder and read them back with its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orbispan.plans.registry import query
from orbispan.plans.views import annot, ctes, ecc, table
from orbispan.scratch import scratch_dir
from orbispan.operators.benchmark import first_truth
from orbispan.operators.sequences import fetched
from orbispan.sources import detectors, order, repeats, sequences, sinks, tables


def _place(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/orbispan/files-{name}-{uuid.uuid4().hex}"


def _text_file(df, name: str, *parts, sep: str = "\t") -> str:
    """Lines of the given columns, as text files; returns their folder."""
    path = _place(df.sparkSession, name)
    df.select(F.concat_ws(sep, *parts).alias("value")).write.text(path)
    return path


@query(ctes("ecc") + ' SELECT name, chrom, start, "end", length FROM ecc')
def file_csv(spark, d):
    path = _place(spark, "csv")
    sinks.write_csv(ecc(spark, d).select(F.col("name").alias("eName"), F.col("chrom").alias("eChr"), F.col("start").alias("eStart"), F.col("end").alias("eEnd")), path)
    return tables.read_csv(spark, path).select("name", "chrom", "start", "end", "length")


@query(ctes("ecc") + ' SELECT name, chrom, start, "end", length FROM ecc')
def file_bed(spark, d):
    path = _place(spark, "bed")
    sinks.write_bed(ecc(spark, d).select("chrom", "start", "end", "name"), path)
    return tables.read_bed(spark, path, ("chrom", "start", "end", "name")).select("name", "chrom", "start", "end", "length")


@query(ctes("ecc") + """ SELECT sample, chrom, count(*) AS n, CAST(sum(length) AS BIGINT) AS bp FROM ecc GROUP BY 1, 2""")
def file_bed_by_sample(spark, d):
    path, both = _place(spark, "bed-by-sample"), []
    sinks.write_bed(ecc(spark, d).select("chrom", "start", "end", "name", "sample"), path, by="sample")
    for s in ("F", "O"):
        both.append(tables.read_bed(spark, f"{path}/sample={s}", ("chrom", "start", "end", "name")).withColumn("sample", F.lit(s)))
    return both[0].unionByName(both[1]).groupBy("sample", "chrom").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bp"))


def _gff(spark, d) -> str:
    a = annot(spark, d)
    attributes = F.concat(F.lit("ID="), "te_name", F.lit(";class="), "te_class", F.lit(";family="), "te_family", F.lit(";divergence="), "pct_div")
    return _text_file(a, "gff", "chrom", F.lit("maker"), F.lit("repeat"), (F.col("start") + 1).cast("string"), F.col("end").cast("string"), F.lit("."), F.lit("+"), F.lit("."), attributes)


@query(ctes("annot") + """ SELECT te_name AS "ID", chrom AS seqid, 'repeat' AS type, start + 1 AS start, "end", '+' AS strand FROM annot""")
def file_gff(spark, d):
    return tables.read_gff(spark, _gff(spark, d)).select("ID", "seqid", "type", "start", "end", "strand")


@query(ctes("annot") + """ SELECT te_name, chrom, start, "end", '+' AS strand, te_class, te_family, pct_div::DOUBLE AS pct_div FROM annot""")
def file_gff_repeats(spark, d):
    return repeats.read_gff_repeats(spark, _gff(spark, d)).select("te_name", "chrom", "start", "end", "strand", "te_class", "te_family", "pct_div")


@query(ctes("annot") + """ SELECT te_name, chrom, start, "end", te_class, te_family, pct_div::DOUBLE AS pct_div FROM annot""")
def file_ucsc_repeats(spark, d):
    zero, one = F.lit("0"), F.lit("1")
    path = _text_file(annot(spark, d), "rmsk", one, one, F.round(F.col("pct_div") * 10).cast("int").cast("string"), zero, zero, "chrom", F.col("start").cast("string"), F.col("end").cast("string"), zero, F.lit("+"), "te_name", "te_class", "te_family", one, one, zero, one)
    return repeats.read_ucsc(spark, path).select("te_name", "chrom", "start", "end", "te_class", "te_family", "pct_div")


@query(ctes("annot") + """ SELECT te_name, chrom, start, "end", CASE WHEN start % 2 = 0 THEN '-' ELSE '+' END AS strand, 'DNA' AS te_class, te_family, pct_div::DOUBLE AS pct_div FROM annot""")
def file_repeatmasker(spark, d):
    a, zero = annot(spark, d), F.lit("0")
    lines = F.concat_ws("  ", F.lit("  239"), F.col("pct_div").cast("string"), zero, zero, "chrom", (F.col("start") + 1).cast("string"), F.col("end").cast("string"), F.lit("(0)"), F.when(F.col("start") % 2 == 0, "C").otherwise("+"), "te_name", F.concat(F.lit("DNA/"), "te_family"), zero, F.lit("10"), zero, F.lit("7"))
    head = a.limit(1).select(F.lit("SW  perc perc perc query position").alias("value"))
    path = _place(spark, "out")
    a.select(lines.alias("value")).unionByName(head).write.text(path)
    return repeats.read_repeatmasker(spark, path).select("te_name", "chrom", "start", "end", "strand", "te_class", "te_family", "pct_div")


@query(ctes("annot") + """ SELECT te_name, chrom, start, "end", '+' AS strand, te_class, te_family FROM annot""")
def file_bed_repeats(spark, d):
    path = _text_file(annot(spark, d), "repeats-bed", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), "te_name", F.lit("12"), F.lit("+"), "te_class", "te_family")
    return repeats.read_bed_repeats(spark, path).select("te_name", "chrom", "start", "end", "strand", "te_class", "te_family")


@query(ctes("annot") + """ SELECT chrom, start, "end", cnv::DOUBLE AS cnv FROM annot WHERE start % 7 <> 0""")
def file_cnv(spark, d):
    """Rows without a number are dropped."""
    value = F.when(F.col("start") % 7 == 0, "NA").otherwise(F.col("cnv").cast("string"))
    return tables.read_cnv(spark, _text_file(annot(spark, d), "cnv", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), value))


@query("""SELECT 'g' || user_id AS gene_name, round(avg(value), 4) AS log2fc, (user_id % 97) / 970.0::DOUBLE AS padj FROM events GROUP BY user_id""")
def file_deg(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.round(F.avg("value"), 4).alias("logFC"))
    path = _place(spark, "deg")
    sinks.write_csv(e.select(F.concat(F.lit(" g"), "user_id").alias("Gene"), "logFC", (F.col("user_id") % 97 / F.lit(970.0)).alias("FDR")), path)
    return tables.read_deg(spark, path)


@query(ctes("ecc") + """ SELECT chrom || chr(9) || start || chr(9) || "end" || chr(9) || chrom || chr(9) || "end" || chr(9) || "end" + 1 || chr(9) || 'color=128,128,128' AS value FROM ecc""")
def file_links(spark, d):
    path = _place(spark, "links")
    e = ecc(spark, d)
    sinks.write_links(e.select(F.col("chrom").alias("chrom1"), F.col("start").alias("start1"), F.col("end").alias("end1"), F.col("chrom").alias("chrom2"), F.col("end").alias("start2"), (F.col("end") + 1).alias("end2")), path)
    return spark.read.text(path)


@query(ctes("ecc") + """, m AS (SELECT sample, type, count(*)::DOUBLE AS n, sum(length)::DOUBLE AS bp FROM ecc GROUP BY 1, 2)
SELECT sample || ' / ' || type || ': bp=' || printf('%.4f', bp) || ', n=' || printf('%.4f', n) AS value FROM m""")
def file_report(spark, d):
    m = ecc(spark, d).groupBy("sample", "type").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("length").cast("double").alias("bp"))
    long = m.select(F.col("sample").alias("scope"), F.col("type").alias("key"), F.explode(F.create_map(F.lit("n"), "n", F.lit("bp"), "bp")).alias("metric", "value"))
    path = _place(spark, "report")
    sinks.write_report_text(long, path)
    return spark.read.text(path)


#: Reads of the calls: 32 bases and qualities from digests, the qualities of a third beginning with '@'.
_FASTQ = ctes("ecc") + """, r AS (SELECT 'r' || md5(name) || ' ' || chrom AS read_id, translate(md5(name), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq,
  CASE WHEN start % 3 = 0 THEN '@' ELSE 'I' END || substr(md5(name), 2) AS quality FROM ecc)"""


def _reads(spark, d):
    h = F.md5(F.col("name").cast("binary"))
    mark = F.when(F.col("start") % 3 == 0, "@").otherwise("I")
    return ecc(spark, d).select(F.concat(F.lit("r"), h, F.lit(" "), "chrom").alias("read_id"), F.translate(h, "0123456789abcdef", "ACGT" * 4).alias("seq"), F.concat(mark, F.expr("substring(md5(cast(name as binary)), 2)")).alias("quality"))


@query(_FASTQ + " SELECT read_id, split_part(read_id, ' ', 1) AS name, seq, quality FROM r")
def file_fastq(spark, d):
    path = _place(spark, "fastq")
    sequences.write_fastq(_reads(spark, d), path)
    return sequences.read_fastq(spark, path).select("read_id", "name", "seq", "quality")


@query(_FASTQ + " SELECT read_id, seq, quality, row_number() OVER (ORDER BY read_id, seq, quality) - 1 AS place FROM r")
def fastq_sorted(spark, d):
    """Reads by name as they stand in the written files, one file after the other."""
    path = _place(spark, "fastq-sorted")
    sequences.write_fastq(_reads(spark, d), path, by_name=True)
    first = order.with_ordinals(spark.read.text(path), out="line", in_file="own", file="file").where("own = 0").select("file", (F.col("line") / 4).cast("long").alias("before"))
    return sequences.read_fastq(spark, path).join(first, "file").select("read_id", "seq", "quality", (F.col("before") + F.col("record")).alias("place"))


#: The letters of each document as a contig.
_CONTIGS = """WITH t AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM documents WHERE regexp_matches(text, '[A-Za-z]'))"""


def _contigs(spark, d) -> str:
    t = table(spark, d, "documents").select(F.concat_ws(" ", "doc_id", F.lit("5'->3' strand"), "lang").alias("name"), F.regexp_replace("text", "[^A-Za-z]", "").alias("seq")).where("seq <> ''")
    path = _place(spark, "fasta")
    sequences.write_fasta(t, path)
    return path


@query(_CONTIGS + " SELECT CAST(doc_id AS VARCHAR) AS chrom, CAST(b // 1000 AS BIGINT) AS chunk, substr(s, CAST(b + 1 AS BIGINT), 1000) AS seq FROM t, unnest(range(0, CAST(length(s) AS BIGINT), 1000)) g(b)")
def file_fasta(spark, d):
    return sequences.read_fasta(spark, _contigs(spark, d), 1000)


@query(_CONTIGS + " SELECT CAST(doc_id AS VARCHAR) AS chrom, CAST(length(s) AS BIGINT) AS length, CAST(least(80, length(s)) AS BIGINT) AS line_bases FROM t")
def fasta_sizes(spark, d):
    return sequences.fasta_index(spark, _contigs(spark, d)).select("chrom", "length", "line_bases")


@query(_CONTIGS + """, r AS (SELECT doc_id, s, i, doc_id * 7919 * (i + 1) % length(s) AS start FROM t, range(0, 3) g(i))
SELECT doc_id || ':' || i AS name, length(substr(s, start + 1, 2500))::INTEGER AS n, md5(substr(s, start + 1, 2500)) AS seq_md5 FROM r""")
def fetch_by_index(spark, d):
    """Three regions of each contig from the byte ranges that an index of the written files gives."""
    path = _contigs(spark, d)
    index = sequences.fasta_index(spark, path)
    sequences.write_index(index, f"{path}-index", files=True)
    e = index.select("chrom", "length", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    start = F.col("chrom").cast("bigint") * 7919 * (F.col("i") + 1) % F.col("length")
    e = e.select(F.concat_ws(":", "chrom", "i").alias("name"), "chrom", start.alias("start"), F.least(start + 2500, F.col("length")).alias("end"))
    chunks = sequences.read_indexed_fasta(spark, path, f"{path}-index", 1000)
    return fetched(e, chunks, 1000).select("name", F.length("seq").alias("n"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


def _in_order(df, name: str, key: str, line) -> str:
    """Lines in files whose names and rows follow the digest of a key, not the places."""
    path = _place(df.sparkSession, name)
    df.withColumn("_h", F.md5(F.col(key).cast("binary"))).orderBy("_h").select(line.alias("value")).write.text(path)
    return path


@query(ctes("ecc") + """ SELECT 'eccDNA_' || (row_number() OVER (ORDER BY md5(name)) - 1) AS name, chrom, start, "end" FROM ecc""")
def file_unnamed_regions(spark, d):
    """Regions without names, called by their place in the files."""
    path = _in_order(ecc(spark, d), "unnamed", "name", F.concat_ws("\t", "chrom", "start", "end"))
    return tables.read_regions(spark, path).select("name", "chrom", "start", "end")


@query(ctes("ecc") + """, t AS (SELECT name, chrom, start, "end", length, CASE WHEN length % 3 = 0 THEN 'M' ELSE 'U' END AS type, md5(name) AS h FROM ecc WHERE start % 4 = 0),
o AS (SELECT *, row_number() OVER (ORDER BY type = 'M', h) AS ord FROM t), d AS (SELECT name, chrom, start + start % 300 AS start, "end" + start % 300 AS "end" FROM ecc),
p AS (SELECT d.name AS det_id, o.name AS truth_name, o.type AS truth_type, row_number() OVER (PARTITION BY d.name ORDER BY o.ord) AS k FROM d JOIN o ON d.chrom = o.chrom AND d.start < o."end" AND o.start < d."end"
  WHERE (least(d."end", o."end") - greatest(d.start, o.start))::DOUBLE / least(d."end" - d.start, o."end" - o.start) >= 0.5)
SELECT det_id, truth_name, truth_type FROM p WHERE k = 1""")
def file_truth(spark, d):
    """The first truth of moved calls, in the order of unsorted truth files, unique before multi."""
    e = ecc(spark, d)
    t = e.where("start % 4 = 0")
    line = F.concat_ws("\t", "chrom", "start", "end", "name", "length", F.lit("+"), F.lit("."), F.lit("."))
    unique, multi = (_in_order(t.where(c), f"truth-{k}", "name", line) for k, c in (("u", "length % 3 <> 0"), ("m", "length % 3 = 0")))
    truth = detectors.read_truth(spark, unique, multi).select("name", "type", "length", "ord", F.explode("segs").alias("s")).select("name", "type", "length", "ord", "s.*")
    moved = e.select(F.col("name").alias("det_id"), F.lit(0).alias("region_ord"), "chrom", (F.col("start") + F.col("start") % 300).alias("start"), (F.col("end") + F.col("start") % 300).alias("end"))
    return first_truth(moved, truth, 0.5).select("det_id", "truth_name", "truth_type")


@query(ctes("annot") + """, r AS (SELECT *, row_number() OVER (ORDER BY md5(te_name)) - 1 AS k FROM annot WHERE chrom <> 'chr7' AND start % 11 <> 0)
SELECT CAST(k AS VARCHAR) AS id, replace(chrom, 'chr', 'NC_') AS "genoName", CAST(start AS VARCHAR) AS "genoStart", CAST("end" AS VARCHAR) AS "genoEnd", CAST(CAST(round_even(pct_div::DOUBLE * 10, 0) AS BIGINT) AS VARCHAR) AS "milliDiv",
  CASE WHEN start % 2 = 0 THEN '-' ELSE '+' END AS strand, te_name AS "repName", translate(te_class, ' ', '_') AS "repClass", te_family AS "repFamily" FROM r""")
def file_rmsk(spark, d):
    """Repeat output in an order of its own, converted with contig names from a table; one contig is unknown there, and some
    rows have no number as their start."""
    a = annot(spark, d)
    start = F.when(F.col("start") % 11 == 0, "none").otherwise((F.col("start") + 1).cast("string"))
    line = F.concat_ws(" ", F.lit(" 1504"), "pct_div", F.lit("0.4"), F.lit("1.3"), "chrom", start, "end", F.lit("(99)"), F.when(F.col("start") % 2 == 0, "C").otherwise("+"), "te_name", F.concat_ws("/", F.translate("te_class", " ", "_"), "te_family"), F.lit("1 463 (0) 1 *"))
    path = _in_order(a, "out", "te_name", line)
    alias = a.select("chrom").distinct().where("chrom <> 'chr7'").select(F.col("chrom").alias("name"), F.regexp_replace("chrom", "chr", "NC_").alias("alias"))
    repeats.convert_repeats(spark, path, f"{path}-rmsk", alias)
    names = ["bin", "swScore", "milliDiv", "milliDel", "milliIns", "genoName", "genoStart", "genoEnd", "genoLeft", "strand", "repName", "repClass", "repFamily", "repStart", "repEnd", "repLeft", "id"]
    t = spark.read.csv(f"{path}-rmsk", sep="\t", schema=", ".join(f"{n} string" for n in names))
    return t.select("id", "genoName", "genoStart", "genoEnd", "milliDiv", "strand", "repName", "repClass", "repFamily")
