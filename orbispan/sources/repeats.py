"""Readers for repeat annotation: UCSC tables, RepeatMasker output, GFF/GTF and BED."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from orbispan.operators.stats import numbered
from orbispan.scratch import checkpointed
from orbispan.sources.order import with_ordinals
from orbispan.sources.tables import gff_attribute

_UCSC = "bin int, swScore int, milliDiv int, milliDel int, milliIns int, genoName string, genoStart bigint, genoEnd bigint, genoLeft bigint, strand string, repName string, repClass string, repFamily string, repStart int, repEnd int, repLeft int, id int"
CANONICAL = ("chrom", "start", "end", "strand", "te_name", "te_class", "te_family", "pct_div")


def read_ucsc(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.csv(path, sep="\t", schema=_UCSC, comment="#")
    return t.select(F.col("genoName").alias("chrom"), F.col("genoStart").alias("start"), F.col("genoEnd").alias("end"), "strand", F.col("repName").alias("te_name"), F.col("repClass").alias("te_class"), F.col("repFamily").alias("te_family"), (F.col("milliDiv") / 10).alias("pct_div"))


def _class_part(text: Column, i: int) -> Column:
    parts = F.split(text, "/")
    return parts[0] if i == 0 else F.when(F.size(parts) > 1, parts[1]).otherwise(parts[0])


def read_repeatmasker(spark: SparkSession, path: str) -> DataFrame:
    """.out files: rows of at least 15 fields of which the first is a number; starts become 0-based, C becomes -."""
    f = F.split(F.trim("value"), r"\s+")
    t = spark.read.text(path).select(f.alias("f")).where((F.size("f") >= 15) & F.col("f")[0].rlike(r"^\d+$"))
    c = F.regexp_replace(F.col("f")[10], r"\*$", "")
    return t.select(F.col("f")[4].alias("chrom"), (F.col("f")[5].try_cast("bigint") - 1).alias("start"), F.col("f")[6].try_cast("bigint").alias("end"), F.when(F.col("f")[8] == "C", "-").otherwise(F.col("f")[8]).alias("strand"), F.col("f")[9].alias("te_name"), _class_part(c, 0).alias("te_class"), _class_part(c, 1).alias("te_family"), F.col("f")[1].try_cast("double").alias("pct_div")).where("start is not null and end is not null")


def read_gff_repeats(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.csv(path, sep="\t", comment="#", schema="chrom string, source string, feature string, start bigint, end bigint, score string, strand string, phase string, attributes string").where("end is not null")
    a = lambda *names: F.coalesce(*[gff_attribute("attributes", n) for n in names])
    k = F.coalesce(a("class", "repeat_class"), F.col("feature"))
    return t.select("chrom", (F.col("start") - 1).alias("start"), "end", "strand", F.coalesce(a("Name", "ID", "gene_id"), F.lit("")).alias("te_name"), k.alias("te_class"), F.coalesce(a("family", "repeat_family", "family_id"), k).alias("te_family"), F.coalesce(a("divergence").try_cast("double"), F.lit(0.0)).alias("pct_div"))


def read_bed_repeats(spark: SparkSession, path: str) -> DataFrame:
    """BED with 4 to 8 or more columns; a number in column 5 is a score, text there a class."""
    f = F.split("value", "\t")
    t = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser)") & (F.length(F.trim("value")) > 0)).select(f.alias("f")).where(F.size("f") >= 3)
    at = lambda i: F.when(F.size("f") > i, F.col("f")[i])
    scored = at(4).try_cast("double").isNotNull()
    name = F.coalesce(at(3), F.lit("unknown"))
    klass = F.when(F.size("f") >= 7, at(6)).when((F.size("f") >= 5) & ~scored, at(4)).otherwise(F.lit("Unknown"))
    family = F.when(F.size("f") >= 8, at(7)).when((F.size("f") == 6) & ~scored & ~at(5).isin("+", "-", "."), at(5)).otherwise(klass)
    strand = F.when(at(5).isin("+", "-"), at(5)).otherwise(".")
    out = t.select(at(0).alias("chrom"), at(1).try_cast("bigint").alias("start"), at(2).try_cast("bigint").alias("end"), strand.alias("strand"), name.alias("te_name"), klass.alias("te_class"), family.alias("te_family"), F.lit(0.0).alias("pct_div"))
    return out.where("start is not null and end is not null")


def sniff(spark: SparkSession, path: str) -> str:
    """ucsc, gff, repeatmasker or bed, by the first data line."""
    head = spark.read.text(path).where(~F.col("value").rlike("^#") & (F.length(F.trim("value")) > 0)).head(5)
    for row in head:
        line = row[0]
        tabs = line.split("\t")
        if len(tabs) == 17:
            return "ucsc"
        if len(tabs) == 9 and tabs[3].isdigit() and tabs[4].isdigit():
            return "gff"
        if len(tabs) < 3:
            fields = line.split()
            if len(fields) >= 15 and fields[0].isdigit():
                return "repeatmasker"
            continue
        return "bed"
    return "repeatmasker"


#: Readers by format; further ones may be added.
READERS = {"ucsc": read_ucsc, "gff": read_gff_repeats, "repeatmasker": read_repeatmasker, "bed": read_bed_repeats}


def read_repeats(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    return READERS[fmt or sniff(spark, path)](spark, path)


def ucsc_record(raw: DataFrame) -> DataFrame:
    """RepeatMasker fields (begin, end, div, strand, class_family) as UCSC ones: 0-based start, tenths of percent."""
    c = F.split("class_family", "/")
    out = raw.withColumns({"start": F.col("begin") - 1, "milli_div": F.bround(F.col("div") * 10, 0).cast("int"), "rep_class": c[0], "rep_family": F.when(F.size(c) > 1, c[1]).otherwise(c[0])})
    return out.withColumn("strand", F.when(F.col("strand") == "C", "-").otherwise(F.col("strand")))


def rmsk_rows(spark: SparkSession, path: str, alias: DataFrame | None = None) -> DataFrame:
    """The 17 UCSC columns of RepeatMasker output, as strings, with place (the line's in the files) and skipped.

    Lines that are blank, headers, or under 15 fields are no rows. Rows whose numbers cannot be read, or whose contig the
    alias table (name, alias) does not have, are skipped ones.
    """
    line = F.regexp_replace(F.trim(F.regexp_replace("value", r"\s+", " ")), r" ?\*$", "")
    f = F.split(line, " ")
    t = with_ordinals(spark.read.text(path), "place").where(~F.ltrim("value").rlike("^(SW|score)")).select("place", f.alias("f")).where(F.size("f") >= 15)
    whole, tenths = (lambda i: F.col("f")[i].try_cast("bigint")), (lambda i: F.rint(F.col("f")[i].try_cast("double") * 10).cast("bigint"))
    c = F.split(F.col("f")[10], "/", 2)
    t = t.withColumn("chrom", F.col("f")[4])
    if alias is not None:
        named = alias.select(F.col("name").alias("_n"), F.col("alias").alias("_a")).dropDuplicates(["_n"])
        t = t.join(named, F.col("chrom") == F.col("_n"), "left").withColumn("chrom", F.col("_a")).drop("_n", "_a")
    numbers = {"swScore": whole(0), "milliDiv": tenths(1), "milliDel": tenths(2), "milliIns": tenths(3), "genoStart": whole(5) - 1, "genoEnd": whole(6)}
    lost = F.col("chrom").isNull()
    for x in numbers.values():
        lost |= x.isNull()
    texts = {"bin": F.lit("0"), "genoName": F.col("chrom"), "genoLeft": F.col("f")[7], "strand": F.when(F.col("f")[8] == "C", "-").otherwise("+"), "repName": F.col("f")[9], "repClass": c[0], "repFamily": F.when(F.size(c) > 1, c[1]).otherwise(c[0]), "repStart": F.lit("0"), "repEnd": F.lit("0"), "repLeft": F.lit("(0)")}
    cols = {**{k: v.cast("string") for k, v in numbers.items()}, **texts}
    names = [x.split()[0] for x in _UCSC.split(", ")][:-1]
    return t.select("place", *[cols[n].alias(n) for n in names], lost.alias("skipped"))


def convert_repeats(spark: SparkSession, path: str, out: str, alias: DataFrame | None = None, bed: bool = False) -> dict[str, int]:
    """Write RepeatMasker output as a UCSC table, with ids from 0 in the order of the input, or as BED of eight columns; files
    in order of their names. Returns how many rows were converted and skipped, counted by the job that reads them."""
    seen = Observation()
    # written before it is dealt to ranges, which read it twice
    rows = checkpointed(rmsk_rows(spark, path, alias).observe(seen, F.count_if(~F.col("skipped")).alias("converted"), F.count_if("skipped").alias("skipped")))
    kept = numbered(rows.where(~F.col("skipped")), "_k", ["place"]).withColumn("id", (F.col("_k") - 1).cast("string"))
    fields = ["genoName", "genoStart", "genoEnd", "repName", "swScore", "strand", "repClass", "repFamily"] if bed else [x.split()[0] for x in _UCSC.split(", ")]
    kept.repartitionByRange("place").sortWithinPartitions("place").select(F.concat_ws("\t", *fields).alias("value")).write.mode("overwrite").text(out)
    return seen.get


def with_alias(df: DataFrame, alias: DataFrame, column: str = "chrom") -> DataFrame:
    """Rename contigs by a table (name, alias); unknown ones keep their name. The table has a row for each contig."""
    a = alias.select(F.col("name").alias("_n"), F.col("alias").alias("_a")).dropDuplicates(["_n"])
    return df.join(a, df[column] == F.col("_n"), "left").withColumn(column, F.coalesce("_a", column)).drop("_n", "_a")
