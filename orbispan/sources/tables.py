"""Readers for region tables with one set of canonical names, and small dimension tables."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbispan.operators.stats import numbered
from orbispan.sources.order import with_ordinals

#: Accepted spellings by canonical name, in order of precedence; case does not matter.
ALIASES = {
    "chrom": ["echr", "chrom", "chr", "chromosome", "#chrom", "#chr", "seqnames"],
    "start": ["estart", "start", "chromstart", "window_start", "begin"],
    "end": ["eend", "end", "chromend", "window_end", "stop"],
    "name": ["ename", "eccdna_name", "eccdna_id", "name", "id"],
    "length": ["elength", "eccdna_len", "length", "len"],
    "type": ["etype", "eccdna_type", "type"],
    "gene_name": ["gene_name", "gene", "gene_symbol", "symbol"],
    "log2fc": ["log2fc", "logfc", "log2foldchange", "log2_fold_change"],
    "padj": ["padj", "fdr", "adj.p.val", "p_adj", "q_value"],
    "p_value": ["p_value", "pvalue", "p.value", "pval"],
}

# Chromosome sizes of the two human reference builds, chr1 to chr22, chrX and chrY.
SIZES = {
    "hg38": [248956422, 242193529, 198295559, 190214555, 181538259, 170805979, 159345973, 145138636, 138394717, 133797422, 135086622, 133275309, 114364328, 107043718, 101991189, 90338345, 83257441, 80373285, 58617616, 64444167, 46709983, 50818468, 156040895, 57227415],
    "hg19": [249250621, 243199373, 198022430, 191154276, 180915260, 171115067, 159138663, 146364022, 141213431, 135534747, 135006516, 133851895, 115169878, 107349540, 102531392, 90354753, 81195210, 78077248, 59128983, 63025520, 48129895, 51304566, 155270560, 59373566],
}


def find_column(df: DataFrame, canonical: str) -> str | None:
    by = {c.lower(): c for c in df.columns}
    return next((by[a] for a in ALIASES[canonical] if a in by), None)


def normalised(df: DataFrame, required: tuple[str, ...] = ("chrom", "start", "end"), optional: tuple[str, ...] = ("name", "length", "type")) -> DataFrame:
    """Canonical columns first, other columns after; rows whose coordinates are no numbers are dropped, length is filled."""
    found = {c: find_column(df, c) for c in (*required, *optional)}
    if lost := [c for c in required if not found[c]]:
        raise ValueError(f"no column for {', '.join(lost)} among {', '.join(df.columns)}")
    used = set(found.values())
    kind = {"start": "bigint", "end": "bigint", "length": "bigint"}
    cols = [F.col(f"`{v}`").try_cast(kind.get(k, "string")).alias(k) for k, v in found.items() if v]
    out = df.select(*cols, *[F.col(f"`{c}`") for c in df.columns if c not in used])
    if "start" in required:
        out = out.where("start is not null and end is not null")
        fill = F.coalesce("length", F.col("end") - F.col("start")) if found.get("length") else F.col("end") - F.col("start")
        out = out.withColumn("length", fill)
    return out


def read_csv(spark: SparkSession, path: str, sep: str | None = None, normalise: bool = True, ordinal: str | None = None) -> DataFrame:
    """ordinal: a column for each row's place in the files."""
    sep = sep or ("\t" if str(path).endswith((".tsv", ".txt", ".bed")) else ",")
    df = spark.read.csv(path, header=True, sep=sep)
    if ordinal:
        df = with_ordinals(df, ordinal)
    return normalised(df) if normalise else df


_BED = ("chrom", "start", "end", "name", "score", "strand")


def read_bed(spark: SparkSession, path: str, names: tuple[str, ...] = _BED, ordinal: str | None = None) -> DataFrame:
    """Headerless BED; comments, track and browser lines are skipped, as is a leading bin column before a chromosome. ordinal: a
    column for each line's place in the files."""
    f = F.split("value", "\t")
    text = spark.read.text(path)
    place = [ordinal] if ordinal else []
    if ordinal:
        text = with_ordinals(text, ordinal)
    rows = text.where(~F.col("value").rlike("^(#|track|browser)") & (F.length(F.trim("value")) > 0)).select(f.alias("f"), *place)
    shifted = F.when((F.size("f") >= 4) & F.col("f")[0].rlike(r"^\d+$") & F.col("f")[1].startswith("chr"), F.slice("f", 2, 1000)).otherwise(F.col("f"))
    rows = rows.select(shifted.alias("f"), *place).where(F.size("f") >= 3)
    kind = {"start": "bigint", "end": "bigint"}
    out = rows.select(*place, *[F.when(F.size("f") > i, F.col("f")[i]).try_cast(kind.get(n, "string")).alias(n) for i, n in enumerate(names)])
    return out.where("start is not null and end is not null").withColumn("length", F.col("end") - F.col("start"))


def sniff(spark: SparkSession, path: str) -> str:
    """bed or csv: by extension, else by a tab and a first field that names a chromosome."""
    ext = PurePosixPath(str(path)).suffix.lower()
    if ext in (".bed", ".csv"):
        return ext[1:]
    head = spark.read.text(path).head(1)
    return "bed" if head and "\t" in head[0][0] and head[0][0].startswith("chr") else "csv"


def read_regions(spark: SparkSession, *paths: str) -> DataFrame:
    """Union of region tables of either format. The rows of one without names are called eccDNA_0, eccDNA_1 and so on, as they
    stand in its files, rows without coordinates not counted."""
    out = None
    for p in paths:
        bed = sniff(spark, p) == "bed"
        part = read_bed(spark, p) if bed else read_csv(spark, p)
        if "name" not in part.columns or part.where(F.col("name").isNotNull()).isEmpty():
            part = read_bed(spark, p, ordinal="_place") if bed else read_csv(spark, p, ordinal="_place")
            part = numbered(part, "_k", ["_place"]).withColumn("name", F.concat(F.lit("eccDNA_"), (F.col("_k") - 1).cast("string"))).drop("_k", "_place")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def stem(path: str | Column) -> Column:
    """File name without folders and extension."""
    return F.regexp_extract(path if isinstance(path, Column) else F.lit(path), r"([^/]+?)(?:\.[^./]+)?$", 1)


def read_directory(spark: SparkSession, pattern: str, sep: str = ",") -> DataFrame:
    """All files of a pattern with sample, the stem of each row's file."""
    return spark.read.csv(pattern, header=True, sep=sep).withColumn("sample", stem(F.input_file_name()))


def genome_sizes(spark: SparkSession, build: str = "hg38") -> DataFrame:
    names = [f"chr{i}" for i in range(1, 23)] + ["chrX", "chrY"]
    return spark.createDataFrame(list(zip(names, SIZES[build])), "chrom string, size bigint")


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """chrom, size of a two-column table or a .fai index."""
    f = F.split("value", r"\s+")
    return spark.read.text(path).select(f[0].alias("chrom"), f[1].try_cast("bigint").alias("size")).where("size is not null")


def resolve_names(df: DataFrame, genome: DataFrame, column: str = "chrom") -> DataFrame:
    """Names as the genome has them: as they are, else with or without 'chr'; unknown ones become null."""
    g = genome.select(F.col("chrom").alias("_g"))
    swapped = F.when(F.col(column).startswith("chr"), F.substring(column, 4, 1 << 20)).otherwise(F.concat(F.lit("chr"), column))
    a, b = g.withColumnRenamed("_g", "_a"), g.withColumnRenamed("_g", "_b")
    out = df.withColumn("_s", swapped).join(F.broadcast(a), F.col(column) == F.col("_a"), "left").join(F.broadcast(b), F.col("_s") == F.col("_b"), "left")
    return out.withColumn(column, F.coalesce("_a", "_b")).drop("_s", "_a", "_b")


def gff_attribute(column: str, name: str) -> Column:
    """Value of key=value or key "value" in an attribute text; null without it."""
    v = F.regexp_extract(F.col(column), rf'(?:^|;)\s*{name}(?:=|\s+"?)([^;"]*)', 1)
    return F.nullif(F.trim(v), F.lit(""))


def read_gff(spark: SparkSession, path: str, attributes: tuple[str, ...] = ("ID", "Name", "Parent", "gene_id", "gene_name", "gene_type", "biotype")) -> DataFrame:
    """Nine GFF3 columns, 1-based as in the file, promoted attributes and source_file."""
    t = spark.read.csv(path, sep="\t", comment="#", schema="seqid string, source string, type string, start bigint, end bigint, score string, strand string, phase string, attributes string").where("end is not null")
    return t.select("seqid", "source", "type", "start", "end", "score", "strand", "phase", *[gff_attribute("attributes", a).alias(a) for a in attributes], stem(F.input_file_name()).alias("source_file"))


def read_cnv(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, cnv of a headerless four-column table; rows without numbers are dropped."""
    t = spark.read.csv(path, sep="\t", comment="#", schema="chrom string, start string, end string, cnv string")
    return t.select("chrom", F.col("start").try_cast("bigint").alias("start"), F.col("end").try_cast("bigint").alias("end"), F.col("cnv").try_cast("double").alias("cnv")).where("start is not null and end is not null and cnv is not null")


def cnv_to_bed(df: DataFrame) -> DataFrame:
    """1-based copy number rows as 0-based BED with a file-safe cell line."""
    return df.withColumns({"start": F.col("start") - 1, "cell_line": F.regexp_replace("cell_line", r"[^A-Za-z0-9._-]", "_")})


def read_excluded(spark: SparkSession, path: str) -> DataFrame:
    """Regions to leave out: BED, gap tables, or the centromeres (acen) of a cytoband table."""
    f = read_bed(spark, path, ("chrom", "start", "end", "name", "stain"))
    bands = F.max((F.col("stain").isin("acen", "gneg", "gpos25", "gpos50", "gpos75", "gpos100", "gvar", "stalk")).cast("int"))
    is_bands = f.agg(bands.alias("b")).first()["b"] == 1
    return (f.where("stain = 'acen'") if is_bands else f).select("chrom", "start", "end")


def read_deg(spark: SparkSession, path: str) -> DataFrame:
    """gene_name, log2fc, padj; without an adjusted p-value the raw one stands in."""
    df = read_csv(spark, path, normalise=False)
    name, fc = find_column(df, "gene_name"), find_column(df, "log2fc")
    p = find_column(df, "padj") or find_column(df, "p_value")
    if not (name and fc and p):
        raise ValueError("a table of differential genes needs a name, a fold change and a p-value")
    return df.select(F.trim(F.col(f"`{name}`")).alias("gene_name"), F.col(f"`{fc}`").try_cast("double").alias("log2fc"), F.col(f"`{p}`").try_cast("double").alias("padj"))
