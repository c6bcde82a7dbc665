"""Outputs of detection tools as one table: det_id, segs, type, state, length. Further formats register in PARSERS."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbispan.functions.regions import regions_array
from orbispan.operators.stats import numbered
from orbispan.sources.tables import normalised, read_bed

#: Short type letters of the long type names.
TYPE_OF = {"UeccDNA": "U", "MeccDNA": "M", "CeccDNA": "C", "Uecc": "U", "Mecc": "M", "Cecc": "C", "U": "U", "M": "M", "C": "C"}


def short_type(column: str | Column) -> Column:
    """U, M or C; any other type is 'other'."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_OF.items() for x in kv]), c), F.lit("other"))


def span(segments: Column) -> Column:
    return F.aggregate(segments, F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])


def from_native(df: DataFrame) -> DataFrame:
    """eccDNA_id, Regions, eccDNA_type, State, Length."""
    segs = regions_array("Regions")
    return df.select(F.col("eccDNA_id").alias("det_id"), segs.alias("segs"), short_type("eccDNA_type").alias("type"), F.col("State").alias("state"), F.coalesce(F.col("Length").try_cast("bigint"), span(segs)).alias("length"))


def from_intervals(df: DataFrame, prefix: str, order: tuple[str, ...] = ("chrom", "start", "end")) -> DataFrame:
    """Interval rows as confirmed calls of one locus, numbered by chromosome and place over range partitions."""
    k = F.concat(F.lit(f"{prefix}_"), F.col("_k").cast("string"))
    seg = F.array(F.struct("chrom", "start", "end")).alias("segs")
    rest = [c for c in order if c != "chrom"]
    return numbered(df, "_k", ["chrom", *rest]).select(k.alias("det_id"), seg, F.lit("U").alias("type"), F.lit("Confirmed").alias("state"), (F.col("end") - F.col("start")).alias("length"))


def merged_regions(text: str | Column) -> Column:
    """array<struct<chrom, start, end>> of 'chr1:5-9_+;chr2:1-3_-'."""
    return regions_array(F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"_[+-]", ""))


def from_long_reads(df: DataFrame) -> DataFrame:
    """id, merge_region, merge_len, num_region: several regions make a call multi-locus; without a length they add up."""
    segs = merged_regions("merge_region")
    return df.select(F.col("id").cast("string").alias("det_id"), segs.alias("segs"), F.when(F.col("num_region").try_cast("int") > 1, "M").otherwise("U").alias("type"), F.lit("Confirmed").alias("state"), F.coalesce(F.col("merge_len").try_cast("bigint"), span(segs)).alias("length")).where(F.size("segs") > 0)


def _bed(prefix: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, path: from_intervals(read_bed(spark, path), prefix)


#: Readers by format name.
PARSERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "native": lambda spark, path: from_native(spark.read.csv(path, header=True)),
    "circlemap": _bed("circlemap"),
    "cresil": lambda spark, path: from_long_reads(spark.read.csv(path, header=True, sep="\t")),
    "eccfinder": _bed("eccfinder"),
    "bed": _bed("region"),
    "csv": lambda spark, path: from_intervals(normalised(spark.read.csv(path, header=True)), "region"),
}


def read_detections(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    if fmt not in PARSERS:
        raise ValueError(f"unknown format {fmt}; known: {', '.join(sorted(PARSERS))}")
    return PARSERS[fmt](spark, path)


_TRUTH = ("chrom", "start", "end", "name", "length_text", "strand", "kind", "fragments")


def read_truth(spark: SparkSession, unique: str | None = None, multi: str | None = None, chimeric: str | None = None) -> DataFrame:
    """name, type, length, ord, segs of truth files of eight columns; ord puts unique before multi before chimeric, then rows as
    they stand in their files. Chimeric rows take their segments from the last column."""
    out = None
    for rank, (kind, path) in enumerate((("U", unique), ("M", multi), ("C", chimeric))):
        if not path:
            continue
        bed = read_bed(spark, path, _TRUTH, ordinal="place")
        own = F.array(F.struct("chrom", "start", "end"))
        frags = regions_array("fragments")
        segs = F.when(F.size(frags) > 0, frags).otherwise(own) if kind == "C" else own
        place = F.lit(rank * (1 << 60)) + F.col("place")
        part = bed.select("name", F.lit(kind).alias("type"), F.coalesce(F.col("length_text").try_cast("bigint"), F.col("length")).alias("length"), place.alias("ord"), segs.alias("segs"))
        out = part if out is None else out.unionByName(part)
    return out


def read_consensus(spark: SparkSession, path: str) -> DataFrame:
    """name, consensus of tabular tandem repeat output; the first column is the read, the last the consensus."""
    f = F.split("value", "\t")
    return spark.read.text(path).where(~F.col("value").startswith("#")).select(f.alias("f")).where(F.size("f") >= 2).select(F.col("f")[0].alias("name"), F.element_at("f", -1).alias("consensus"))


def longest_consensus(df: DataFrame) -> DataFrame:
    """name, consensus: the longest consensus of each name, of equals the first by its letters; names without any are left out."""
    known = df.where(F.length("consensus") > 0).withColumn("_n", -F.length("consensus"))
    return known.groupBy("name").agg(F.min(F.struct("_n", "consensus")).alias("_best")).select("name", "_best.consensus")


def read_reports(spark: SparkSession, pattern: str) -> DataFrame:
    """file, scope, key, metric, value of nested JSON reports."""
    inner = "map<string, map<string, map<string, double>>>"
    t = spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", inner).alias("m"))
    a = t.select("file", F.explode("m").alias("scope", "x"))
    b = a.select("file", "scope", F.explode("x").alias("key", "y"))
    return b.select("file", "scope", "key", F.explode("y").alias("metric", "value"))
