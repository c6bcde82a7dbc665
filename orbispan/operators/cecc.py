"""Multi-segment calls: records, sample summaries and false discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbispan.functions.regions import chromosome_set, fusion_class, intra_distance, stranded_segments
from orbispan.operators.stats import poisson_at_least, with_quantile
from orbispan.scratch import checkpointed

#: Breakpoint positions of a 3.1 Gb genome at 50 bp, and their pairs.
POSITIONS = 3.1e9 / 50
PAIRS = POSITIONS * (POSITIONS - 1) / 2


def records(calls: DataFrame, kind: str | None = "Cecc", location: str = "location") -> DataFrame:
    """calls with segments, n_segments, fusion_type, intra_distance, chromosomes and total_length; only of `kind` if the
    table has a type column. Rows without a parsed segment are left out."""
    src = calls.where(F.col("type") == kind) if kind and "type" in calls.columns else calls
    out = src.withColumn("segments", stranded_segments(location)).where(F.size("segments") > 0)
    return out.withColumns({"n_segments": F.size("segments"), "fusion_type": fusion_class("segments"), "intra_distance": intra_distance("segments"), "chromosomes": chromosome_set("segments"), "total_length": F.aggregate("segments", F.lit(0).cast("bigint"), lambda a, s: a + s["seg_length"])})


def segment_stats(recs: DataFrame, key: str = "name") -> DataFrame:
    return recs.select(key, F.posexplode("segments").alias("seg", "s")).select(key, "seg", "s.*")


def sample_summary(recs: DataFrame, by: str = "sample") -> DataFrame:
    n = F.count(F.lit(1))
    c = lambda cond, name: F.count_if(cond).alias(name)
    k, f = F.col("n_segments"), F.col("fusion_type")
    recs = checkpointed(recs.select(by, "n_segments", "fusion_type", "total_length", "intra_distance"))
    out = recs.groupBy(by).agg(
        n.alias("total"), c(k == 2, "segments_2"), c(k == 3, "segments_3"), c(k >= 4, "segments_4plus"), c(f == "inter-chromosomal", "inter"), c(f == "intra-chromosomal", "intra"),
        F.bround(F.count_if(f == "inter-chromosomal") / n, 6).alias("inter_fraction"), F.bround(F.avg(k), 6).alias("mean_segments"), F.max(k).alias("max_segments"),
    )
    return with_quantile(with_quantile(out, recs, "total_length", "median_length", keys=[by]), recs, "intra_distance", "median_intra_distance", keys=[by])


def chimeric_fraction(spike: DataFrame) -> DataFrame:
    """mean and sd of AB / (A + B + AB) over spike-in samples."""
    f = F.col("AB") / (F.col("A") + F.col("B") + F.col("AB"))
    return spike.agg(F.avg(f).alias("mean_fraction"), F.stddev_samp(f).alias("sd_fraction"))


def false_discovery(samples: DataFrame, spike: DataFrame, min_reads: int = 2) -> DataFrame:
    """Expected false calls of each sample without a filter and with at least min_reads reads on one breakpoint pair."""
    k = F.col("total_reads") * F.col("mean_fraction")
    out = samples.crossJoin(F.broadcast(chimeric_fraction(spike)))
    if min_reads == 2:
        false = k * (k - 1) / (2 * PAIRS)
    else:
        false = F.lit(PAIRS) * poisson_at_least(F.lit(min_reads), k / PAIRS)
    part = lambda x: F.when(F.col("ceccdna_count") > 0, x / F.col("ceccdna_count"))
    return out.select("sample", "total_reads", F.col("ceccdna_count").alias("observed"), F.col("mean_fraction").alias("chimeric_fraction"), k.alias("expected_false_reads"), part(k).alias("fdr_no_filter"), false.alias("expected_false_filtered"), part(false).alias("fdr_filtered"))
