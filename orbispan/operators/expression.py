"""Gene-set enrichment over thresholds of differential expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbispan.operators.stats import fisher_exact

THRESHOLDS = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0)


def gene_set(df: DataFrame, min_score: float | None = None) -> DataFrame:
    """Distinct trimmed gene names; those under min_score are left out if the table has scores."""
    if min_score is not None and "enrichment_score" in df.columns:
        df = df.where(F.col("enrichment_score") >= min_score)
    return df.select(F.trim("gene_name").alias("gene_name")).where("gene_name <> ''").distinct()


def deg_enrichment(deg: DataFrame, genes: DataFrame, thresholds: Sequence[float] = THRESHOLDS, alpha: float = 0.05) -> DataFrame:
    """direction, threshold, a, b, c, d, enrichment, p_value: genes of the set among up and down regulated ones.

    deg: gene_name, log2fc, padj; one row a gene. a: regulated and in the set, b: regulated only, c: in the set only.
    """
    spark = deg.sparkSession
    flags = deg.join(genes.withColumn("in_set", F.lit(True)), "gene_name", "left").withColumn("in_set", F.coalesce("in_set", F.lit(False)))
    cases = spark.createDataFrame([(d, float(t)) for d in ("up", "down") for t in thresholds], "direction string, threshold double")
    fc = F.when(F.col("direction") == "up", F.col("log2fc")).otherwise(-F.col("log2fc"))
    hit = F.coalesce((fc >= F.col("threshold")) & (F.col("padj") < alpha), F.lit(False))
    c = lambda x, n: F.count_if(x).alias(n)
    counted = flags.crossJoin(F.broadcast(cases)).withColumn("hit", hit).groupBy("direction", "threshold").agg(c(F.col("hit") & F.col("in_set"), "a"), c(F.col("hit") & ~F.col("in_set"), "b"), c(~F.col("hit") & F.col("in_set"), "c"), c(~F.col("hit") & ~F.col("in_set"), "d"))
    n_set, n_hit, n = F.col("a") + F.col("c"), F.col("a") + F.col("b"), F.col("a") + F.col("b") + F.col("c") + F.col("d")
    ratio = F.when((n_set > 0) & (n_hit > 0), (F.col("a") / n_set) / (n_hit / n)).otherwise(0.0)
    return counted.withColumn("enrichment", ratio).withColumn("p_value", fisher_exact("a", "b", "c", "d"))
