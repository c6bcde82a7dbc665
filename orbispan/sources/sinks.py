"""Writers for region tables, link files and metric reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows of a metric table that is written as one nested document; a larger one is an error, as it is no summary.
REPORT_ROWS = 100_000


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").csv(path, header=True, sep=sep)


def write_bed(df: DataFrame, path: str, by: str | None = None) -> None:
    """Tab-separated chrom, start, end and name if there is one; one folder for each value of `by`."""
    cols = ["chrom", "start", "end"] + (["name"] if "name" in df.columns else []) + ([by] if by else [])
    w = df.select(*cols).write.mode("overwrite")
    (w.partitionBy(by) if by else w).csv(path, sep="\t", header=False)


def write_links(pairs: DataFrame, path: str, colour: Column | None = None) -> None:
    """Six coordinates and a colour option a line, for link plots."""
    cols = ["chrom1", "start1", "end1", "chrom2", "start2", "end2"]
    option = F.concat(F.lit("color="), colour) if colour is not None else F.lit("color=128,128,128")
    pairs.select(F.concat_ws("\t", *cols, option).alias("value")).write.mode("overwrite").text(path)


def write_report(metrics: DataFrame, path: str) -> dict:
    """metrics: scope, key, metric, value. Writes nested JSON as one text file and returns it."""
    tree: dict = {}
    rows = metrics.select("scope", "key", "metric", "value").limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report has at most {REPORT_ROWS} metrics; write longer tables with write_report_csv")
    for r in sorted(rows, key=str):
        tree.setdefault(r["scope"], {}).setdefault(r["key"], {})[r["metric"]] = r["value"]
    text = json.dumps(tree, indent=2, sort_keys=True)
    spark = metrics.sparkSession
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return tree


def write_report_csv(metrics: DataFrame, path: str) -> None:
    """scope, key, metric, value of any number of metrics, sorted within files."""
    metrics.select("scope", "key", "metric", "value").sortWithinPartitions("scope", "key", "metric").write.mode("overwrite").csv(path, header=True)


def report_lines(metrics: DataFrame) -> DataFrame:
    """value: one line for each scope and key, 'scope / key: metric=value, ...' with metrics by name and four decimals."""
    cell = F.concat_ws("=", "metric", F.format_string("%.4f", F.col("value")))
    lines = metrics.groupBy("scope", "key").agg(F.array_sort(F.collect_list(cell)).alias("m"))
    return lines.select(F.concat(F.col("scope"), F.lit(" / "), F.col("key"), F.lit(": "), F.array_join("m", ", ")).alias("value"))


def write_report_text(metrics: DataFrame, path: str) -> None:
    report_lines(metrics).sortWithinPartitions("value").write.mode("overwrite").text(path)
