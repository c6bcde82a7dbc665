"""Interval tables over the star schema: calls from lineitem, annotations from orders, 22 chromosomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 10_003_200

#: The same tables for the SQL side; a query lists those that it needs after WITH.
CTE = {
    "ecc": """ecc AS (SELECT concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS name,
  'chr' || (l_suppkey % 22 + 1) AS chrom, (l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 15485863) % 10000000 AS start,
  (l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 15485863) % 10000000 + 100 + CAST(l_quantity AS BIGINT) * 40 AS "end",
  100 + CAST(l_quantity AS BIGINT) * 40 AS length, l_returnflag AS type, l_linestatus AS sample, l_returnflag || l_linestatus AS rep FROM lineitem)""",
    "annot": """annot AS (SELECT CAST(o_orderkey AS VARCHAR) AS te_name, 'chr' || (o_custkey % 22 + 1) AS chrom, (o_orderkey * 6151) % 10000000 AS start,
  (o_orderkey * 6151) % 10000000 + 200 + o_orderkey % 3000 AS "end", o_orderpriority AS te_class, o_orderstatus || (o_orderkey % 4) AS te_family,
  (o_orderkey % 400) / 10.0 AS pct_div, 0.5 + (o_orderkey % 100) / 50.0 AS cnv FROM orders)""",
    "genome": """genome AS (SELECT 'chr' || i AS chrom, CAST(10003200 AS BIGINT) AS size FROM range(1, 23) t(i))""",
}


def ctes(*names: str) -> str:
    return "WITH " + ", ".join(CTE[n] for n in names)


def ecc(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    start = (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_linenumber") * 15485863) % 10_000_000
    length = F.lit(100) + F.col("l_quantity").cast("bigint") * 40
    return t.select(
        F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint")).alias("name"),
        F.concat(F.lit("chr"), F.col("l_suppkey") % 22 + 1).alias("chrom"), start.alias("start"), (start + length).alias("end"), length.alias("length"),
        F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("sample"), F.concat("l_returnflag", "l_linestatus").alias("rep"),
    )


def annot(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/orders.parquet")
    start = F.col("o_orderkey") * 6151 % 10_000_000
    return t.select(
        F.col("o_orderkey").cast("string").alias("te_name"), F.concat(F.lit("chr"), F.col("o_custkey") % 22 + 1).alias("chrom"), start.alias("start"),
        (start + 200 + F.col("o_orderkey") % 3000).alias("end"), F.col("o_orderpriority").alias("te_class"), F.concat("o_orderstatus", F.col("o_orderkey") % 4).alias("te_family"),
        (F.col("o_orderkey") % 400 / 10.0).alias("pct_div"), (F.lit(0.5) + F.col("o_orderkey") % 100 / 50.0).alias("cnv"),
    )


def genome(spark: SparkSession, d: str = "") -> DataFrame:
    return spark.range(1, 23).select(F.concat(F.lit("chr"), "id").alias("chrom"), F.lit(SIZE).cast("bigint").alias("size"))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")
