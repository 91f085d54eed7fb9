"""The harness tables as the engine's inputs: a sensor grid, raw records and text segments, each also as SQL.

The grid has the weekly metrics of ``lineitem``: 5 metrics in total and for each of 3 return flags, 20 sensors over some 358
weeks in episodes of 120 weeks. Its rows are bounded by weeks and sensors; only the aggregation sees all raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WEEKS_OF_EPISODE = 120

GRID = """
raw_weeks AS (
  SELECT CAST(date_diff('day', TIMESTAMP '1994-01-01', date_trunc('day', l_shipdate)) // 7 AS BIGINT) AS t, l_returnflag AS flag,
         CAST(round(l_quantity * 100) AS BIGINT) AS quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS price,
         CAST(round(l_discount * 100) AS BIGINT) AS discount, CAST(round(l_tax * 100) AS BIGINT) AS tax FROM lineitem
), week_metrics AS (
  SELECT t, flag, CAST(count(*) AS DOUBLE) AS rows_count, CAST(sum(quantity) AS DOUBLE) / (count(*) * 100) AS quantity, CAST(sum(price) AS DOUBLE) / (count(*) * 100) AS price,
         CAST(sum(discount) AS DOUBLE) / (count(*) * 100) AS discount, CAST(sum(tax) AS DOUBLE) / (count(*) * 100) AS tax
  FROM raw_weeks GROUP BY GROUPING SETS ((t, flag), (t))
), long_metrics AS (
  SELECT t, flag, unnest(['rows', 'quantity', 'price', 'discount', 'tax']) AS metric, unnest([rows_count, quantity, price, discount, tax]) AS v FROM week_metrics
), grid AS (
  SELECT 'lineitem' AS run_id, metric || CASE WHEN flag IS NULL THEN '' ELSE '[' || flag || ']' END AS sensor,
         CAST(t // 120 AS INTEGER) AS episode, t,
         CASE WHEN metric = 'tax' AND t % 37 = 5 THEN NULL ELSE v END AS v
  FROM long_metrics
)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run_id, sensor, episode, t, v``; a missing value is null."""
    cents = {c: F.round(F.col(f"l_{n}") * 100).cast("long").alias(c) for c, n in (("quantity", "quantity"), ("price", "extendedprice"), ("discount", "discount"), ("tax", "tax"))}
    raw = table(spark, sf_dir, "lineitem").select(F.expr("cast(datediff(l_shipdate, DATE'1994-01-01') div 7 as bigint)").alias("t"), F.col("l_returnflag").alias("flag"), *cents.values())
    # sums of whole cents don't depend on the order in which partitions add up
    metrics = raw.groupingSets([["t", "flag"], ["t"]], "t", "flag").agg(F.count("*").cast("double").alias("rows"), *[(F.sum(c).cast("double") / (F.count("*") * 100)).alias(c) for c in cents])
    long = metrics.unpivot(["t", "flag"], ["rows", "quantity", "price", "discount", "tax"], "metric", "raw")
    return long.select(
        F.lit("lineitem").alias("run_id"),
        F.concat("metric", F.when(F.col("flag").isNull(), "").otherwise(F.concat(F.lit("["), "flag", F.lit("]")))).alias("sensor"),
        F.expr(f"cast(t div {WEEKS_OF_EPISODE} as int)").alias("episode"),
        "t",
        F.when((F.col("metric") == "tax") & (F.col("t") % 37 == 5), None).otherwise(F.col("raw")).alias("v"),
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A harness table; its times, stored without a zone, are read in the session's, which is UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"})


def with_grid(body: str) -> str:
    """SQL over ``grid``: more CTEs and a select."""
    return f"WITH {GRID}{body}"
