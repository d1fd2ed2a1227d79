"""Outlets and sales over the test tables of orders: the same expressions for Spark and, as text, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encode as E
from ..operators.rollup import money

#: Attributes of an outlet by its key; the texts are SQL that Spark and DuckDB read alike.
ATTRIBUTES = {
    "Top City": "CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'Metro' WHEN c_custkey % 3 = 1 THEN 'Town' ELSE 'Village' END",
    "store_format": "CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN ' mt ' WHEN c_custkey % 4 = 1 THEN 'Others' ELSE 'GT' END",
    "sector": "CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'Urban' ELSE 'Rural' END",
    "BI": "CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'Yes' ELSE 'no ' END",
    "cooler_available": "CASE WHEN c_custkey % 7 = 0 THEN 'maybe' WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'No' END",
    "estmtd_daily_footfall_tag": "CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'Low (<30)' WHEN c_custkey % 5 = 1 THEN ' medium' WHEN c_custkey % 5 = 2 THEN 'HIGH' ELSE 'unknown' END",
    "store_size_bracket": "CASE WHEN c_custkey % 6 = 0 THEN '<200 sqft' WHEN c_custkey % 6 = 1 THEN 'Small Outlet' WHEN c_custkey % 6 = 2 THEN '600–1000 sqft' WHEN c_custkey % 6 = 3 THEN '>1000 sqft' END",
    "chocolates_lead_pack": "CASE WHEN c_custkey % 4 = 0 THEN 'Rs. 5' WHEN c_custkey % 4 = 1 THEN 'rs. 20' WHEN c_custkey % 4 = 2 THEN 'Rs. 99' END",
    "urban_vs_periphery_tagging": "CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 4 < 2 THEN 'URBAN' ELSE 'Periphery' END",
    "raw_number": "CASE WHEN c_custkey % 10 = 0 THEN '0x2a' WHEN c_custkey % 10 = 1 THEN '0xZZ' WHEN c_custkey % 10 = 2 THEN '1d' WHEN c_custkey % 10 = 3 THEN ' 12.5 ' WHEN c_custkey % 10 = 4 THEN NULL WHEN c_custkey % 10 = 5 THEN '-3e2' WHEN c_custkey % 10 = 6 THEN '' ELSE '7' END",
}
SALES_COLUMNS = {
    "CUST_UNIQ_ID_VAL": "CAST(o_custkey AS STRING)",
    "BRND_NM": "CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE p_brand END",
    "SUB_BRND_NM": "p_type",
    "FLVR_NM": "p_name",
    "PPG_DESC": "CASE WHEN p_size <= 12 THEN 'Small' WHEN p_size <= 25 THEN 'Medium' WHEN p_size <= 38 THEN 'Large' ELSE 'Extra Large' END",
    "NET_SALES": "CASE WHEN l_orderkey % 211 = 0 THEN NULL ELSE l_extendedprice * (1 - l_discount) END",
    "order_month": "date_trunc('month', o_orderdate)",
}


def _columns(of: dict[str, str], quote: str) -> str:
    return ", ".join(f"{e} AS {quote}{c}{quote}" for c, e in of.items())


SALES_SQL = f"sales AS (SELECT {_columns(SALES_COLUMNS, chr(34))} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"
REVENUE_SQL = """revenue AS (SELECT CUST_UNIQ_ID_VAL AS id, CAST(coalesce(sum(CAST(NET_SALES AS DECIMAL(18,4))), 0) AS DOUBLE) AS total, count(*) AS n, count(DISTINCT order_month) AS months FROM sales GROUP BY 1)"""
OUTLETS_SQL = f"""outlets AS (SELECT CAST(c_custkey AS STRING) AS OUTLET_UID_EDITED, n_name AS "DB State", r_name AS COHORT, c_mktsegment AS channel, c_acctbal AS income, {_columns(ATTRIBUTES, chr(34))},
 total AS TOTAL_REVENUE, n AS AVG_SKU, months AS ACTIVE_MONTHS, round_even(total / months, 2) AS VPO
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN revenue ON id = CAST(c_custkey AS STRING))"""
WITH = f"WITH {SALES_SQL}, {REVENUE_SQL}, {OUTLETS_SQL}"
RANKED_SQL = """ranked AS (SELECT *, (max_rank - (ties - 1) / 2) / n_all * 100 AS p FROM (SELECT *, count(*) OVER (ORDER BY coalesce(VPO, 0)) AS max_rank, count(*) OVER (PARTITION BY coalesce(VPO, 0)) AS ties, count(*) OVER () AS n_all FROM outlets)),
 tiers AS (SELECT *, round_even(p, 2) AS vpo_percentile, CASE WHEN p > 80 THEN 'A' WHEN p > 60 THEN 'B' WHEN p > 30 THEN 'C' ELSE 'D' END AS priority_bucket FROM ranked)"""
#: A stand-in for a fitted potential, so that what is computed from it can be held against the oracle.
POTENTIAL = "coalesce(VPO, 0) * (0.8137e0 + (CAST(OUTLET_UID_EDITED AS BIGINT) % 7) * 0.107311e0)"
SCORED_SQL = f"""scored AS (SELECT *, CASE WHEN opportunity_gap > 0 THEN priority_bucket || '+' ELSE priority_bucket END AS priority, opportunity_gap > 0 AS has_upside,
 round_even(opportunity_gap / nullif(predicted_potential_vpo, 0) * 100, 1) AS gap_pct_of_potential, CAST(CAST(OUTLET_UID_EDITED AS BIGINT) % 6 AS INT) AS cluster,
 CASE WHEN CAST(OUTLET_UID_EDITED AS BIGINT) % 6 = 5 THEN 'Segment 5' ELSE 'Label ' || CAST(CAST(OUTLET_UID_EDITED AS BIGINT) % 6 AS STRING) END AS segment_label
 FROM (SELECT *, round_even({POTENTIAL} - coalesce(VPO, 0), 2) AS opportunity_gap, round_even({POTENTIAL}, 2) AS predicted_potential_vpo FROM tiers))"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey")).join(read(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
    return rows.select(*[F.expr(e).alias(c) for c, e in SALES_COLUMNS.items()])


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlets without their revenue."""
    places = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    rows = read(spark, sf_dir, "customer").join(places, F.expr("c_nationkey = n_nationkey"))
    return rows.select(F.col("c_custkey").cast("string").alias("OUTLET_UID_EDITED"), F.col("n_name").alias("DB State"), F.col("r_name").alias("COHORT"), F.col("c_mktsegment").alias("channel"), F.col("c_acctbal").alias("income"), *[F.expr(e).alias(c) for c, e in ATTRIBUTES.items()])


def outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sales(spark, sf_dir).groupBy(F.col("CUST_UNIQ_ID_VAL").alias("id")).agg(F.coalesce(F.sum(money(F.col("NET_SALES"))).cast("double"), F.lit(0.0)).alias("TOTAL_REVENUE"), F.count("*").alias("AVG_SKU"), F.count_distinct("order_month").alias("ACTIVE_MONTHS"))
    own = own.withColumn("VPO", E.rounded(F.col("TOTAL_REVENUE") / F.col("ACTIVE_MONTHS"), 2))
    return master(spark, sf_dir).join(own, F.expr("OUTLET_UID_EDITED = id"), "left").drop("id")
