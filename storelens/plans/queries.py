"""The registered queries over the test tables, each with the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import encode as E
from ..functions import textops
from ..operators import assortment, mustlist, potential, priority, quality, ranking, rfm, rollup, segments, sketches, skustats, space, strategy
from ..sources import files, sinks
from ..streaming import commits
from ..streaming.inbox import inbox
from . import adapter as A
from . import batch
from .lineage import cut, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEY = "CAST(OUTLET_UID_EDITED AS BIGINT)"
FEATURES = ["income", "AVG_SKU", "ACTIVE_MONTHS", "estmtd_daily_footfall_numeric", "cooler_available_bin", "BI_bin", "is_modern_trade", "is_urban"]


def query(sql: str | None = None, name: str | None = None):  # noqa: ANN201
    def add(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql.strip()
        return f

    return add


def tiers(spark: SparkSession, d: str) -> DataFrame:
    return cut(priority.prioritised(A.outlets(spark, d)), "tiers")


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Outlets with tiers, a stand-in potential, gaps, and a stand-in segment."""
    out = priority.gaps(tiers(spark, d).withColumn("predicted_raw", F.expr(A.POTENTIAL)))
    out = out.withColumn("cluster", F.expr(f"CAST({KEY} % 6 AS INT)"))
    return segments.attach_labels(out, labels(spark))


def labels(spark: SparkSession) -> DataFrame:
    """Labels of five of the six clusters."""
    return spark.range(5).selectExpr("CAST(id AS INT) AS cluster", "concat('Label ', id) AS label", "if(id % 2 = 0, 'GT', 'MT') AS channel", "'Stock-up' AS occasion", "'' AS description", "concat('Action ', id) AS action")


WITH_TIERS = f"{A.WITH}, {A.RANKED_SQL}"
WITH_SCORED = f"{WITH_TIERS}, {A.SCORED_SQL}"
LISTED_SQL = """joined AS (SELECT s.*, t.priority_bucket AS bucket FROM sales s JOIN tiers t ON trim(s.CUST_UNIQ_ID_VAL) = t.OUTLET_UID_EDITED),
 stores AS (SELECT priority_bucket AS bucket, count(DISTINCT OUTLET_UID_EDITED) AS n_stores FROM tiers GROUP BY 1),
 own AS (SELECT bucket, BRND_NM, SUB_BRND_NM, FLVR_NM, PPG_DESC, coalesce(sum(CAST(NET_SALES AS DECIMAL(18,4))), 0) AS sales, count(DISTINCT CUST_UNIQ_ID_VAL) AS stores FROM joined
  WHERE BRND_NM IS NOT NULL AND SUB_BRND_NM IS NOT NULL AND FLVR_NM IS NOT NULL AND PPG_DESC IS NOT NULL GROUP BY ALL),
 overall AS (SELECT BRND_NM, SUB_BRND_NM, FLVR_NM, PPG_DESC, sum(sales) AS sales_all FROM own GROUP BY ALL),
 listed0 AS (SELECT o.*, CAST(o.sales AS DOUBLE) / nullif(CAST(sum(o.sales) OVER (PARTITION BY bucket) AS DOUBLE), 0) AS share, CAST(sales_all AS DOUBLE) / nullif((SELECT CAST(sum(sales) AS DOUBLE) FROM own), 0) AS share_all,
  o.stores * 1.0::DOUBLE / n_stores AS penetration, row_number() OVER (PARTITION BY bucket ORDER BY o.sales DESC, BRND_NM, SUB_BRND_NM, FLVR_NM, PPG_DESC) AS rank,
  CAST(sum(o.sales) OVER (PARTITION BY bucket ORDER BY o.sales DESC, BRND_NM, SUB_BRND_NM, FLVR_NM, PPG_DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) / nullif(CAST(sum(o.sales) OVER (PARTITION BY bucket) AS DOUBLE), 0) AS cumulative
  FROM own o JOIN overall USING (BRND_NM, SUB_BRND_NM, FLVR_NM, PPG_DESC) JOIN stores USING (bucket)),
 listed AS (SELECT *, share / nullif(share_all, 0) * 100 AS "index", BRND_NM || ' ' || SUB_BRND_NM || ' ' || FLVR_NM || ' (' || PPG_DESC || ')' AS product FROM listed0)"""
WITH_LISTED = f"{WITH_TIERS}, {LISTED_SQL}"


def joined(spark: SparkSession, d: str) -> DataFrame:
    return assortment.joined(A.sales(spark, d), tiers(spark, d))


def listed(spark: SparkSession, d: str) -> DataFrame:
    t = tiers(spark, d)
    return cut(assortment.products(assortment.joined(A.sales(spark, d), t), assortment.bucket_stores(t)), "listed")


PRODUCT_SQL = "BRND_NM, SUB_BRND_NM, FLVR_NM, PPG_DESC"


# Scans and sources


@query(f"{A.WITH} SELECT OUTLET_UID_EDITED, \"Top City\" AS city, VPO FROM outlets")
def scan_csv_outlets(spark: SparkSession, d: str) -> DataFrame:
    """The outlets written as CSV and read back through the source."""
    path = folder(spark, "csv")
    A.outlets(spark, d).select("OUTLET_UID_EDITED", F.col("Top City").alias(" city "), "VPO").write.mode("overwrite").option("header", True).csv(path)
    return files.outlets(spark, path).select("OUTLET_UID_EDITED", "city", F.col("VPO").cast("double").alias("VPO"))


@query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_mktsegment FROM customer")
def strip_headers(spark: SparkSession, d: str) -> DataFrame:
    return files.strip_headers(A.read(spark, d, "customer").select(F.col("c_custkey").alias(" c_custkey"), F.col("c_mktsegment").alias("c_mktsegment ")))


WORDS = "CASE WHEN c_custkey % 5 = 0 THEN 'null' WHEN c_custkey % 5 = 1 THEN 'Null' WHEN c_custkey % 5 = 2 THEN 'N/A' WHEN c_custkey % 5 = 3 THEN '' ELSE c_name END"


@query(f"SELECT c_custkey, CASE WHEN w IN ('null', 'N/A', '') THEN NULL ELSE w END AS word FROM (SELECT CAST(c_custkey AS BIGINT) AS c_custkey, {WORDS} AS w FROM customer)")
def null_tokens(spark: SparkSession, d: str) -> DataFrame:
    return files.null_tokens(A.read(spark, d, "customer").select("c_custkey", F.expr(WORDS).alias("word")))


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS i, count(*) OVER () AS n FROM orders) WHERE i % greatest(1, n // 700) = 0")
def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    return files.systematic_sample(A.read(spark, d, "orders").select("o_orderkey", "o_totalprice"), 700, "o_orderkey")


@query(f"WITH {A.SALES_SQL} SELECT trim(CUST_UNIQ_ID_VAL) AS id, count(*) AS n, round_even(CAST(sum(CAST(NET_SALES AS DECIMAL(18,4))) AS DOUBLE), 2) AS total FROM sales GROUP BY 1")
def scan_sku_sales(spark: SparkSession, d: str) -> DataFrame:
    rows = A.sales(spark, d).withColumn("id", F.trim("CUST_UNIQ_ID_VAL"))
    return rows.groupBy("id").agg(F.count("*").alias("n"), F.bround(F.sum(rollup.money(F.col("NET_SALES"))).cast("double"), 2).alias("total"))


PACK_SQL = """SELECT p_partkey AS row_no, CASE WHEN p_partkey % 3 = 1 THEN p_brand ELSE '' END AS brand, CASE WHEN p_partkey % 2 = 0 THEN 'large (Party Pack)' WHEN p_partkey % 5 = 0 THEN 'insti mids' ELSE 'Extra Large' END AS ppg_raw,
 CASE WHEN p_partkey % 50 = 0 THEN 'height' ELSE CAST(p_size % 30 + 10 AS STRING) END AS height_cm, CAST(p_size % 20 + 5 AS STRING) AS width_cm, CAST(p_size % 7 + 3 AS STRING) AS depth_cm FROM part"""


@query(f"""WITH raw AS ({PACK_SQL}), filled AS (SELECT *, last_value(nullif(brand, '') IGNORE NULLS) OVER (ORDER BY row_no) AS b FROM raw),
 ok AS (SELECT *, upper(b[1]) || lower(b[2:]) AS brand_norm, CASE WHEN ppg_raw LIKE 'large%' THEN 'Large' WHEN ppg_raw = 'insti mids' THEN 'Medium' ELSE 'Extra Large' END AS ppg_norm FROM filled WHERE height_cm <> 'height')
 SELECT brand_norm, ppg_norm, CAST(height_cm AS DOUBLE) * 10 AS height_mm, CAST(width_cm AS DOUBLE) * 10 AS width_mm, CAST(depth_cm AS DOUBLE) * 10 AS depth_mm FROM ok QUALIFY row_number() OVER (PARTITION BY brand_norm, ppg_norm ORDER BY row_no) = 1""")
def scan_pack_dims(spark: SparkSession, d: str) -> DataFrame:
    A.read(spark, d, "part").createOrReplaceTempView("part")
    return space.pack_dims(spark.sql(PACK_SQL)).select("brand_norm", "ppg_norm", "height_mm", "width_mm", "depth_mm")


# Roll-up and enrichment


@query(f"WITH {A.SALES_SQL} SELECT trim(CUST_UNIQ_ID_VAL) AS OUTLET_UID_EDITED, round_even(CAST(coalesce(sum(CAST(NET_SALES AS DECIMAL(18,4))), 0) AS DOUBLE), 2) AS VPO, round_even(CAST(coalesce(sum(CAST(NET_SALES AS DECIMAL(18,4))), 0) AS DOUBLE), 2) AS TOTAL_REVENUE, count(*) AS AVG_SKU, CAST(1 AS BIGINT) AS ACTIVE_MONTHS FROM sales GROUP BY 1")
def outlet_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rollup.outlet_rollup(A.sales(spark, d))


@query(f"WITH {A.SALES_SQL} SELECT upper(trim(BRND_NM)) || ' ' || upper(trim(PPG_DESC)) AS key, count(*) AS n FROM sales GROUP BY 1")
def brand_pack_key(spark: SparkSession, d: str) -> DataFrame:
    return A.sales(spark, d).groupBy(E.brand_pack(F.col("BRND_NM"), F.col("PPG_DESC")).alias("key")).agg(F.count("*").alias("n"))


PIVOT_KEYS = ["BRAND#11 SMALL", "BRAND#22 LARGE", "BRAND#33 MEDIUM"]
PIVOT_SQL = f"WITH {A.SALES_SQL} SELECT trim(CUST_UNIQ_ID_VAL) AS OUTLET_UID_EDITED, " + ", ".join(f"coalesce(CAST(sum(CAST(NET_SALES AS DECIMAL(18,4))) FILTER (WHERE upper(trim(BRND_NM)) || ' ' || upper(trim(PPG_DESC)) = '{k}') AS DOUBLE), 0) AS \"{k}\"" for k in PIVOT_KEYS) + " FROM sales WHERE BRND_NM IS NOT NULL AND PPG_DESC IS NOT NULL GROUP BY 1"


@query(PIVOT_SQL)
def brand_pack_pivot(spark: SparkSession, d: str) -> DataFrame:
    return rollup.brand_pack_pivot(A.sales(spark, d), PIVOT_KEYS)


@query(f"WITH {A.SALES_SQL} SELECT trim(CUST_UNIQ_ID_VAL) AS OUTLET_UID_EDITED, upper(trim(BRND_NM)) || ' ' || upper(trim(PPG_DESC)) AS key, CAST(coalesce(sum(CAST(NET_SALES AS DECIMAL(18,4))), 0) AS DOUBLE) AS sales FROM sales WHERE BRND_NM IS NOT NULL AND PPG_DESC IS NOT NULL GROUP BY ALL")
def brand_pack_sparse(spark: SparkSession, d: str) -> DataFrame:
    """All keys that the data have; a row for each entry of the stores' maps."""
    return rollup.brand_pack_sparse(A.sales(spark, d)).select("OUTLET_UID_EDITED", F.explode("by_key").alias("key", "sales"))


@query(f"SELECT c_custkey::STRING AS OUTLET_UID_EDITED, \"{PIVOT_KEYS[0]}\" AS sales FROM customer LEFT JOIN ({PIVOT_SQL}) ON c_custkey::STRING = OUTLET_UID_EDITED")
def pivot_left_join(spark: SparkSession, d: str) -> DataFrame:
    out = rollup.with_pivot(A.master(spark, d).select("OUTLET_UID_EDITED"), rollup.brand_pack_pivot(A.sales(spark, d), PIVOT_KEYS[:1]))
    return out.select("OUTLET_UID_EDITED", F.col(f"`{PIVOT_KEYS[0]}`").alias("sales"))


@query("SELECT o_custkey::STRING AS OUTLET_UID_EDITED, o_orderstatus AS status, o_totalprice AS price FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def master_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = A.read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("OUTLET_UID_EDITED"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), "o_orderkey")
    return rollup.dedupe_master(rows, ["status", "price", "absent"], "o_orderkey")


MASTER_SQL = f"""{A.WITH}, base AS (SELECT trim(CUST_UNIQ_ID_VAL) AS OUTLET_UID_EDITED, round_even(CAST(coalesce(sum(CAST(NET_SALES AS DECIMAL(18,4))), 0) AS DOUBLE), 2) AS v FROM sales GROUP BY 1),
 mast AS (SELECT OUTLET_UID_EDITED, channel, CASE WHEN {KEY} % 2 = 0 THEN VPO END AS m FROM outlets WHERE {KEY} % 5 <> 0)"""


def enriched(spark: SparkSession, d: str) -> DataFrame:
    own = rollup.outlet_rollup(A.sales(spark, d)).select("OUTLET_UID_EDITED", "VPO")
    mast = A.outlets(spark, d).where(f"{KEY} % 5 <> 0").select("OUTLET_UID_EDITED", "channel", F.expr(f"CASE WHEN {KEY} % 2 = 0 THEN VPO END").alias("VPO"))
    return rollup.enrich(own, mast)


@query(f"{MASTER_SQL} SELECT OUTLET_UID_EDITED, v AS VPO, channel, m AS VPO_mmf FROM base LEFT JOIN mast USING (OUTLET_UID_EDITED)")
def master_enrich(spark: SparkSession, d: str) -> DataFrame:
    return enriched(spark, d)


@query(f"{MASTER_SQL} SELECT OUTLET_UID_EDITED, coalesce(m, v) AS VPO, channel FROM base LEFT JOIN mast USING (OUTLET_UID_EDITED)")
def prefer_master(spark: SparkSession, d: str) -> DataFrame:
    return rollup.prefer_master(enriched(spark, d))


@query(f"{MASTER_SQL} SELECT OUTLET_UID_EDITED, coalesce(channel, 'GT') AS channel, 'Urban' AS sector, 'Unknown' AS \"Top City\" FROM base LEFT JOIN mast USING (OUTLET_UID_EDITED)")
def fill_defaults(spark: SparkSession, d: str) -> DataFrame:
    return rollup.fill_defaults(enriched(spark, d)).select("OUTLET_UID_EDITED", "channel", "sector", "Top City")


@query("SELECT 'sales' AS name, true AS is_sku UNION ALL SELECT 'outlets', false")
def is_sku_transactional(spark: SparkSession, d: str) -> DataFrame:
    tables = {"sales": A.sales(spark, d), "outlets": A.outlets(spark, d)}
    out = None
    for name, df in tables.items():
        row = df.limit(1).select(F.lit(name).alias("name"), F.lit(rollup.is_sku_table(df)).alias("is_sku"))
        out = row if out is None else out.union(row)
    return out


# Recency, frequency, monetary value

ORDER_ROLLUP = ("o_custkey", "o_orderdate", "o_totalprice")
RFM_SQL = """WITH r AS (SELECT CAST(o_custkey AS STRING) AS id, min(CAST(o_orderdate AS DATE)) AS first_date, max(CAST(o_orderdate AS DATE)) AS last_date, count(*) AS frequency, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS monetary FROM orders GROUP BY 1)"""


@query(f"{RFM_SQL} SELECT * FROM r")
def rfm_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rfm.rolled_up(A.read(spark, d, "orders"), *ORDER_ROLLUP).withColumn("monetary", F.col("monetary").cast("double"))


def rfm_state(spark: SparkSession, d: str) -> DataFrame:
    """Orders year by year, each a batch; one batch is given twice, and the state is compacted on the way."""
    path, orders = folder(spark, "rfm"), A.read(spark, d, "orders")
    span = orders.agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b")).first()
    for year in range(span.a, span.b + 1):
        batch = orders.where(F.year("o_orderdate") == year)
        rfm.append(batch, path, str(year), *ORDER_ROLLUP)
        if year == span.a + 1:
            rfm.compact(spark, path)
            rfm.append(batch, path, str(year), *ORDER_ROLLUP)
    return rfm.current(spark, path)


@query(f"{RFM_SQL} SELECT * FROM r")
def rfm_incremental(spark: SparkSession, d: str) -> DataFrame:
    return rfm_state(spark, d).withColumn("monetary", F.col("monetary").cast("double"))


@query(f"""{RFM_SQL}, s AS (SELECT id, datediff('day', last_date, (SELECT max(last_date) FROM r)) AS recency, frequency, monetary FROM r)
 SELECT id, CAST(recency AS INT) AS recency, frequency, monetary, {", ".join(f"CAST(floor((rank() OVER (ORDER BY {c} {o}) - 1) * 5.0::DOUBLE / count(*) OVER ()) AS INT) + 1 AS {n}" for n, c, o in (("r", "recency", "DESC"), ("f", "frequency", ""), ("m", "monetary", "")))} FROM s""")
def rfm_scores(spark: SparkSession, d: str) -> DataFrame:
    """As of the last day on which anything was sold."""
    state = cut(rfm_state(spark, d), "rfm")
    last = state.agg(F.max("last_date").alias("d")).first().d
    return rfm.scored(state, F.lit(last)).withColumn("monetary", F.col("monetary").cast("double"))


# Data quality

REQUIRED = ["OUTLET_UID_EDITED", "VPO", "latitude", "channel"]


@query("SELECT 'required_columns' AS \"check\", false AS pass, 'latitude' AS missing")
def dq_required_columns(spark: SparkSession, d: str) -> DataFrame:
    return quality.missing_columns(A.outlets(spark, d), REQUIRED)


NULL_COLUMNS = ["Top City", "store_format", "sector", "BI", "store_size_bracket", "chocolates_lead_pack", "VPO"]
NULLS_SQL = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round_even(count(*) FILTER (WHERE \"{c}\" IS NULL) * 100.0::DOUBLE / count(*), 1) AS null_pct FROM outlets" for c in NULL_COLUMNS)


@query(f"{A.WITH} SELECT *, null_pct > 30.0 AS flagged FROM ({NULLS_SQL})")
def dq_null_pct(spark: SparkSession, d: str) -> DataFrame:
    return quality.null_percent(A.outlets(spark, d).select(*[f"`{c}`" for c in NULL_COLUMNS]), 30.0)


@query("SELECT count(*) - count(DISTINCT CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END) AS duplicates, false AS pass FROM orders")
def dq_duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_ids(A.read(spark, d, "orders").select(F.expr("CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END").alias("OUTLET_UID_EDITED")))


@query("SELECT count(*) - count(DISTINCT CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END) AS duplicates, true AS within FROM orders")
def dq_duplicate_ids_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Exact duplicates, and whether those by sketch differ by no more than the stated error."""
    rows = A.read(spark, d, "orders").select(F.expr("CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END").alias("OUTLET_UID_EDITED"))
    exact, near = quality.duplicate_ids(rows).select("duplicates"), sketches.duplicate_ids(rows)
    return exact.join(F.broadcast(near)).select("duplicates", (F.abs(F.col("duplicates") - F.col("near")) <= F.ceil("error")).alias("within"))  # one row each


@query("SELECT count(*) FILTER (WHERE v > m * 2) AS outliers, round_even(count(*) FILTER (WHERE v > m * 2) * 100.0::DOUBLE / count(*), 2) AS pct, round_even(count(*) FILTER (WHERE v > m * 2) * 100.0::DOUBLE / count(*), 2) < 1.0 AS pass FROM (SELECT o_totalprice AS v, CAST(avg(CAST(o_totalprice AS DECIMAL(18,4))) OVER () AS DOUBLE) AS m FROM orders)")
def dq_vpo_outliers(spark: SparkSession, d: str) -> DataFrame:
    return quality.outliers(A.read(spark, d, "orders").select(F.col("o_totalprice").alias("VPO")), "VPO", 2.0)


@query("SELECT 'c_acctbal' AS \"column\", count(*) FILTER (WHERE c_acctbal < 0) AS negatives FROM customer")
def dq_negative_sku(spark: SparkSession, d: str) -> DataFrame:
    return quality.negatives(A.read(spark, d, "customer"), ["ACCT"])


@query(f"{A.WITH} SELECT count(*) FILTER (WHERE coalesce(VPO, 0) = 0) AS zeros, round_even(count(*) FILTER (WHERE coalesce(VPO, 0) = 0) * 100.0::DOUBLE / count(*), 2) AS pct, round_even(count(*) FILTER (WHERE coalesce(VPO, 0) = 0) * 100.0::DOUBLE / count(*), 2) < 5.0 AS pass FROM outlets")
def dq_zero_vpo(spark: SparkSession, d: str) -> DataFrame:
    return quality.zero_share(A.outlets(spark, d))


COVER_SQL = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", \"{c}\" AS value, count(*) AS n FROM outlets WHERE \"{c}\" IS NOT NULL GROUP BY ALL" for c in C.COVERAGE_COLUMNS)


@query(f"{A.WITH} SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS place FROM ({COVER_SQL}) QUALIFY place <= 5")
def dq_coverage(spark: SparkSession, d: str) -> DataFrame:
    return quality.coverage(A.outlets(spark, d))


REPORT_SQL = f"""{A.WITH} SELECT * FROM (VALUES (0, 'required_columns', false), (1, 'null_pct', true), (2, 'duplicate_ids', true)) v(position, "check", pass)
 UNION ALL SELECT 3, 'vpo_outliers', round_even(count(*) FILTER (WHERE VPO > m * 10) * 100.0::DOUBLE / count(*), 2) < 1.0 FROM (SELECT VPO, CAST(avg(CAST(VPO AS DECIMAL(18,4))) OVER () AS DOUBLE) AS m FROM outlets)
 UNION ALL SELECT 4, 'negative_sku', true UNION ALL SELECT 5, 'zero_vpo', round_even(count(*) FILTER (WHERE coalesce(VPO, 0) = 0) * 100.0::DOUBLE / count(*), 2) < 5.0 FROM outlets UNION ALL SELECT 6, 'coverage', true"""


@query(REPORT_SQL)
def dq_report(spark: SparkSession, d: str) -> DataFrame:
    return quality.report(cut(A.outlets(spark, d), "outlets"), REQUIRED)


@query(f"SELECT bool_and(pass) AS passed, string_agg('- ' || \"check\" || ': ' || CASE WHEN pass THEN 'PASS' ELSE 'FAIL' END, chr(10) ORDER BY position) AS text FROM ({REPORT_SQL})")
def dq_verdict(spark: SparkSession, d: str) -> DataFrame:
    return quality.verdict(quality.report(cut(A.outlets(spark, d), "outlets"), REQUIRED))


@query(f"{A.WITH} SELECT count(*) AS n_rows, CAST(19 AS BIGINT) AS n_columns, 'OUTLET_UID_EDITED, VPO' AS key_columns FROM outlets")
def table_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality.summary(A.outlets(spark, d), ["OUTLET_UID_EDITED", "VPO", "latitude"])


# Prioritisation


@query(f"{WITH_TIERS} SELECT OUTLET_UID_EDITED, vpo_percentile FROM tiers")
def vpo_percentile(spark: SparkSession, d: str) -> DataFrame:
    return tiers(spark, d).select("OUTLET_UID_EDITED", "vpo_percentile")


@query(f"{WITH_TIERS} SELECT OUTLET_UID_EDITED, priority_bucket FROM tiers")
def abcd_bucket(spark: SparkSession, d: str) -> DataFrame:
    return tiers(spark, d).select("OUTLET_UID_EDITED", "priority_bucket")


@query(f"{WITH_TIERS} SELECT priority_bucket, count(*) AS n, round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS pct FROM tiers GROUP BY 1")
def bucket_distribution(spark: SparkSession, d: str) -> DataFrame:
    return priority.shares(tiers(spark, d), "priority_bucket")


def simple(name: str, column: str, f: Callable, sql: str) -> None:
    """A query that encodes one column of the outlets."""
    query(f"{A.WITH} SELECT OUTLET_UID_EDITED, {sql} AS code FROM outlets", name)(lambda spark, d: A.outlets(spark, d).select("OUTLET_UID_EDITED", f(F.col(f"`{column}`")).alias("code")))


simple("encode_footfall", "estmtd_daily_footfall_tag", E.footfall, "CASE lower(trim(estmtd_daily_footfall_tag)) WHEN 'low (<30)' THEN 15.0 WHEN 'low' THEN 15.0 WHEN 'medium' THEN 65.0 WHEN 'high' THEN 150.0 END::DOUBLE")
simple("encode_yes_no", "cooler_available", E.yes_no, "CASE lower(trim(cooler_available)) WHEN 'yes' THEN 1.0 WHEN 'no' THEN 0.0 END::DOUBLE")
simple("encode_yes_no_9", "BI", E.yes_no, "CASE lower(trim(BI)) WHEN 'yes' THEN 1.0 WHEN 'no' THEN 0.0 END::DOUBLE")
simple("flag_modern_trade", "store_format", lambda c: E.flag(c, "MT"), "CASE WHEN lower(trim(store_format)) = 'mt' THEN 1.0 ELSE 0.0 END::DOUBLE")
simple("flag_urban", "sector", lambda c: E.flag(c, "urban"), "CASE WHEN lower(trim(sector)) = 'urban' THEN 1.0 ELSE 0.0 END::DOUBLE")
simple("flags_format_sector", "urban_vs_periphery_tagging", lambda c: E.flag(c, "urban"), "CASE WHEN lower(trim(urban_vs_periphery_tagging)) = 'urban' THEN 1.0 ELSE 0.0 END::DOUBLE")
simple("encode_store_size", "store_size_bracket", E.store_size, "CASE lower(trim(store_size_bracket)) WHEN '<200 sqft' THEN 1.0 WHEN 'small outlet' THEN 2.0 WHEN '>1000 sqft' THEN 5.0 END::DOUBLE")
simple("encode_price_pack", "chocolates_lead_pack", E.price_pack, "CASE lower(chocolates_lead_pack) WHEN 'rs. 5' THEN 5.0 WHEN 'rs. 20' THEN 20.0 END::DOUBLE")
simple("clip_negative", "income", E.clip_negative, "CASE WHEN income < 0 THEN 0.0 ELSE income END::DOUBLE")
simple("coerce_numeric", "raw_number", E.numeric, "CASE raw_number WHEN '0x2a' THEN 42.0 WHEN ' 12.5 ' THEN 12.5 WHEN '-3e2' THEN -300.0 WHEN '7' THEN 7.0 END::DOUBLE")
simple("safe_segment_name", "store_size_bracket", E.safe_name, "substr(regexp_replace(store_size_bracket, '[^\\p{L}\\p{N} _-]', '_', 'g'), 1, 50)")


@query(f"{WITH_TIERS} SELECT OUTLET_UID_EDITED, CASE priority_bucket WHEN 'A' THEN 4.0 WHEN 'B' THEN 3.0 WHEN 'C' THEN 2.0 ELSE 1.0 END::DOUBLE AS code FROM tiers")
def encode_bucket(spark: SparkSession, d: str) -> DataFrame:
    return tiers(spark, d).select("OUTLET_UID_EDITED", E.bucket_code(F.col("priority_bucket")).alias("code"))


CANDIDATES = ["income", "AVG_SKU", "Top City", "chocolates_lead_pack", "store_size_bracket", "absent"]
FILLED_SQL = " UNION ALL ".join(f"SELECT '{c}' AS feature, count(\"{c}\") * 1.0::DOUBLE / count(*) AS f FROM outlets" for c in CANDIDATES[:-1])


@query(f"{A.WITH} SELECT feature, round_even(f, 6) AS filled, f >= 0.7 AS kept FROM ({FILLED_SQL})")
def select_features(spark: SparkSession, d: str) -> DataFrame:
    return priority.coverage(A.outlets(spark, d), CANDIDATES, 0.7).withColumn("filled", F.bround("filled", 6))


@query(f"{A.WITH} SELECT feature, round_even(f, 6) AS filled, f >= 0.1 AS kept FROM ({FILLED_SQL})")
def feature_coverage(spark: SparkSession, d: str) -> DataFrame:
    return priority.coverage(A.outlets(spark, d), [*CANDIDATES, "income"]).withColumn("filled", F.bround("filled", 6))


@query(f"{A.WITH} SELECT 'raw_number' AS \"column\", count(*) FILTER (WHERE raw_number IN ('0xZZ', '1d', '')) AS lost FROM outlets UNION ALL SELECT 'income', 0::BIGINT")
def coercion_audit(spark: SparkSession, d: str) -> DataFrame:
    return priority.coercion_audit(A.outlets(spark, d), ["raw_number", "income"])


NUMERIC_SQL = "numeric AS (SELECT *, CASE raw_number WHEN '0x2a' THEN 42.0 WHEN ' 12.5 ' THEN 12.5 WHEN '-3e2' THEN -300.0 WHEN '7' THEN 7.0 END::DOUBLE AS x FROM outlets)"


@query(f"{A.WITH}, {NUMERIC_SQL} SELECT OUTLET_UID_EDITED, coalesce(x, (SELECT median(x) FROM numeric)) AS raw_number FROM numeric")
def impute_median(spark: SparkSession, d: str) -> DataFrame:
    return priority.imputed(cut(priority.coerced(A.outlets(spark, d), ["raw_number"]), "coerced"), ["raw_number"]).select("OUTLET_UID_EDITED", "raw_number")


@query(f"{A.WITH}, {NUMERIC_SQL}, f AS (SELECT OUTLET_UID_EDITED, coalesce(x, (SELECT median(x) FROM numeric)) AS x FROM numeric) SELECT OUTLET_UID_EDITED, round_even((x - (SELECT avg(x) FROM f)) / (SELECT stddev_pop(x) FROM f), 6) AS z FROM f")
def standardize(spark: SparkSession, d: str) -> DataFrame:
    out, names = priority.standardised(cut(priority.coerced(A.outlets(spark, d), ["raw_number"]), "coerced"), ["raw_number"])
    return out.select("OUTLET_UID_EDITED", F.bround(names[0], 6).alias("z"))


def ready(spark: SparkSession, d: str) -> DataFrame:
    """Outlets with tiers and numeric features."""
    out = tiers(spark, d)
    return out.withColumns({
        "estmtd_daily_footfall_numeric": E.footfall(F.col("estmtd_daily_footfall_tag")), "cooler_available_bin": E.yes_no(F.col("cooler_available")), "BI_bin": E.yes_no(F.col("BI")),
        "is_modern_trade": E.flag(F.col("store_format"), "mt"), "is_urban": E.flag(F.col("sector"), "urban"), "bucket_num": E.bucket_code(F.col("priority_bucket")),
    })


MATRIX_SQL = f"""{WITH_TIERS}, x AS (SELECT OUTLET_UID_EDITED, income::DOUBLE AS income, AVG_SKU::DOUBLE AS AVG_SKU, ACTIVE_MONTHS::DOUBLE AS ACTIVE_MONTHS,
 CASE lower(trim(estmtd_daily_footfall_tag)) WHEN 'low (<30)' THEN 15.0 WHEN 'low' THEN 15.0 WHEN 'medium' THEN 65.0 WHEN 'high' THEN 150.0 END::DOUBLE AS estmtd_daily_footfall_numeric,
 CASE lower(trim(cooler_available)) WHEN 'yes' THEN 1.0 WHEN 'no' THEN 0.0 END::DOUBLE AS cooler_available_bin, CASE lower(trim(BI)) WHEN 'yes' THEN 1.0 WHEN 'no' THEN 0.0 END::DOUBLE AS BI_bin,
 CASE WHEN lower(trim(store_format)) = 'mt' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_modern_trade, CASE WHEN lower(trim(sector)) = 'urban' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_urban FROM tiers),
 f AS (SELECT OUTLET_UID_EDITED, {", ".join(f"coalesce({c}, (SELECT median({c}) FROM x)) AS {c}" for c in FEATURES)} FROM x)
 SELECT OUTLET_UID_EDITED, {", ".join(f"round_even(({c} - (SELECT avg({c}) FROM f)) / (SELECT stddev_pop({c}) FROM f), 4) AS z_{c}" for c in FEATURES)} FROM f"""


@query(MATRIX_SQL)
def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    out, names = priority.standardised(ready(spark, d), FEATURES)
    return out.select("OUTLET_UID_EDITED", *[F.bround(n, 4).alias(n) for n in names])


def modelled(spark: SparkSession, d: str, ols: bool = False) -> DataFrame:
    out, names = priority.standardised(cut(ready(spark, d), "ready"), FEATURES)
    out = out.withColumn("y", F.coalesce("VPO", F.lit(0.0)))
    beta = potential.least_squares_fit(out, "y", names) if ols else potential.quantile_fit(out, "y", names)
    return priority.gaps(potential.predicted(out, names, beta))


@query()
def quantile_regression(spark: SparkSession, d: str) -> DataFrame:
    return modelled(spark, d).select("OUTLET_UID_EDITED", "predicted_potential_vpo", "opportunity_gap", "priority")


@query(f"{A.WITH} SELECT count(*) AS n, true AS optimal, true AS quantile_kept FROM outlets")
def quantile_certificate(spark: SparkSession, d: str) -> DataFrame:
    """The fit's loss is within 0.0001 of the least that any line can have, and three quarters of outlets lie under it."""
    out, names = priority.standardised(cut(ready(spark, d), "ready"), FEATURES)
    out = cut(out.withColumn("y", F.coalesce("VPO", F.lit(0.0))), "featured")
    found = potential.certificate(out, "y", names, potential.quantile_fit(out, "y", names))
    good = found["gap"] <= 1e-4 * found["loss"], abs(found["under"] - C.QUANTILE) <= max(0.002, (len(names) + 1) / found["n"])
    return out.agg(F.count("*").alias("n")).select("n", F.lit(good[0]).alias("optimal"), F.lit(good[1]).alias("quantile_kept"))


def ols_sql() -> str:
    """Least squares by taking the features out of the target, and of one another, one by one."""
    out = MATRIX_SQL[: MATRIX_SQL.rindex(" SELECT OUTLET_UID_EDITED")] + ", y AS (SELECT f.*, coalesce(VPO, 0) AS y FROM f JOIN tiers USING (OUTLET_UID_EDITED))"
    out += f", g0 AS (SELECT OUTLET_UID_EDITED, y AS whole, y - avg(y) OVER () AS y, {', '.join(f'{c} - avg({c}) OVER () AS {c}' for c in FEATURES)} FROM y)"
    for k, c in enumerate(FEATURES):
        less = [f"{x} - sum({x} * {c}) OVER () / nullif(sum({c} * {c}) OVER (), 0) * {c} AS {x}" for x in ["y", *FEATURES[k + 1 :]]]
        out += f", g{k + 1} AS (SELECT OUTLET_UID_EDITED, whole, {', '.join(less)} FROM g{k})"
    return out + f" SELECT OUTLET_UID_EDITED, round_even(greatest(whole - y, 0), 2) AS predicted_potential_vpo FROM g{len(FEATURES)}"


@query(ols_sql())
def ols_fallback(spark: SparkSession, d: str) -> DataFrame:
    return modelled(spark, d, True).select("OUTLET_UID_EDITED", "predicted_potential_vpo")


@query()
def predict_potential(spark: SparkSession, d: str) -> DataFrame:
    return modelled(spark, d).select("OUTLET_UID_EDITED", "predicted_potential_vpo")


@query(f"{A.WITH} SELECT OUTLET_UID_EDITED, VPO FROM outlets ORDER BY md5(OUTLET_UID_EDITED), OUTLET_UID_EDITED LIMIT 50000")
def fit_sample(spark: SparkSession, d: str) -> DataFrame:
    return potential.fit_sample(A.outlets(spark, d)).select("OUTLET_UID_EDITED", "VPO")


for name, column in (("opportunity_gap", "opportunity_gap"), ("gap_pct", "gap_pct_of_potential"), ("upside_tag", "priority")):
    query(f"{WITH_SCORED} SELECT OUTLET_UID_EDITED, {column} FROM scored", name)(lambda spark, d, column=column: scored(spark, d).select("OUTLET_UID_EDITED", column))


@query(f"{WITH_SCORED} SELECT OUTLET_UID_EDITED, rank() OVER (PARTITION BY priority_bucket ORDER BY opportunity_gap DESC NULLS LAST) AS gap_rank_within_bucket FROM scored")
def gap_rank(spark: SparkSession, d: str) -> DataFrame:
    return priority.gap_ranked(scored(spark, d)).select("OUTLET_UID_EDITED", "gap_rank_within_bucket")


def dec(c: str, places: int) -> str:
    return f"round_even(CAST(avg(CAST({c} AS DECIMAL(18,4))) AS DOUBLE), {places})"


@query(f"{WITH_SCORED} SELECT priority, CAST(list_position(['A+','A','B+','B','C+','C','D+','D'], priority) - 1 AS INT) AS place, count(*) AS n, round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS pct, {dec('VPO', 0)} AS avg_vpo, {dec('predicted_potential_vpo', 0)} AS avg_predicted, {dec('opportunity_gap', 0)} AS avg_gap FROM scored GROUP BY priority")
def tier_summary(spark: SparkSession, d: str) -> DataFrame:
    return priority.tier_summary(scored(spark, d))


MODES = ["channel", "store_format", "sector", "Top City"]
MODES_SQL = " UNION ALL ".join(f"SELECT priority, '{c}' AS \"column\", \"{c}\" AS value, count(*) AS n FROM scored WHERE \"{c}\" IS NOT NULL GROUP BY ALL" for c in MODES)


@query(f"{WITH_SCORED} SELECT * FROM ({MODES_SQL}) QUALIFY row_number() OVER (PARTITION BY priority, \"column\" ORDER BY n DESC, value) = 1")
def tier_modes(spark: SparkSession, d: str) -> DataFrame:
    return priority.tier_modes(scored(spark, d), MODES)


@query(f"{A.WITH} SELECT feature, r FROM (SELECT 'income' AS feature, round_even(corr(income, VPO), 4) AS r FROM outlets WHERE VPO IS NOT NULL UNION ALL SELECT 'AVG_SKU', round_even(corr(AVG_SKU, VPO), 4) FROM outlets WHERE VPO IS NOT NULL UNION ALL SELECT 'ACTIVE_MONTHS', round_even(corr(ACTIVE_MONTHS, VPO), 4) FROM outlets WHERE VPO IS NOT NULL)")
def driver_correlation(spark: SparkSession, d: str) -> DataFrame:
    return priority.driver_correlation(A.outlets(spark, d).withColumn("constant", F.lit(1.0)), ["income", "AVG_SKU", "ACTIVE_MONTHS", "constant"])


# Segmentation


@query(f"SELECT column_name AS name FROM (VALUES ('TOTAL_REVENUE'), ('AVG_SKU')) v(column_name)")
def brand_columns(spark: SparkSession, d: str) -> DataFrame:
    df = A.outlets(spark, d)
    return df.limit(1).select(F.explode(F.array(*[F.lit(c) for c in df.columns if any(k in c.upper() for k in ("REVENUE", "SKU"))])).alias("name"))


@query()
def kmeans(spark: SparkSession, d: str) -> DataFrame:
    out, names = priority.standardised(cut(ready(spark, d), "ready"), [*FEATURES, "bucket_num"])
    return segments.kmeans(out, names).select("OUTLET_UID_EDITED", "cluster")


@query(f"{A.WITH} SELECT count(*) AS n, CAST({C.CLUSTERS} AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS far, true AS below_start FROM outlets")
def kmeans_check(spark: SparkSession, d: str) -> DataFrame:
    """Each outlet is nearest to the mean of its own cluster, and the clusters are tighter than outlets by trade channel."""
    out, names = priority.standardised(cut(ready(spark, d), "ready"), [*FEATURES, "bucket_num"])
    return segments.cluster_check(cut(segments.kmeans(out, names), "clustered"), names, "channel")


@query()
def kmeans_embeddings(spark: SparkSession, d: str) -> DataFrame:
    rows = A.read(spark, d, "embeddings").select("vec_id", array_to_vector("embedding").alias("x"), F.col("embedding")[0].cast("double").alias("x0"))
    return segments.kmeans(rows, ["x"], order="x0").select("vec_id", "cluster")


@query(f"{WITH_SCORED} SELECT cluster, count(*) AS n, round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS pct FROM scored GROUP BY 1")
def cluster_distribution(spark: SparkSession, d: str) -> DataFrame:
    return segments.distribution(scored(spark, d))


@query(f"{WITH_SCORED} SELECT cluster, count(*) AS n, " + ", ".join(f"{dec(m, 2)} AS mean_{m}, round_even(median(CAST({m} AS DOUBLE)), 2) AS median_{m}" for m in segments.MEASURES) + " FROM scored GROUP BY 1")
def cluster_profile_measures(spark: SparkSession, d: str) -> DataFrame:
    return segments.profile_measures(scored(spark, d))


TOP_SQL = " UNION ALL ".join(f"SELECT cluster, '{c}' AS feature, \"{c}\" AS value, count(*) AS n FROM scored WHERE \"{c}\" IS NOT NULL GROUP BY ALL" for c in ("channel", "sector"))


@query(f"{WITH_SCORED} SELECT cluster, feature, value, row_number() OVER (PARTITION BY cluster, feature ORDER BY n DESC, value) AS place, CAST(CAST(round_even(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY cluster, feature), 0) AS INT) AS STRING) || '%' AS share FROM ({TOP_SQL}) QUALIFY place <= 3")
def cluster_top_categories(spark: SparkSession, d: str) -> DataFrame:
    return segments.top_categories(scored(spark, d), ["channel", "sector"])


@query(f"{WITH_SCORED} SELECT cluster, {dec('income', 1)} AS mean_income FROM scored GROUP BY 1")
def cluster_demographics(spark: SparkSession, d: str) -> DataFrame:
    return segments.demographics(scored(spark, d), ["income", "absent"])


@query(f"{WITH_SCORED} SELECT {dec('v', 2)} AS mean_VPO, {dec('s', 2)} AS mean_AVG_SKU FROM (SELECT cluster, {dec('VPO', 2)} AS v, {dec('AVG_SKU', 2)} AS s FROM scored GROUP BY 1)")
def universe_averages(spark: SparkSession, d: str) -> DataFrame:
    return segments.universe(segments.profile_measures(scored(spark, d), ["VPO", "AVG_SKU"]))


@query(f"{WITH_SCORED} SELECT OUTLET_UID_EDITED, cluster, segment_label FROM scored")
def attach_labels(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("OUTLET_UID_EDITED", "cluster", "segment_label")


JSON_REPLY = """CASE WHEN c_custkey % 3 = 0 THEN '[{"cluster_id": 0, "label": "L' || c_custkey || '", "channel": "MT"}]' WHEN c_custkey % 3 = 1 THEN '```json' || chr(10) || '[{"cluster_id": 1, "label": "M", "action": "go"}]' || chr(10) || '```' ELSE 'no json' END"""


@query("""SELECT c_custkey AS doc_id, cluster, CASE WHEN c_custkey % 3 = 0 AND cluster = 0 THEN 'L' || c_custkey WHEN c_custkey % 3 = 1 AND cluster = 1 THEN 'M' ELSE 'Segment ' || cluster END AS label,
 CASE WHEN c_custkey % 3 = 0 AND cluster = 0 THEN 'MT' ELSE 'GT' END AS channel, CASE WHEN c_custkey % 3 = 1 AND cluster = 1 THEN 'go' ELSE 'Review cluster details manually.' END AS action FROM customer, (SELECT CAST(range AS INT) AS cluster FROM range(3))""")
def parse_label_json(spark: SparkSession, d: str) -> DataFrame:
    replies = A.read(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(JSON_REPLY).alias("text"))
    return textops.labels_from_json(replies, 3).select("doc_id", "cluster", "label", "channel", "action")


@query("""SELECT c_custkey AS doc_id, cluster, CASE WHEN cluster = 1 THEN 'Name ' || c_custkey ELSE 'Segment ' || cluster END AS label, CASE WHEN cluster = 1 THEN 'Web: shop' ELSE 'GT' END AS channel FROM customer, (SELECT CAST(range AS INT) AS cluster FROM range(2))""")
def parse_label_text(spark: SparkSession, d: str) -> DataFrame:
    text = "concat('CLUSTER 1:', chr(10), 'LABEL: Name ', c_custkey, chr(10), ' Channel: Web: shop', chr(10), 'other')"
    return textops.labels_from_lines(A.read(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(text).alias("text")), 2).select("doc_id", "cluster", "label", "channel")


@query("""SELECT c_custkey AS doc_id, 'identity_card' AS section, 'Outlet ' || c_custkey || chr(10) || 'second' AS body FROM customer UNION ALL SELECT c_custkey, 'commercial_action_plan', c_mktsegment FROM customer""")
def split_sections(spark: SparkSession, d: str) -> DataFrame:
    text = "concat('preface', chr(10), '**Section 1: IDENTITY CARD**', chr(10), 'Outlet ', c_custkey, chr(10), 'second', chr(10), '7. Commercial next steps', chr(10), c_mktsegment)"
    return textops.sections(A.read(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(text).alias("text")))


# Must-stock lists


@query(f"{WITH_LISTED} SELECT bucket, count(*) AS n, round_even(CAST(sum(CAST(NET_SALES AS DECIMAL(18,4))) AS DOUBLE), 2) AS sales FROM joined GROUP BY 1")
def sku_segment_join(spark: SparkSession, d: str) -> DataFrame:
    return joined(spark, d).groupBy("bucket").agg(F.count("*").alias("n"), F.bround(F.sum(rollup.money(F.col("NET_SALES"))).cast("double"), 2).alias("sales"))


@query(f"{WITH_LISTED} SELECT * FROM stores")
def bucket_store_count(spark: SparkSession, d: str) -> DataFrame:
    return assortment.bucket_stores(tiers(spark, d))


@query(f"{WITH_LISTED} SELECT bucket, {PRODUCT_SQL}, CAST(sales AS DOUBLE) AS sales FROM own")
def product_sales(spark: SparkSession, d: str) -> DataFrame:
    return assortment.product_sales(joined(spark, d)).select("bucket", *C.PRODUCT, F.col("sales").cast("double").alias("sales"))


@query(f"{WITH_LISTED} SELECT {PRODUCT_SQL}, CAST(sales_all AS DOUBLE) AS sales_all FROM overall")
def product_sales_all(spark: SparkSession, d: str) -> DataFrame:
    return assortment.product_sales(joined(spark, d)).groupBy(*C.PRODUCT).agg(F.sum("sales").cast("double").alias("sales_all"))


@query(f"{WITH_LISTED} SELECT bucket, {PRODUCT_SQL}, stores FROM own")
def product_store_count(spark: SparkSession, d: str) -> DataFrame:
    return assortment.product_sales(joined(spark, d)).select("bucket", *C.PRODUCT, "stores")


@query(f"{WITH_LISTED} SELECT bucket, order_month, brand, stores, true AS within FROM (SELECT bucket, CAST(order_month AS DATE) AS order_month, BRND_NM AS brand, count(DISTINCT CUST_UNIQ_ID_VAL) AS stores FROM joined WHERE BRND_NM IS NOT NULL GROUP BY CUBE (1, 2), BRND_NM)")
def brand_store_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Stores of each brand by tier and month, from sketches of single tiers and months; null: of all. Exact counts beside them."""
    rows = cut(joined(spark, d).where("BRND_NM IS NOT NULL").select("bucket", F.col("order_month").cast("date").alias("order_month"), F.col("BRND_NM").alias("brand"), "outlet"), "sold")
    by = ["bucket", "order_month", "brand"]
    near = sketches.counted(sketches.rolled_up(cut(sketches.sketched(rows, by, "outlet"), "sketches"), ["bucket", "order_month"], ["brand"]))
    exact = rows.cube("bucket", "order_month", "brand").agg(F.count_distinct("outlet").alias("stores")).where("brand IS NOT NULL")
    both = exact.join(near.withColumnsRenamed({c: f"__{c}" for c in by}), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    return both.select(*by, "stores", (F.abs(F.col("stores") - F.col("near")) <= F.ceil("error")).alias("within"))


def metric(name: str, column: str, places: int | None) -> None:
    sql = f"round_even({column}, {places})" if places is not None else column
    sql = sql.replace("index", '"index"')
    alias = f'"{column}"'

    def run(spark: SparkSession, d: str) -> DataFrame:
        c = F.bround(column, places) if places is not None else F.col(column)
        return listed(spark, d).select("bucket", "product", c.alias(column))

    query(f"{WITH_LISTED} SELECT bucket, product, {sql} AS {alias} FROM listed", name)(run)


metric("product_share", "share", 8)
metric("product_index", "index", 4)
metric("product_penetration", "penetration", 8)
metric("product_rank", "rank", None)
metric("cumulative_mix", "cumulative", 8)


@query(f"{WITH_LISTED} SELECT DISTINCT product FROM listed")
def product_name(spark: SparkSession, d: str) -> DataFrame:
    return listed(spark, d).select("product").distinct()


def mix_sql(by: str) -> str:
    return f"""{WITH_LISTED}, m AS (SELECT bucket, {by}, coalesce(sum(CAST(NET_SALES AS DECIMAL(18,4))), 0) AS s FROM joined WHERE {by} IS NOT NULL GROUP BY ALL), a AS (SELECT {by}, sum(s) AS sa FROM m GROUP BY 1),
 r AS (SELECT *, CAST(s AS DOUBLE) / CAST(sum(s) OVER (PARTITION BY bucket) AS DOUBLE) AS sh, CAST(sa AS DOUBLE) / (SELECT CAST(sum(s) AS DOUBLE) FROM m) AS sha FROM m JOIN a USING ({by}))
 SELECT bucket, {by}, CAST(s AS DOUBLE) AS sales, round_even(sh, 8) AS share, round_even(sh / sha * 100, 4) AS "index", row_number() OVER (PARTITION BY bucket ORDER BY s DESC, {by}) AS place FROM r"""


@query(mix_sql("BRND_NM"))
def brand_mix(spark: SparkSession, d: str) -> DataFrame:
    return assortment.mix(joined(spark, d), "BRND_NM").withColumns({"share": F.bround("share", 8), "index": F.bround("index", 4)})


@query(mix_sql("PPG_DESC"))
def pack_mix(spark: SparkSession, d: str) -> DataFrame:
    return assortment.mix(joined(spark, d), "PPG_DESC").withColumns({"share": F.bround("share", 8), "index": F.bround("index", 4)})


@query(f"{WITH_LISTED} SELECT bucket, round_even(avg(n), 1) AS avg_sku FROM (SELECT bucket, CUST_UNIQ_ID_VAL, count(NET_SALES) AS n FROM joined GROUP BY ALL) GROUP BY 1")
def avg_sku_per_store(spark: SparkSession, d: str) -> DataFrame:
    return assortment.skus_per_store(joined(spark, d))


@query(f"{WITH_LISTED} SELECT bucket, BRND_NM, PPG_DESC, CAST(count(*) AS BIGINT) AS n FROM listed GROUP BY ROLLUP (bucket, BRND_NM, PPG_DESC) HAVING bucket IS NOT NULL")
def brand_pack_matrix(spark: SparkSession, d: str) -> DataFrame:
    return assortment.brand_pack_matrix(listed(spark, d))


@query(f"{WITH_LISTED} SELECT b.bucket, CAST(r AS INT) AS rank, round_even(coalesce(cumulative, 0), 8) AS cumulative FROM (SELECT DISTINCT bucket FROM listed) b CROSS JOIN (VALUES (20), (35), (50)) v(r) LEFT JOIN listed l ON l.bucket = b.bucket AND l.rank = r")
def topn_contribution(spark: SparkSession, d: str) -> DataFrame:
    return assortment.top_contribution(listed(spark, d)).withColumn("cumulative", F.bround("cumulative", 8))


@query(f"{WITH_LISTED} SELECT bucket, product, CASE WHEN cumulative <= 0.5 THEN 'Hero' ELSE '' END AS sku_type, CASE WHEN cumulative <= 0.5 THEN '✓' ELSE '' END AS msl_selection FROM listed")
def hero_selection(spark: SparkSession, d: str) -> DataFrame:
    return assortment.heroes(listed(spark, d)).select("bucket", "product", "sku_type", "msl_selection")


@query(f"{WITH_LISTED} SELECT bucket, product, rank, CASE rank WHEN 1 THEN 'Hero' WHEN 2 THEN 'Strategic' WHEN 3 THEN 'Tail' END AS sku_type, CASE WHEN rank <= 2 THEN '✓' ELSE '' END AS msl_selection FROM listed")
def parse_selection_table(spark: SparkSession, d: str) -> DataFrame:
    text = F.lit("RANK | SKU_TYPE | CRITERION | REASONING\n1 | Hero | reach | sells\n2 | Strategic | growth | new\n3 | Tail | | \nno line")
    rows = listed(spark, d)
    table = textops.selection_table(rows.select("bucket").distinct().withColumn("text", text))
    return assortment.selected(rows, table).select("bucket", "product", "rank", "sku_type", "msl_selection")


@query(f"{WITH_SCORED} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, segment_label) AS place FROM (SELECT priority_bucket AS bucket, segment_label, count(*) AS n FROM scored GROUP BY 1, 2)) WHERE place <= 3")
def bucket_top_segments(spark: SparkSession, d: str) -> DataFrame:
    return assortment.bucket_segments(scored(spark, d))


@query(f"{WITH_LISTED} SELECT bucket, product, CASE WHEN penetration <= 0.55 THEN 'red' WHEN penetration <= 0.69 THEN 'orange' ELSE 'green' END AS band FROM listed")
def penetration_band(spark: SparkSession, d: str) -> DataFrame:
    return listed(spark, d).select("bucket", "product", E.penetration_band(F.col("penetration")).alias("band"))


# Must-stock lists that keep rules

RANKED_UNITS = "SELECT bucket, CAST(rank AS INT) AS rank, BRND_NM AS brand, PPG_DESC AS pack, CAST(sales * 10000 AS BIGINT) AS units, penetration, cumulative FROM listed"
SLOTS_SQL = "(VALUES " + ", ".join(f"('{t}', {a}, {b})" for t, (a, b) in mustlist.SLOTS.items()) + ") v(bucket, least, most)"
#: The same repair, a row a step, over all products of a tier.
MSL_SQL = f"""{WITH_LISTED.replace("WITH", "WITH RECURSIVE", 1)}, units AS MATERIALIZED ({RANKED_UNITS}),
 shelf AS MATERIALIZED (SELECT bucket, least, most, list(struct_pack(rank := rank, brand := brand, pack := pack, units := units) ORDER BY rank) AS items, CAST(sum(units) AS BIGINT) AS all_units FROM units JOIN (SELECT * FROM {SLOTS_SQL}) USING (bucket) GROUP BY ALL),
 ahead AS (SELECT bucket, rank, sum(units) OVER (PARTITION BY bucket ORDER BY rank) - units AS before FROM units),
 tops AS (SELECT bucket, least(greatest(count(*) FILTER (WHERE before * 100 < all_units * 70), any_value(least)), any_value(most)) AS top FROM ahead JOIN shelf USING (bucket) GROUP BY 1),
 walk AS (SELECT bucket, 0 AS step, list_transform(list_filter(items, lambda x: x.rank <= top), lambda x: struct_pack(rank := x.rank, why := 0)) AS state FROM shelf JOIN tops USING (bucket)
  UNION ALL SELECT bucket, step + 1, list_append(list_filter(state, lambda y: y.rank <> coalesce(go.out, 0)), struct_pack(rank := go.rank, why := go.why)) FROM (
   SELECT bucket, step, state, coalesce(CASE WHEN p IS NOT NULL AND (n < most OR out_p IS NOT NULL) THEN struct_pack(rank := p.rank, out := CASE WHEN n >= most THEN out_p.rank END, why := 1) END,
     CASE WHEN b IS NOT NULL AND q IS NOT NULL AND (n < most OR out_b IS NOT NULL) THEN struct_pack(rank := q.rank, out := CASE WHEN n >= most THEN out_b.rank END, why := 2) END,
     CASE WHEN n < most AND r IS NOT NULL AND (n < least OR list_sum(list_transform(chosen, lambda y: y.units)) * 100 < all_units * 70) THEN struct_pack(rank := r.rank, out := NULL::INT, why := 3) END) AS go
   FROM (SELECT *, list_filter(chosen, lambda y: y.brand = b AND (len(list_filter(chosen, lambda z: z.pack = y.pack)) >= 2 OR y.pack = q.pack))[-1] AS out_b
    FROM (SELECT *, CASE WHEN b IS NOT NULL THEN list_filter(others, lambda x: x.brand <> b)[1] END AS q
     FROM (SELECT *, len(chosen) AS n, list_filter(others, lambda x: len(list_filter(chosen, lambda y: y.pack = x.pack)) = 0)[1] AS p, list_filter(chosen, lambda y: len(list_filter(chosen, lambda z: z.pack = y.pack)) >= 2)[-1] AS out_p,
       list_filter(chosen, lambda x: len(list_filter(chosen, lambda y: y.brand = x.brand)) * 100 > 60 * len(chosen))[1].brand AS b, list_filter(others, lambda x: (len(list_filter(chosen, lambda y: y.brand = x.brand)) + 1) * 100 <= 60 * (len(chosen) + 1))[1] AS r
      FROM (SELECT w.bucket, step, state, items, all_units, least, most, list_filter(items, lambda x: list_contains(list_transform(state, lambda y: y.rank), x.rank)) AS chosen,
        list_filter(items, lambda x: NOT list_contains(list_transform(state, lambda y: y.rank), x.rank)) AS others FROM walk w JOIN shelf s ON w.bucket = s.bucket))))) WHERE go IS NOT NULL),
 msl AS (SELECT bucket, u.rank, ['Sales', 'Pack balance', 'Brand balance', 'Coverage'][u.why + 1] AS why FROM (SELECT bucket, unnest(state) AS u FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY step DESC) AS k FROM walk) WHERE k = 1))"""


@query(f"{MSL_SQL} SELECT bucket, rank, product, why FROM msl JOIN listed USING (bucket, rank)")
def msl_selection(spark: SparkSession, d: str) -> DataFrame:
    rows = listed(spark, d)
    return mustlist.selection(rows).join(rows.select("bucket", "rank", "product"), ["bucket", "rank"])


MSL_RULES_SQL = f"""{MSL_SQL}, mine AS (SELECT u.*, why FROM units u JOIN msl USING (bucket, rank)),
 f AS (SELECT bucket, any_value(least) AS least, any_value(most) AS most, CAST(any_value(all_units) AS DOUBLE) AS whole, count(*) AS n, CAST(sum(units) AS DOUBLE) AS held, CAST(coalesce(sum(units) FILTER (WHERE cumulative <= 0.5), 0) AS DOUBLE) AS hero, count(DISTINCT pack) AS packs,
  count(*) FILTER (WHERE penetration * 100 < 20 AND why = 'Sales') AS rare, (SELECT max(n) FROM (SELECT count(*) AS n FROM mine o WHERE o.bucket = mine.bucket GROUP BY brand)) AS top_brand, (SELECT count(DISTINCT pack) FROM units u WHERE u.bucket = mine.bucket) AS n_packs FROM mine JOIN shelf USING (bucket) GROUP BY bucket)
 SELECT bucket, r.rule, round_even(r.found, 4) AS found, r.wanted, r.pass FROM (SELECT bucket, unnest([
  struct_pack(rule := 'hero_share', found := hero * 100 / whole, wanted := 50::DOUBLE, pass := hero * 2 <= whole), struct_pack(rule := 'coverage', found := held * 100 / whole, wanted := 70::DOUBLE, pass := held * 100 >= whole * 70),
  struct_pack(rule := 'least_products', found := n::DOUBLE, wanted := least::DOUBLE, pass := n >= least), struct_pack(rule := 'most_products', found := n::DOUBLE, wanted := most::DOUBLE, pass := n <= most),
  struct_pack(rule := 'brand_share', found := top_brand * 100::DOUBLE / n, wanted := 60::DOUBLE, pass := top_brand * 100 <= n * 60), struct_pack(rule := 'packs', found := packs::DOUBLE, wanted := n_packs::DOUBLE, pass := packs = n_packs),
  struct_pack(rule := 'penetration', found := rare::DOUBLE, wanted := 0::DOUBLE, pass := rare = 0)]) AS r FROM f)"""


@query(MSL_RULES_SQL)
def msl_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = listed(spark, d)
    return mustlist.validation(rows, cut(mustlist.selection(rows), "msl"))


@query(f"SELECT * FROM ({MSL_RULES_SQL}) WHERE NOT pass")
def msl_violations(spark: SparkSession, d: str) -> DataFrame:
    """The rules that a tier's list can't keep, or doesn't."""
    return msl_validation(spark, d).where("NOT pass")


# Space


def dims(spark: SparkSession, d: str) -> DataFrame:
    """Pack sizes of each brand that the part table has; one brand has none."""
    rows = A.read(spark, d, "part").where("p_brand <> 'Brand#55'").select("p_brand").distinct()
    packs = F.explode(F.array(*[F.struct(F.lit(p).alias("ppg_raw"), F.lit(h).alias("height_cm"), F.lit(w).alias("width_cm"), F.lit(x).alias("depth_cm")) for p, h, w, x in (("Small", "15", "10", "4"), ("Medium", "20", "15", "6"), ("Large", "25", "20", "8"), ("Extra Large", "45", "30", "10"))]))
    return space.pack_dims(rows.select(F.xxhash64("p_brand").alias("row_no"), F.col("p_brand").alias("brand"), packs.alias("p")).select("row_no", "brand", "p.*"))


RACKS = [("Rack height", '1,600 mm (63")', "2000 mm"), ("Width", "900 mm", "1,200.5 mm"), ("Depth", "400 mm", "450"), ("Shelves / tiers", "4-5", "5")]


def racks(spark: SparkSession) -> DataFrame:
    return space.rack_specs(spark.createDataFrame(RACKS, "Parameter string, `Rack A` string, `Rack B` string"))


def brand_racks(spark: SparkSession, d: str) -> DataFrame:
    """A rack for each brand, its cells written from the brand's parts."""
    cells = A.read(spark, d, "part").groupBy("p_brand").agg(F.max("p_size").alias("m"), F.min("p_size").alias("l"), F.count("*").alias("n"))
    rows = {"Rack height": "concat('1,', 500 + m, ' mm (63\")')", "Width": "concat(600 + n % 300, '.5mm')", "Depth": "concat(300 + l, '')", "Tiers": "CASE WHEN n % 2 = 0 THEN concat(3, '-', 5 + l % 2) ELSE 'none' END"}
    long = cells.select("p_brand", F.inline(F.array(*[F.struct(F.lit(k).alias("Parameter"), F.expr(e).alias("cell")) for k, e in rows.items()])))
    brands = sorted(r.p_brand for r in cells.select("p_brand").collect())  # as many as there are racks
    return space.rack_specs(long.groupBy("Parameter").pivot("p_brand", brands).agg(F.first("cell")))


BRAND_RACKS_SQL = """racks AS (SELECT p_brand AS rack, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INT) AS position, 1500.0::DOUBLE + max(p_size) AS height_mm, 600.5::DOUBLE + count(*) % 300 AS width_mm, 300.0::DOUBLE + min(p_size) AS depth_mm,
 CAST(CASE WHEN count(*) % 2 = 0 THEN round_even((8 + min(p_size) % 2) / 2.0, 0) ELSE 3 END AS INT) AS n_shelves FROM part GROUP BY 1)"""


@query(f"WITH {BRAND_RACKS_SQL} SELECT *, round_even(width_mm * 0.95, 4) AS usable_width_mm, round_even(height_mm / n_shelves * 0.95, 4) AS shelf_height_mm FROM racks")
def scan_rack_specs(spark: SparkSession, d: str) -> DataFrame:
    return brand_racks(spark, d).withColumns({c: F.bround(c, 4) for c in ("usable_width_mm", "shelf_height_mm")})


@query(f"WITH {BRAND_RACKS_SQL} SELECT rack, height_mm FROM racks WHERE position = 0")
def rack_pick(spark: SparkSession, d: str) -> DataFrame:
    return space.first_rack(brand_racks(spark, d)).select("rack", "height_mm")


def faced(spark: SparkSession, d: str) -> DataFrame:
    rows = space.selected_or_all(space.msl_fields(assortment.heroes(listed(spark, d))))
    return space.facings(space.with_packs(rows, dims(spark, d)), space.first_rack(racks(spark)))


def placed(spark: SparkSession, d: str) -> DataFrame:
    return space.shelf_assignment(space.preferred_zones(space.placement_order(faced(spark, d))))


@query("SELECT DISTINCT p_brand AS brand, upper(p_brand[1]) || lower(p_brand[2:]) AS brand_norm FROM part")
def normalize_brand_pack(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "part").select(F.col("p_brand").alias("brand"), space.brand_name(F.col("p_brand")).alias("brand_norm")).distinct()


@query(f"{WITH_LISTED} SELECT bucket, product, round_even(share, 8) AS share, CAST(rank AS INT) AS rank, cumulative <= 0.5 AS selected FROM listed")
def msl_numeric_fields(spark: SparkSession, d: str) -> DataFrame:
    return space.msl_fields(assortment.heroes(listed(spark, d))).select("bucket", "product", F.bround("share", 8).alias("share"), "rank", "selected")


@query(f"{WITH_LISTED} SELECT bucket, product FROM (SELECT *, cumulative <= 0.5 AS s, bool_or(cumulative <= 0.5) OVER (PARTITION BY bucket) AS some_s FROM listed) WHERE s OR NOT some_s")
def selected_or_all(spark: SparkSession, d: str) -> DataFrame:
    return space.selected_or_all(space.msl_fields(assortment.heroes(listed(spark, d)))).select("bucket", "product")


SIZES_SQL = "CASE WHEN BRND_NM <> 'Brand#55' THEN CASE PPG_DESC WHEN 'Small' THEN {} WHEN 'Medium' THEN {} WHEN 'Large' THEN {} ELSE {} END END::DOUBLE"
FACED_SQL = f"""{WITH_LISTED}, pick AS (SELECT * FROM (SELECT *, cumulative <= 0.5 AS s, bool_or(cumulative <= 0.5) OVER (PARTITION BY bucket) AS some_s FROM listed) WHERE s OR NOT some_s),
 sized AS (SELECT *, {SIZES_SQL.format(150, 200, 250, 450)} AS h, {SIZES_SQL.format(100, 150, 200, 300)} AS w, {SIZES_SQL.format(40, 60, 80, 100)} AS d, 1600 / 4.0 * 0.95 AS shelf_h, 900 * 0.95 AS usable FROM pick),
 cap AS (SELECT *, 100.0 * share AS units, CASE WHEN h <= shelf_h THEN greatest(1, floor(400 / d)) * greatest(1, floor(shelf_h / h)) END AS cap FROM sized),
 need AS (SELECT *, greatest(1, ceil(units / cap)) AS raw_need FROM cap), need2 AS (SELECT *, CASE WHEN cap IS NOT NULL THEN raw_need END AS need FROM need),
 faced AS (SELECT *, round_even(cap * need / greatest(units / 7, 0.01), 1) AS dos, CAST(CASE WHEN h IS NULL THEN NULL WHEN h > shelf_h THEN 0 WHEN need * w > usable THEN greatest(1, floor(usable / w)) ELSE need END AS INT) AS facings,
  CASE WHEN h IS NULL THEN 'No pack dimensions' WHEN h > shelf_h THEN 'Pack taller than shelf' WHEN need * w > usable THEN 'Facings cut to shelf width' ELSE '' END AS warning FROM need2)"""


@query(f"{FACED_SQL} SELECT bucket, product, h, w, d FROM faced")
def pack_join(spark: SparkSession, d: str) -> DataFrame:
    return faced(spark, d).select("bucket", "product", "h", "w", "d")


@query(f"{FACED_SQL} SELECT bucket, product, facings FROM faced")
def facings(spark: SparkSession, d: str) -> DataFrame:
    return faced(spark, d).select("bucket", "product", "facings")


@query(f"{FACED_SQL} SELECT bucket, product, dos FROM faced")
def days_of_supply(spark: SparkSession, d: str) -> DataFrame:
    return faced(spark, d).select("bucket", "product", "dos")


@query(f"{FACED_SQL} SELECT bucket, product, round_even(facings * w, 2) AS used_mm FROM faced")
def width_cap(spark: SparkSession, d: str) -> DataFrame:
    return faced(spark, d).select("bucket", "product", F.bround("used_mm", 2).alias("used_mm"))


@query(f"{FACED_SQL} SELECT bucket, product, warning FROM faced")
def fit_warnings(spark: SparkSession, d: str) -> DataFrame:
    return faced(spark, d).select("bucket", "product", "warning")


@query(f"{FACED_SQL} SELECT bucket, product, row_number() OVER (PARTITION BY bucket ORDER BY CASE WHEN cumulative <= 0.5 THEN 0 ELSE 2 END, rank, product) AS place_no FROM faced")
def placement_order(spark: SparkSession, d: str) -> DataFrame:
    return space.placement_order(faced(spark, d)).select("bucket", "product", "place_no")


@query(f"{FACED_SQL} SELECT bucket, product, CASE WHEN PPG_DESC IN ('Large', 'Extra Large') THEN 'base' WHEN cumulative <= 0.5 THEN 'eye_level' ELSE 'upper' END AS first_zone FROM faced")
def preferred_zone(spark: SparkSession, d: str) -> DataFrame:
    return space.preferred_zones(faced(spark, d)).select("bucket", "product", F.col("zones")[0].alias("first_zone"))


SHELVES = {"base": (1, 3, 2, 4), "eye_level": (3, 2, 1, 4), "upper": (4, 3, 2, 1)}
FIT_SQL = " ".join(f"WHEN first_zone = '{z}' THEN CASE " + " ".join(f"WHEN l{k} >= used THEN {k}" for k in order) + " ELSE -1 END" for z, order in SHELVES.items())
PLACED_SQL = f"""{FACED_SQL.replace("WITH", "WITH RECURSIVE", 1)},
 ordered AS MATERIALIZED (SELECT *, facings * w AS used, row_number() OVER (PARTITION BY bucket ORDER BY CASE WHEN cumulative <= 0.5 THEN 0 ELSE 2 END, rank, product) AS place_no,
  CASE WHEN PPG_DESC IN ('Large', 'Extra Large') THEN 'base' WHEN cumulative <= 0.5 THEN 'eye_level' ELSE 'upper' END AS first_zone FROM faced),
 walk AS (SELECT DISTINCT bucket, CAST(0 AS BIGINT) AS place_no, 855.0::DOUBLE AS l1, 855.0::DOUBLE AS l2, 855.0::DOUBLE AS l3, 855.0::DOUBLE AS l4, 0 AS s FROM ordered
  UNION ALL SELECT bucket, place_no, {", ".join(f"CASE WHEN s = {k} THEN l{k} - used ELSE l{k} END" for k in (1, 2, 3, 4))}, s
  FROM (SELECT w.bucket, o.place_no, l1, l2, l3, l4, used, CASE WHEN coalesce(facings, 0) = 0 THEN 0 {FIT_SQL} END AS s FROM walk w JOIN ordered o ON o.bucket = w.bucket AND o.place_no = w.place_no + 1)),
 placed AS (SELECT o.*, CASE WHEN cumulative <= 0.5 THEN 'Hero' ELSE '' END AS sku_type, greatest(w.s, 0) AS shelf, CASE w.s WHEN 0 THEN 'not_placed' WHEN -1 THEN 'overflow' WHEN 1 THEN 'base' WHEN 2 THEN 'grab_zone' WHEN 3 THEN 'eye_level' ELSE 'upper' END AS zone
  FROM ordered o JOIN walk w USING (bucket, place_no)),
 held AS (SELECT bucket, {", ".join(f"CAST(greatest(1, ceil(coalesce(sum(used) FILTER (WHERE {c}), 0) / (855 * 4))) AS INT) AS {n}" for n, c in (("assets_needed", "shelf > 0"), ("assets_with_overflow", "shelf > 0 OR zone = 'overflow'")))},
  round_even(coalesce(CAST(sum(CAST(share AS DECIMAL(20,10))) FILTER (WHERE shelf > 0) AS DOUBLE), 0) * 100, 1) AS coverage_pct, count(*) FILTER (WHERE shelf > 0) AS n_placed, count(*) FILTER (WHERE zone = 'overflow') AS n_overflow, count(*) FILTER (WHERE h IS NULL) AS n_no_dims
  FROM placed GROUP BY 1)"""


@query(f"{PLACED_SQL} SELECT bucket, product, place_no, shelf, zone FROM placed")
def shelf_assignment(spark: SparkSession, d: str) -> DataFrame:
    return placed(spark, d).select("bucket", "product", "place_no", "shelf", "zone")


@query(f"{PLACED_SQL} SELECT * FROM held")
def assets_needed(spark: SparkSession, d: str) -> DataFrame:
    return space.assets_needed(placed(spark, d))


@query(f"{PLACED_SQL} SELECT bucket, n_placed, n_overflow, n_no_dims, coverage_pct, assets_needed FROM held")
def space_summary(spark: SparkSession, d: str) -> DataFrame:
    return space.assets_needed(placed(spark, d)).select("bucket", "n_placed", "n_overflow", "n_no_dims", "coverage_pct", "assets_needed")


@query(f"{PLACED_SQL} SELECT bucket, sku_type, product, rank, shelf, zone, dos, warning FROM (SELECT *, row_number() OVER (PARTITION BY bucket, sku_type ORDER BY rank, product) AS n FROM placed) WHERE (sku_type IN ('Hero', 'Strategic') AND n <= 8) OR warning <> ''")
def placement_highlights(spark: SparkSession, d: str) -> DataFrame:
    return space.highlights(placed(spark, d))


@query(f"""{PLACED_SQL} SELECT bucket, 'Rack A' AS rack, place_no, rank, product, BRND_NM AS brand, PPG_DESC AS pack, sku_type, round_even(share * 100, 2) AS share_pct, round_even(penetration * 100, 1) AS penetration_pct, round_even("index", 1) AS "index",
 h AS height_mm, w AS width_mm, d AS depth_mm, round_even(units, 6) AS units, facings, used AS used_mm, dos, shelf, zone, warning FROM placed""")
def space_display(spark: SparkSession, d: str) -> DataFrame:
    return space.display(placed(spark, d)).withColumn("units", F.bround("units", 6))


# Strategic score and weighted facings

#: Inputs of the score; a margin isn't known here, and extra large packs have no place in the price architecture.
SCORE_INPUTS = {
    "contribution_pct": "share * 100", "store_penetration_pct": "penetration * 100", "velocity": "CAST(sales AS DOUBLE) / stores", "shopper_relevance_score": "{q}index{q}",
    "pack_price_architecture_score": "CASE PPG_DESC WHEN 'Small' THEN 1.0e0 WHEN 'Medium' THEN 0.8e0 WHEN 'Large' THEN 0.5e0 END", "innovation_or_priority_score": "CASE WHEN length(FLVR_NM) % 4 = 0 THEN 1.0e0 ELSE 0.0e0 END",
}


def score_sql() -> str:
    """Products with their score; each input is scaled between its quantiles in the tier."""
    inputs = ", ".join(f"{e.format(q=chr(34))} AS {c}" for c, e in SCORE_INPUTS.items())
    ends = ", ".join(f"quantile_cont({c}, 0.05) AS lo_{c}, quantile_cont({c}, 0.95) AS hi_{c}" for c in SCORE_INPUTS)
    part = {c: f"CASE WHEN hi_{c} > lo_{c} THEN least(greatest(({c} - lo_{c}) / (hi_{c} - lo_{c}), 0), 1) ELSE 0.5 END" for c in SCORE_INPUTS}
    total = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {strategy.WEIGHTS[c]}::DOUBLE * {part[c]} END" for c in SCORE_INPUTS)
    weight = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {strategy.WEIGHTS[c]}::DOUBLE END" for c in SCORE_INPUTS)
    used = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in SCORE_INPUTS)
    return f"""{WITH_LISTED}, inputs AS (SELECT *, {inputs} FROM listed), ends AS (SELECT bucket, {ends} FROM inputs GROUP BY 1), strategic AS (SELECT i.*, ({total}) / ({weight}) AS strategic_score, {used} AS inputs_used FROM inputs i JOIN ends USING (bucket)),
 classes AS (SELECT *, CASE WHEN cumulative <= 0.5 THEN 'Hero' WHEN strategic_score >= 0.5 THEN 'Strategic' WHEN length(FLVR_NM) % 4 = 0 THEN 'Innovation' ELSE 'Tail' END AS sku_class FROM strategic)"""


SCORE_SQL = score_sql()


def strategic(rows: DataFrame) -> DataFrame:
    """Listed products with their inputs, score and class."""
    rows = cut(rows.withColumns({c: F.expr(e.format(q="`")) for c, e in SCORE_INPUTS.items()}), "inputs")
    return strategy.classified(strategy.strategic_score(rows), F.length("FLVR_NM") % 4 == 0)


@query(f"{SCORE_SQL} SELECT bucket, product, inputs_used, round_even(strategic_score, 6) AS strategic_score, sku_class FROM classes")
def strategic_score(spark: SparkSession, d: str) -> DataFrame:
    return strategic(listed(spark, d)).select("bucket", "product", "inputs_used", F.bround("strategic_score", 6).alias("strategic_score"), "sku_class")


RACKS_A_TIER = 200
WEIGHTED_SQL = f"""{SCORE_SQL}, sized AS (SELECT *, {SIZES_SQL.format(150, 200, 250, 450)} AS h, {SIZES_SQL.format(100, 150, 200, 300)} AS w, CASE WHEN "index" >= 120 THEN 125 WHEN "index" < 80 THEN 75 ELSE 100 END AS fit,
  CASE sku_class WHEN 'Hero' THEN 130 WHEN 'Strategic' THEN 110 ELSE 100 END AS commercial, CASE sku_class WHEN 'Hero' THEN 1 WHEN 'Strategic' THEN 2 WHEN 'Innovation' THEN 3 ELSE 4 END AS place FROM classes),
 room AS (SELECT bucket, CAST(floor(855 / CAST(avg(CAST(w AS DECIMAL(18,4))) FILTER (WHERE h <= 380) AS DOUBLE)) AS BIGINT) * 4 * {RACKS_A_TIER} AS total, count(*) FILTER (WHERE h <= 380 AND sku_class = 'Innovation') AS n_new, count(*) FILTER (WHERE h <= 380 AND sku_class <> 'Innovation') AS n_core FROM sized GROUP BY 1),
 pools AS (SELECT s.*, CASE WHEN sku_class = 'Innovation' THEN 'innovation' ELSE 'core' END AS pool, CASE WHEN n_new = 0 THEN 0 WHEN n_core = 0 THEN total ELSE CAST(round_even(total * 0.1::DOUBLE, 0) AS BIGINT) END AS new, total FROM sized s JOIN room USING (bucket)),
 own AS (SELECT *, CASE WHEN pool = 'core' THEN total - new ELSE new END AS pool_facings, CAST(sales * 10000 AS HUGEINT) * commercial * fit AS weight, row_number() OVER (PARTITION BY bucket, pool ORDER BY place, rank) AS k, count(*) OVER (PARTITION BY bucket, pool) AS n FROM pools WHERE h <= 380),
 quota AS (SELECT *, CASE WHEN k <= pool_facings THEN 1 ELSE 0 END AS first, pool_facings - least(n, pool_facings) AS rest, sum(weight) OVER (PARTITION BY bucket, pool) AS whole FROM own),
 parts AS (SELECT *, rest * weight // whole AS part, rest * weight % whole AS remainder FROM quota),
 dealt AS (SELECT *, first + part + CASE WHEN row_number() OVER (PARTITION BY bucket, pool ORDER BY remainder DESC, k) <= rest - sum(part) OVER (PARTITION BY bucket, pool) THEN 1 ELSE 0 END AS weighted FROM parts)"""
WEIGHTED_SQL = WEIGHTED_SQL.replace(" own AS (SELECT *, CASE WHEN pool", " items AS (SELECT *, CASE WHEN pool").replace("AS whole FROM own)", "AS whole FROM items)")


def weighted(spark: SparkSession, d: str) -> DataFrame:
    """All listed products of a tier on the racks of all its stores together."""
    rows = strategic(listed(spark, d)).withColumn("fit", F.when(F.col("index") >= 120, "strong_fit").when(F.col("index") < 80, "weak").otherwise("neutral"))
    return strategy.weighted_facings(space.facings(space.with_packs(rows, dims(spark, d)), space.first_rack(racks(spark))), RACKS_A_TIER)


@query(f"{WEIGHTED_SQL} SELECT bucket, product, sku_class, pool, CAST(coalesce(d.weighted, 0) AS BIGINT) AS facings FROM pools LEFT JOIN dealt d USING (bucket, product, sku_class, pool)")
def weighted_facings(spark: SparkSession, d: str) -> DataFrame:
    return weighted(spark, d).select("bucket", "product", "sku_class", "pool", F.col("weighted").alias("facings"))


@query(f"{WEIGHTED_SQL} SELECT bucket, pool, any_value(pool_facings) AS pool_facings, any_value(pool_facings) AS dealt FROM dealt GROUP BY 1, 2")
def facing_pools(spark: SparkSession, d: str) -> DataFrame:
    """The pools of each tier, and the facings dealt from them, which are as many."""
    return weighted(spark, d).where("cap IS NOT NULL").groupBy("bucket", "pool").agg(F.first("pool_facings").alias("pool_facings"), F.sum("weighted").alias("dealt"))


# Reports

WITH_SEGMENT = f"{WITH_SCORED} SELECT cluster, segment_label, CASE WHEN cluster = 5 THEN '' ELSE 'Action ' || cluster END AS action, count(*) AS n, " + ", ".join(f"{dec(m, 1)} AS avg_{m.lower()}" for m in segments.MEASURES) + ", round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS pct FROM scored GROUP BY ALL"


@query(WITH_SEGMENT)
def segment_summary(spark: SparkSession, d: str) -> DataFrame:
    return segments.segment_summary(scored(spark, d))


@query(f"SELECT cluster, segment_label, n, avg_vpo FROM ({WITH_SEGMENT})")
def chart_series(spark: SparkSession, d: str) -> DataFrame:
    return segments.segment_summary(scored(spark, d)).select("cluster", "segment_label", "n", "avg_vpo")


@query(f"{WITH_SCORED} SELECT count(DISTINCT cluster) AS n_segments, count(*) AS n_outlets, round_even(CAST(sum(CAST(VPO AS DECIMAL(18,4))) AS DOUBLE), 2) AS total_vpo FROM scored")
def segment_overview(spark: SparkSession, d: str) -> DataFrame:
    return segments.segment_overview(scored(spark, d))


@query(f"{WITH_SCORED} SELECT priority, priority LIKE '%+' AS upside, count(*) AS n, {dec('VPO', 0)} AS avg_vpo, {dec('predicted_potential_vpo', 0)} AS avg_predicted, round_even(CAST(sum(CAST(greatest(opportunity_gap, 0) AS DECIMAL(18,4))) AS DOUBLE), 0) AS total_opportunity, {dec('AVG_SKU', 1)} AS avg_sku, {dec('ACTIVE_MONTHS', 1)} AS avg_months FROM scored GROUP BY 1")
def tier_report(spark: SparkSession, d: str) -> DataFrame:
    gain = F.when(F.col("opportunity_gap") > 0, F.col("opportunity_gap")).otherwise(0.0)
    return scored(spark, d).groupBy("priority").agg(
        F.first(F.col("priority").endswith("+")).alias("upside"), F.count("*").alias("n"), priority.mean("VPO", 0).alias("avg_vpo"), priority.mean("predicted_potential_vpo", 0).alias("avg_predicted"),
        F.bround(F.sum(rollup.money(gain)).cast("double"), 0).alias("total_opportunity"), priority.mean("AVG_SKU", 1).alias("avg_sku"), priority.mean("ACTIVE_MONTHS", 1).alias("avg_months"),
    )


@query(f"{WITH_SCORED} SELECT priority, OUTLET_UID_EDITED, opportunity_gap, row_number() OVER (PARTITION BY priority ORDER BY opportunity_gap DESC NULLS LAST, OUTLET_UID_EDITED) AS place FROM scored QUALIFY place <= 50000")
def tier_detail_topk(spark: SparkSession, d: str) -> DataFrame:
    return segments.detail_top(scored(spark, d), "priority", [("opportunity_gap", True), ("OUTLET_UID_EDITED", False)], 50_000).select("priority", "OUTLET_UID_EDITED", "opportunity_gap", "place")


@query(f"{WITH_SCORED} SELECT cluster, OUTLET_UID_EDITED, row_number() OVER (PARTITION BY cluster ORDER BY OUTLET_UID_EDITED) AS place FROM scored QUALIFY place <= 50000")
def segment_detail_cap(spark: SparkSession, d: str) -> DataFrame:
    return segments.detail_top(scored(spark, d), "cluster", [("OUTLET_UID_EDITED", False)], 50_000).select("cluster", "OUTLET_UID_EDITED", "place")


@query(f"{WITH_SCORED} SELECT priority, OUTLET_UID_EDITED, opportunity_gap, row_number() OVER (PARTITION BY priority ORDER BY opportunity_gap DESC NULLS LAST, OUTLET_UID_EDITED) AS place FROM scored QUALIFY place <= 50")
def tier_leaders(spark: SparkSession, d: str) -> DataFrame:
    """As the detail of tiers, with fewer places than a tier has outlets."""
    return segments.detail_top(scored(spark, d), "priority", [("opportunity_gap", True), ("OUTLET_UID_EDITED", False)], 50).select("priority", "OUTLET_UID_EDITED", "opportunity_gap", "place")


HEAT = ["income", "VPO", "AVG_SKU", "ACTIVE_MONTHS"]
HEAT_SQL = " UNION ALL ".join(f"SELECT cluster, '{c}' AS feature, CAST(avg(CAST({c} AS DECIMAL(18,4))) AS DOUBLE) AS m FROM scored GROUP BY 1" for c in HEAT)


@query(f"{WITH_SCORED} SELECT cluster, feature, round_even((m - avg(m) OVER w) / stddev_pop(m) OVER w, 3) AS z FROM ({HEAT_SQL}) WINDOW w AS (PARTITION BY cluster)")
def feature_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return segments.feature_heatmap(scored(spark, d), HEAT)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '2.0,5.0,3.0,3.0,3.0,3.0,3.0,3.0' ELSE '3.0,3.0,3.0,3.0,3.0,3.0,3.0,3.0' END AS scores FROM customer")
def radar_scores(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'Radar Scores: [2, 5]' WHEN c_custkey % 3 = 1 THEN 'Scores: [2, x]' END")
    return A.read(spark, d, "customer").select("c_custkey", F.array_join(F.transform(E.radar_scores(F.coalesce(text, F.lit(""))), lambda x: x.cast("string")), ",").alias("scores"))


SECTIONS = list(dict.fromkeys(name for _, name in textops.SECTIONS))
TEXTS_SQL = ", ".join({"identity_card": "'Segment of ' || n", "shopper_profile": "'Cluster ' || cluster || chr(10) || 'second line'"}.get(s, "''") + f" AS {s}" for s in SECTIONS)


@query(f"{WITH_SCORED} SELECT cluster, segment_label AS label, CASE WHEN cluster = 5 THEN '' WHEN cluster % 2 = 0 THEN 'GT' ELSE 'MT' END AS channel, CASE WHEN cluster = 5 THEN '' ELSE 'Stock-up' END AS occasion, {TEXTS_SQL} FROM (SELECT cluster, segment_label, count(*) AS n FROM scored GROUP BY 1, 2)")
def segment_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(scored(spark, d).groupBy("cluster").agg(F.count("*").alias("n")), "clusters")
    text = F.concat(F.lit("IDENTITY CARD\nSegment of "), F.col("n").cast("string"), F.lit("\nSection 2: SHOPPER PROFILE\nCluster "), F.col("cluster").cast("string"), F.lit("\nsecond line"))
    replies = textops.sections(rows.select(F.col("cluster").alias("doc_id"), text.alias("text")))
    return segments.segment_texts(rows, labels(spark), replies, SECTIONS)


# Statistics of reference sales


@query(f"WITH {A.SALES_SQL} SELECT {PRODUCT_SQL}, count(*) AS n, round_even(count(*) * 1.0::DOUBLE / (SELECT count(DISTINCT CUST_UNIQ_ID_VAL) FROM sales), 6) AS penetration FROM sales WHERE BRND_NM IS NOT NULL GROUP BY ALL")
def sku_ref_penetration(spark: SparkSession, d: str) -> DataFrame:
    return skustats.reference_penetration(A.sales(spark, d))


@query(f"WITH {A.SALES_SQL}, s AS (SELECT {PRODUCT_SQL}, round_even(count(*) * 1.0::DOUBLE / (SELECT count(DISTINCT CUST_UNIQ_ID_VAL) FROM sales), 6) AS p FROM sales WHERE BRND_NM IS NOT NULL GROUP BY ALL) SELECT {PRODUCT_SQL}, CASE round_even(p, 2) WHEN 1.0 THEN 0.88 WHEN 0.8 THEN 0.72 WHEN 0.6 THEN 0.5 WHEN 0.4 THEN 0.28 WHEN 0.2 THEN 0.07 ELSE 0.05 END::DOUBLE AS lo FROM s")
def penetration_tier(spark: SparkSession, d: str) -> DataFrame:
    return skustats.reference_penetration(A.sales(spark, d)).select(*C.PRODUCT, skustats.tier_range(F.col("penetration"))["lo"].alias("lo"))


@query(f"WITH {A.SALES_SQL} SELECT BRND_NM, PPG_DESC, round_even(avg(ln(greatest(NET_SALES, 0.01))), 4) AS mu, round_even(coalesce(stddev_samp(ln(greatest(NET_SALES, 0.01))), 1.2), 4) AS sigma FROM sales WHERE NET_SALES IS NOT NULL AND BRND_NM IS NOT NULL AND PPG_DESC IS NOT NULL GROUP BY ALL")
def lognormal_params(spark: SparkSession, d: str) -> DataFrame:
    return skustats.lognormal(A.sales(spark, d))


@query(f"WITH {A.SALES_SQL} SELECT round_even(avg(ln(greatest(NET_SALES, 0.01))), 4) AS mu, round_even(stddev_samp(ln(greatest(NET_SALES, 0.01))), 4) AS sigma FROM sales WHERE NET_SALES IS NOT NULL")
def lognormal_global(spark: SparkSession, d: str) -> DataFrame:
    return skustats.lognormal_global(A.sales(spark, d))


@query(f"WITH {A.SALES_SQL} SELECT min(n) AS least, median(n) AS median, round_even(avg(n), 2) AS mean, max(n) AS most FROM (SELECT count(*) AS n FROM sales GROUP BY CUST_UNIQ_ID_VAL)")
def skus_per_outlet(spark: SparkSession, d: str) -> DataFrame:
    return skustats.skus_per_outlet(A.sales(spark, d))


@query(f"WITH {A.SALES_SQL} SELECT {PRODUCT_SQL}, round_even(count(DISTINCT CUST_UNIQ_ID_VAL) * 100.0::DOUBLE / (SELECT count(DISTINCT CUST_UNIQ_ID_VAL) FROM sales), 1) AS penetration_pct FROM sales WHERE BRND_NM IS NOT NULL GROUP BY ALL")
def actual_penetration(spark: SparkSession, d: str) -> DataFrame:
    return skustats.actual_penetration(A.sales(spark, d))


@query(f"WITH {A.SALES_SQL} SELECT count(NET_SALES) AS n, {dec('NET_SALES', 2)} AS mean, round_even(stddev_samp(NET_SALES), 2) AS std, round_even(min(NET_SALES), 2) AS least, round_even(quantile_cont(NET_SALES, 0.25), 2) AS q1, round_even(quantile_cont(NET_SALES, 0.5), 2) AS median, round_even(quantile_cont(NET_SALES, 0.75), 2) AS q3, round_even(max(NET_SALES), 2) AS most FROM sales")
def describe_sales(spark: SparkSession, d: str) -> DataFrame:
    return skustats.describe_sales(A.sales(spark, d))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Outlets and mean revenue of each tier."""
    return tiers(spark, d).groupBy("priority_bucket").agg(F.count("*").alias("n"), priority.mean("VPO", 2).alias("avg_vpo")).orderBy("priority_bucket")


query(f"{WITH_TIERS} SELECT priority_bucket, count(*) AS n, {dec('VPO', 2)} AS avg_vpo FROM tiers GROUP BY 1", "tier_distribution")(flagship)


# Files and streams: results written and read back


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/storelens/{name}-{uuid.uuid4().hex}"


SEGMENT_COLUMNS = ["OUTLET_UID_EDITED", "cluster", "segment_label"]


@query(f"{WITH_SCORED} SELECT OUTLET_UID_EDITED, cluster, segment_label FROM scored")
def sink_all_segments(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "all")
    sinks.all_segments(scored(spark, d).select(*SEGMENT_COLUMNS), path)
    return files.read(spark, path, schema="OUTLET_UID_EDITED string, cluster int, segment_label string")


@query(f"{WITH_SCORED} SELECT 'segment_' || cluster || '_' || segment_label AS segment, count(*) AS n FROM scored GROUP BY 1")
def sink_per_segment(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "each")
    sinks.per_segment(scored(spark, d).select(*SEGMENT_COLUMNS), path, "parquet")
    return spark.read.parquet(path).groupBy("segment").agg(F.count("*").alias("n"))


@query(f"{WITH_TIERS} SELECT priority_bucket, count(*) AS n, round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS pct FROM tiers GROUP BY 1")
def sink_report_tables(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "report")
    sinks.report_tables({"tiers": priority.shares(tiers(spark, d), "priority_bucket")}, path, "1")
    return spark.read.parquet(f"{path}/1/tiers")


@query("SELECT CAST(n_nationkey AS STRING) AS n_nationkey, n_name FROM nation")
def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "snapshots")
    for name, rows in (("old", A.read(spark, d, "region").selectExpr("r_regionkey AS n_nationkey", "r_name AS n_name")), ("new", A.read(spark, d, "nation").select("n_nationkey", "n_name"))):
        rows.coalesce(1).write.option("header", True).csv(f"{path}/{name}")
    return files.latest(spark, path, "part-*.csv")


def streamed(spark: SparkSession, d: str, archive: bool) -> DataFrame:
    path = folder(spark, "inbox")
    rows = A.read(spark, d, "events").select("event_id", "event_type", "value")
    rows.repartition(3, "event_id").write.option("header", True).csv(f"{path}/in")
    run = lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/out/{batch}")
    inbox(spark, f"{path}/in", rows.schema, f"{path}/check", run, archive=f"{path}/done" if archive else None, once=True).awaitTermination()
    out = spark.read.option("recursiveFileLookup", True).schema(rows.schema).parquet(f"{path}/out")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1")
def inbox_batch(spark: SparkSession, d: str) -> DataFrame:
    return streamed(spark, d, False)


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1")
def inbox_stream(spark: SparkSession, d: str) -> DataFrame:
    return streamed(spark, d, True)


@query(f"""{A.WITH}, {A.RANKED_SQL} SELECT priority_bucket, count(*) AS n, min(vpo_percentile) AS low, max(vpo_percentile) AS high, CAST(1 AS BIGINT) AS runs FROM tiers GROUP BY 1""")
def inbox_committed(spark: SparkSession, d: str) -> DataFrame:
    """The batch over a delivery of outlet files; the first attempt is lost after its second table, and only the one after it counts."""
    path, lost = folder(spark, "inbox"), []
    rows = A.outlets(spark, d)
    rows.write.option("header", True).csv(f"{path}/in")

    def make(df: DataFrame) -> dict[str, DataFrame]:
        if lost:
            return batch.run(df, None, ["income", "AVG_SKU", "ACTIVE_MONTHS"])
        lost.append(True)
        checks = quality.report(df, ["OUTLET_UID_EDITED", "VPO"])
        return {"checks": checks, "verdict": quality.verdict(checks), "outlets": df.withColumn("lost", F.raise_error(F.lit("lost")))}

    run = commits.committed(f"{path}/out", make)
    start = lambda: inbox(spark, f"{path}/in", rows.schema, f"{path}/check", run, once=True, files=100_000).awaitTermination()
    try:
        start()
    except StreamingQueryException:
        start()
    out = commits.results(spark, f"{path}/out", "outlets")
    return out.groupBy("priority_bucket").agg(F.count("*").alias("n"), F.min("vpo_percentile").alias("low"), F.max("vpo_percentile").alias("high"), F.count_distinct("batch").alias("runs"))


@query()
def full_run(spark: SparkSession, d: str) -> DataFrame:
    """The whole batch over outlets and sales; its must-stock lists."""
    return batch.run(A.outlets(spark, d), A.sales(spark, d), ["income", "AVG_SKU", "ACTIVE_MONTHS"])["must_stock"].select("bucket", "product", "rank", "sku_type")
