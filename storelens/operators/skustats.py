"""Statistics of a reference table of sales: how far products reach, and how their sales are spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.encode import looked_up
from ..plans.lineage import cut
from . import ranking

# By the share of reference stores (two decimals), the range of the chance that a store carries a product.
TIER_RANGE = {1.00: (0.88, 0.97), 0.80: (0.72, 0.88), 0.60: (0.50, 0.72), 0.40: (0.28, 0.50), 0.20: (0.07, 0.28)}


def reference_penetration(sales: DataFrame) -> DataFrame:
    """product columns, n, penetration: rows of a product over all outlets; rows without a brand are left out."""
    stores = sales.agg(F.count_distinct(F.col(C.SALES_ID)).alias("stores"))
    out = sales.where("BRND_NM IS NOT NULL").groupBy(*C.PRODUCT).agg(F.count("*").alias("n"))
    return out.join(F.broadcast(stores)).select(*C.PRODUCT, "n", F.bround(F.col("n") / F.col("stores"), 6).alias("penetration"))


def actual_penetration(sales: DataFrame) -> DataFrame:
    """product columns, penetration_pct: distinct outlets of a product over all outlets, one decimal."""
    stores = sales.agg(F.count_distinct(F.col(C.SALES_ID)).alias("stores"))
    out = sales.dropna(subset=C.PRODUCT).groupBy(*C.PRODUCT).agg(F.count_distinct(F.col(C.SALES_ID)).alias("n"))
    return out.join(F.broadcast(stores)).select(*C.PRODUCT, F.bround(F.col("n") * 100.0 / F.col("stores"), 1).alias("penetration_pct"))


def tier_range(penetration: Column, ranges: dict[float, tuple[float, float]] | None = None) -> Column:
    """Struct lo, hi of a share of stores; (0.05, 0.15) for shares without an entry."""
    ranges, key = ranges or TIER_RANGE, F.bround(penetration.cast("double"), 2)
    pick = lambda k, other: F.coalesce(looked_up(key, {float(t): r[k] for t, r in ranges.items()}), F.lit(other))
    return F.struct(pick(0, 0.05).alias("lo"), pick(1, 0.15).alias("hi"))


def log_sales() -> Column:
    return F.ln(F.greatest(F.col("NET_SALES"), F.lit(0.01)))


def lognormal(sales: DataFrame, least_std: float = 1.2) -> DataFrame:
    """BRND_NM, PPG_DESC, mu, sigma of the log of sales; a missing sigma is that of the pack, or else 1.2."""
    rows = sales.where("NET_SALES IS NOT NULL AND BRND_NM IS NOT NULL AND PPG_DESC IS NOT NULL")
    own = rows.groupBy("BRND_NM", "PPG_DESC").agg(F.avg(log_sales()).alias("mu"), F.stddev_samp(log_sales()).alias("own"))
    pack = sales.where("NET_SALES IS NOT NULL AND PPG_DESC IS NOT NULL").groupBy("PPG_DESC").agg(F.stddev_samp(log_sales()).alias("pack"))
    return own.join(pack, "PPG_DESC", "left").select("BRND_NM", "PPG_DESC", F.bround("mu", 4).alias("mu"), F.bround(F.coalesce("own", "pack", F.lit(least_std)), 4).alias("sigma"))


def lognormal_global(sales: DataFrame) -> DataFrame:
    return sales.where("NET_SALES IS NOT NULL").agg(F.bround(F.avg(log_sales()), 4).alias("mu"), F.bround(F.stddev_samp(log_sales()), 4).alias("sigma"))


def skus_per_outlet(sales: DataFrame) -> DataFrame:
    per = cut(sales.groupBy(C.SALES_ID).agg(F.count("*").alias("n")), "per-outlet")
    stats = per.agg(F.min("n").alias("least"), F.bround(F.avg("n"), 2).alias("mean"), F.max("n").alias("most"))
    return stats.join(F.broadcast(ranking.quantiles(per, "n", {"median": 0.5}))).select("least", "median", "mean", "most")  # one row each


def describe_sales(sales: DataFrame) -> DataFrame:
    x, quarters = F.col("NET_SALES").cast("double"), {"q1": 0.25, "median": 0.5, "q3": 0.75}
    rows = cut(sales.select("NET_SALES"), "net-sales")
    stats = rows.agg(
        F.count(x).alias("n"), F.bround(F.avg(x.cast("decimal(18,4)")).cast("double"), 2).alias("mean"), F.bround(F.stddev_samp(x), 2).alias("std"),
        F.bround(F.min(x), 2).alias("least"), F.bround(F.max(x), 2).alias("most"),
    )
    found = ranking.quantiles(rows, "NET_SALES", quarters).select(*[F.bround(c, 2).alias(c) for c in quarters])
    return stats.join(F.broadcast(found)).select("n", "mean", "std", "least", *quarters, "most")  # one row each
