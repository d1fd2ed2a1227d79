"""From sales of products at outlets to one row an outlet, and its enrichment from a master table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import config as C
from ..functions import encode as E


def money(c: Column) -> Column:
    """As a decimal, so that a sum doesn't depend on the order of its rows."""
    return c.cast("decimal(18,4)")


def total(c: Column) -> Column:
    """Sum as a double; 0 where all values are null."""
    return F.coalesce(F.sum(money(c)).cast("double"), F.lit(0.0))


def is_sku_table(df: DataFrame) -> bool:
    """Whether a table holds sales of products rather than outlets."""
    have = set(df.columns)
    return {C.SALES_ID, "NET_SALES", "BRND_NM"} <= have and not {C.OUTLET_ID, C.VALUE} <= have


def outlet_rollup(sales: DataFrame) -> DataFrame:
    """One row a store: its revenue as VPO and TOTAL_REVENUE, its rows as AVG_SKU, one month. Rows without an id are left out."""
    own = sales.withColumn(C.OUTLET_ID, F.trim(F.col(C.SALES_ID).cast("string"))).where(F.col(C.OUTLET_ID).isNotNull())
    out = own.groupBy(C.OUTLET_ID).agg(F.bround(total(F.col("NET_SALES")), 2).alias("VPO"), F.count("*").alias("AVG_SKU"))
    return out.select(C.OUTLET_ID, "VPO", F.col("VPO").alias("TOTAL_REVENUE"), "AVG_SKU", F.lit(1).cast("long").alias("ACTIVE_MONTHS"))


def brand_pack_pivot(sales: DataFrame, keys: list[str]) -> DataFrame:
    """Store by brand and pack: revenue, 0 where none. The keys are given, so no job looks for them."""
    own = sales.select(F.trim(F.col(C.SALES_ID).cast("string")).alias(C.OUTLET_ID), E.brand_pack(F.col("BRND_NM"), F.col("PPG_DESC")).alias("key"), "NET_SALES")
    own = own.where(F.col("key").isNotNull() & F.col(C.OUTLET_ID).isNotNull())
    return own.groupBy(C.OUTLET_ID).pivot("key", keys).agg(total(F.col("NET_SALES"))).na.fill(0.0, keys)


def brand_pack_sparse(sales: DataFrame) -> DataFrame:
    """Store and `by_key`: a map from each brand and pack that it has sales of to their revenue, in the keys' order; as many keys as there may be, none is looked for beforehand."""
    own = sales.select(F.trim(F.col(C.SALES_ID).cast("string")).alias(C.OUTLET_ID), E.brand_pack(F.col("BRND_NM"), F.col("PPG_DESC")).alias("key"), "NET_SALES")
    own = own.where(F.col("key").isNotNull() & F.col(C.OUTLET_ID).isNotNull()).groupBy(C.OUTLET_ID, "key").agg(total(F.col("NET_SALES")).alias("sales"))
    return own.groupBy(C.OUTLET_ID).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "sales")))).alias("by_key"))  # of one store, an entry for each key


def densified(sparse: DataFrame, keys: list[str]) -> DataFrame:
    """The columns of some keys, 0 where a store has no entry: those rows of `brand_pack_pivot` that have any."""
    return sparse.select(C.OUTLET_ID, *[F.coalesce(F.try_element_at("by_key", F.lit(k)), F.lit(0.0)).alias(k) for k in keys])


def brand_pack_keys(sales: DataFrame) -> list[str]:
    """The brand and pack keys in order: as many as the assortment has brands times packs."""
    keys = sales.select(E.brand_pack(F.col("BRND_NM"), F.col("PPG_DESC")).alias("key")).where("key IS NOT NULL").distinct()
    return sorted(r.key for r in keys.collect())


def with_pivot(outlets: DataFrame, pivot: DataFrame) -> DataFrame:
    """Outlets with their pivot; a store that has no keyed sale keeps nulls."""
    return outlets.join(pivot, C.OUTLET_ID, "left")


def dedupe_master(master: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The first row, in the order of a column, of each outlet; the columns that there are."""
    kept = [c for c in columns if c in master.columns and c != C.OUTLET_ID]
    first = F.row_number().over(W.partitionBy(C.OUTLET_ID).orderBy(order))
    return master.withColumn("__n", first).where("__n = 1").select(C.OUTLET_ID, *[F.col(f"`{c}`") for c in kept])


def enrich(outlets: DataFrame, master: DataFrame) -> DataFrame:
    """Outlets left-joined with the master; its columns that outlets have too get the suffix _mmf."""
    renamed = [F.col(f"`{c}`").alias(f"{c}_mmf" if c in outlets.columns and c != C.OUTLET_ID else c) for c in master.columns]
    return outlets.join(master.select(*renamed), C.OUTLET_ID, "left")


def prefer_master(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The master's value where there is one, else our own; the suffixed columns go."""
    both = [c for c in (columns or C.PREFERRED) if f"{c}_mmf" in df.columns]
    return df.withColumns({c: F.coalesce(F.col(f"{c}_mmf"), F.col(c)) for c in both}).drop(*[f"{c}_mmf" for c in both])


def fill_defaults(df: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """Mandatory columns are added, or their nulls filled."""
    defaults = defaults or C.MANDATORY
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})
