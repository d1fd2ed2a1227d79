"""Must-stock lists: what each tier sells, against all tiers.

One aggregation of sales by tier and product feeds shares, ranks and totals; all tiers at once. Ranks and running sums
are counted by range, so no task holds the products of a tier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import config as C
from ..functions import encode as E
from ..plans.lineage import cut
from . import ranking
from .rollup import money


def joined(sales: DataFrame, segments: DataFrame, bucket: str = "priority_bucket") -> DataFrame:
    """Sales of the outlets in the segment table, with their bucket; ids are compared as trimmed text."""
    left = sales.withColumn("outlet", F.trim(F.col(C.SALES_ID).cast("string")))
    right = segments.select(F.trim(F.col(C.OUTLET_ID).cast("string")).alias("outlet"), F.col(bucket).alias("bucket"))
    return left.join(right, "outlet")


def bucket_stores(segments: DataFrame, bucket: str = "priority_bucket") -> DataFrame:
    """bucket, n_stores, from the segment table."""
    return segments.groupBy(F.col(bucket).alias("bucket")).agg(F.count_distinct(F.trim(F.col(C.OUTLET_ID).cast("string"))).alias("n_stores"))


def product_sales(rows: DataFrame) -> DataFrame:
    """bucket and product: sales (decimal) and stores. Products with a null part are left out."""
    known = rows.dropna(subset=C.PRODUCT)
    return known.groupBy("bucket", *C.PRODUCT).agg(F.coalesce(F.sum(money(F.col("NET_SALES"))), F.lit(0).cast("decimal(28,4)")).alias("sales"), F.count_distinct("outlet").alias("stores"))


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double; 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def products(rows: DataFrame, stores: DataFrame) -> DataFrame:
    """bucket, product, sales, share, share_all, index, penetration, rank, cumulative: the metrics of every product in its bucket."""
    own = cut(product_sales(rows), "products")
    everywhere = own.groupBy(*C.PRODUCT).agg(F.sum("sales").alias("sales_all"))
    grand = own.agg(F.sum("sales").alias("grand"))
    out = own.join(everywhere, C.PRODUCT).join(F.broadcast(grand)).join(F.broadcast(stores), "bucket")  # one row; a row for each bucket
    out = ranking.numbered(out, ["bucket"], [F.desc("sales"), *map(F.asc, C.PRODUCT)], "rank", ("sales",))
    out = out.withColumns({"share": share(F.col("sales"), F.col("all_sales")), "cumulative": share(F.col("run_sales"), F.col("all_sales")), "share_all": share(F.col("sales_all"), F.col("grand"))})
    out = out.withColumn("index", F.try_divide(F.col("share"), F.col("share_all")) * 100).withColumn("penetration", share(F.col("stores"), F.col("n_stores")))
    return out.withColumn("product", E.product_name(*[F.col(c) for c in C.PRODUCT])).drop("run_sales", "all_sales", "grand")


def mix(rows: DataFrame, by: str) -> DataFrame:
    """bucket and brand (or pack): sales, share, index, place. Only rows without a `by` are left out."""
    own = rows.where(F.col(by).isNotNull()).groupBy("bucket", by).agg(F.coalesce(F.sum(money(F.col("NET_SALES"))), F.lit(0).cast("decimal(28,4)")).alias("sales"))
    group, everywhere = W.partitionBy("bucket"), own.groupBy(by).agg(F.sum("sales").alias("sales_all"))
    out = own.join(everywhere, by).join(F.broadcast(own.agg(F.sum("sales").alias("grand"))))  # one row
    out = out.withColumns({"share": share(F.col("sales"), F.sum("sales").over(group)), "place": F.row_number().over(group.orderBy(F.desc("sales"), by))})
    return out.select("bucket", by, F.col("sales").cast("double").alias("sales"), "share", (F.try_divide(F.col("share"), share(F.col("sales_all"), F.col("grand"))) * 100).alias("index"), "place")


def skus_per_store(rows: DataFrame) -> DataFrame:
    """bucket, avg_sku: the mean over stores of their rows with sales, one decimal."""
    per = rows.groupBy("bucket", "outlet").agg(F.count("NET_SALES").alias("n"))
    return per.groupBy("bucket").agg(F.bround(F.avg("n"), 1).alias("avg_sku"))


def brand_pack_matrix(listed: DataFrame) -> DataFrame:
    """bucket, brand, pack, n: products by brand and pack, with totals (null) by brand and by bucket."""
    counts = listed.groupBy("bucket", "BRND_NM", "PPG_DESC").agg(F.count("*").alias("n"))
    return counts.rollup("bucket", "BRND_NM", "PPG_DESC").agg(F.sum("n").alias("n")).where("bucket IS NOT NULL")


def top_contribution(listed: DataFrame, ranks: tuple[int, ...] = C.TOP_RANKS) -> DataFrame:
    """bucket, rank, cumulative: the running share at each rank, 0 where there are fewer products."""
    marks = listed.select("bucket").distinct().withColumn("rank", F.explode(F.array(*map(F.lit, ranks))))
    return marks.join(listed.select("bucket", "rank", "cumulative"), ["bucket", "rank"], "left").na.fill(0.0, ["cumulative"])


def heroes(listed: DataFrame, upto: float = 0.50) -> DataFrame:
    """Products marked Hero while the running share is at most `upto`; the one that crosses it is out."""
    hero = F.col("cumulative") <= upto
    return listed.withColumns({"sku_type": F.when(hero, "Hero").otherwise(""), "msl_selection": F.when(hero, "✓").otherwise(""), "reason": F.when(hero, F.lit("Within the first half of sales")).otherwise("")})


def selected(listed: DataFrame, table: DataFrame) -> DataFrame:
    """Products joined with a table of rank, type, criterion and reason, as `textops.selection_table` reads it."""
    out = listed.join(table, ["bucket", "rank"], "left")
    return out.withColumn("msl_selection", F.when(F.col("sku_type").isin("Hero", "Strategic"), "✓").otherwise(""))


def bucket_segments(df: DataFrame, bucket: str = "priority_bucket", top: int = 3) -> DataFrame:
    """bucket, segment_label, n, place: the commonest segments of each bucket."""
    counts = df.where("segment_label IS NOT NULL").groupBy(F.col(bucket).alias("bucket"), "segment_label").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(W.partitionBy("bucket").orderBy(F.desc("n"), "segment_label"))).where(F.col("place") <= top)
