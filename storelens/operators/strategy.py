"""The strategic score of products, and facings dealt by it: classes of products, their weights, a pool for innovation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import apportion, ranking

# The score's inputs and weights, and the multipliers of a facing's weight, in percent.
WEIGHTS = {
    "contribution_pct": 0.30, "store_penetration_pct": 0.15, "velocity": 0.15, "margin_pct": 0.15,
    "shopper_relevance_score": 0.10, "pack_price_architecture_score": 0.10, "innovation_or_priority_score": 0.05,
}
SHOPPER = {"strong_fit": 125, "neutral": 100, "weak": 75}
COMMERCIAL = {"Hero": 130, "Strategic": 110, "Innovation": 100, "Tail": 100}
INNOVATION_SHARE = 0.10


def strategic_score(df: DataFrame, weights: dict[str, float] | None = None, group: str = "bucket", low: float = 0.05, high: float = 0.95) -> DataFrame:
    """df with `strategic_score` (0 to 1) and `inputs_used`: the weighted mean of its inputs, each scaled robustly within its group.

    An input is 0 at its group's `low` quantile and under, 1 at the `high` one and over, and linear between; 0.5 where the two
    are equal. An input that a row, or the table, doesn't have gives its weight to the others in proportion. A row
    without inputs has no score. Quantiles are exact and counted by range, all inputs and groups together.
    """
    have = {c: w for c, w in (weights or WEIGHTS).items() if c in df.columns}
    if not have:
        return df.withColumns({"strategic_score": F.lit(None).cast("double"), "inputs_used": F.lit(0)})
    long = df.unpivot([group], [F.col(c).cast("double").alias(c) for c in have], "input", "value")
    ends = ranking.quantiles(long, "value", {"lo": low, "hi": high}, [group, "input"])
    ends = ends.groupBy(F.col(group).alias("__g")).agg(F.map_from_entries(F.collect_list(F.struct("input", F.struct("lo", "hi")))).alias("__ends"))  # a row for each group, an entry for each input
    out = df.join(F.broadcast(ends), F.col(group).eqNullSafe(F.col("__g")), "left")

    def scaled(c: str) -> Column:
        lo, hi, x = F.col("__ends")[c]["lo"], F.col("__ends")[c]["hi"], F.col(c).cast("double")
        return F.when(hi > lo, F.least(F.greatest((x - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).when(x.isNotNull(), 0.5)

    parts = {c: F.when(F.col(c).isNotNull(), F.lit(w) * scaled(c)) for c, w in have.items()}
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts.values()), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in have.items()), F.lit(0.0))
    used = sum((F.col(c).isNotNull().cast("int") for c in have), F.lit(0))
    return out.withColumns({"strategic_score": F.try_divide(total, weight), "inputs_used": used}).drop("__g", "__ends")


def classified(df: DataFrame, innovation: Column, strategic: float = 0.5) -> DataFrame:
    """df with sku_class: Hero within the first half of sales, Strategic from a score on, Innovation where flagged, else Tail."""
    kind = F.when(F.col("cumulative") <= 0.5, "Hero").when(F.col("strategic_score") >= strategic, "Strategic").when(innovation, "Innovation").otherwise("Tail")
    return df.withColumn("sku_class", kind)


def facing_pool(df: DataFrame, racks: int = 1) -> DataFrame:
    """bucket, total: the facings of mean width that the shelves of so many racks hold, of products whose packs have a size and fit."""
    fits = F.col("cap").isNotNull()
    mean = F.avg(F.when(fits, F.col("w").cast("decimal(18,4)"))).cast("double")
    per = F.coalesce(F.floor(F.try_divide(F.first("usable"), mean)), F.lit(0)).cast("long") * F.first("n_shelves") * racks
    return df.groupBy("bucket").agg(per.cast("long").alias("total"), F.count_if(fits & (F.col("sku_class") == "Innovation")).alias("n_new"), F.count_if(fits & (F.col("sku_class") != "Innovation")).alias("n_core"))


def weighted_facings(df: DataFrame, racks: int = 1, innovation_share: float = INNOVATION_SHARE) -> DataFrame:
    """Classified products in a rack (as `space.facings` puts them) with `pool` (core or innovation), `pool_facings` and `weighted`, their facings.

    A share of the facings is kept for innovation, and the rest is the core's; a pool that has no product goes to
    the other. Each product has one facing while there are some, by class, then rank; the rest go by sales, times
    the multipliers of class and shopper fit (`fit`, neutral if it has none). Products whose packs have no size or don't fit get none.
    """
    pools = facing_pool(df, racks)
    new = F.when(F.col("n_new") == 0, 0).when(F.col("n_core") == 0, F.col("total")).otherwise(F.bround(F.col("total") * innovation_share, 0)).cast("long")
    out = df.join(F.broadcast(pools.withColumn("new", new)), "bucket")  # a row for each tier
    is_new = F.col("sku_class") == "Innovation"
    out = out.withColumns({"pool": F.when(is_new, "innovation").otherwise("core"), "pool_facings": F.when(is_new, F.col("new")).otherwise(F.col("total") - F.col("new"))})
    of = lambda table, c, other: F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[c], F.lit(other))
    weight = F.col("sales").cast("decimal(18,4)") * 10_000 * of(COMMERCIAL, F.col("sku_class"), 100) * (of(SHOPPER, F.col("fit"), 100) if "fit" in df.columns else F.lit(100))
    place = F.array_position(F.array(*map(F.lit, COMMERCIAL)), F.col("sku_class"))
    out = out.withColumns({"__weight": F.greatest(weight, F.lit(0)).cast("decimal(28,0)"), "__class": place}).drop("total", "n_new", "n_core", "new")
    fits = F.col("cap").isNotNull()
    dealt = apportion.apportioned(out.where(fits), ["bucket", "pool"], "pool_facings", "__weight", [F.asc("__class"), F.asc("rank")], out="weighted")
    none = out.where(~fits).withColumn("weighted", F.lit(0).cast("long"))
    return dealt.unionByName(none).drop("__weight", "__class")
