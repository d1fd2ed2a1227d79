"""Whole numbers from weights: a pool dealt out in full, first what each must have, the rest by largest remainders.

All quotas are exact, in integers. Which remainders are large enough is found by range: rows are dealt by remainder and
numbered by the counts of the parts, so no task holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranking

WHOLE = "decimal(38,0)"


def apportioned(df: DataFrame, groups: list[str], pool: str, weight: str, order: list[Column], least: int = 1, out: str = "facings") -> DataFrame:
    """df with `out`: shares of a group's pool (a whole number, the same in all its rows) that add up to it exactly.

    In the given order, which has no ties, each row gets `least` while that lasts. The rest is dealt by weight (whole,
    not negative; null is 0; a group without weights deals evenly): the whole parts of all quotas, then one more for
    the largest remainders, ties in the given order. Only in a group whose pool is under 1 does nobody get any.
    """
    own = df.withColumns({"__w": F.coalesce(F.col(weight).cast("decimal(28,0)"), F.lit(0).cast("decimal(28,0)")), "__one": F.lit(1).cast("decimal(10,0)")})
    own = ranking.numbered(own, groups, order, "__place", ("__w", "__one"))
    n, have = F.col("all___one").cast("long"), F.greatest(F.col(pool).cast("long"), F.lit(0).cast("long"))
    served = F.least(n, F.floor(have / least)) if least else F.lit(0).cast("long")
    even = F.col("all___w") == 0
    own = own.withColumns({
        "__first": F.when(F.col("__place") <= served, least).otherwise(0).cast("long"), "__rest": (have - served * least).cast("decimal(18,0)"),
        "__w": F.when(even, F.lit(1)).otherwise(F.col("__w")).cast("decimal(28,0)"), "__all": F.when(even, F.col("all___one")).otherwise(F.col("all___w")).cast("decimal(28,0)"),
    }).drop("run___w", "run___one", "all___w", "all___one")
    product = (F.col("__rest") * F.col("__w")).cast(WHOLE)
    left = (product % F.col("__all").cast(WHOLE)).cast("decimal(28,0)")
    own = own.withColumns({"__left": left, "__part": ((product - left) / F.col("__all")).cast("long")}).withColumnRenamed("__part", "__quota")
    own = ranking.numbered(own, groups, [F.desc("__left"), F.asc("__place")], "__at", ("__left",))
    more = F.col("__at") <= (F.col("all___left") / F.col("__all")).cast("long")  # the remainders add up to whole ones
    own = own.withColumn(out, (F.col("__first") + F.col("__quota") + more.cast("long")).cast("long"))
    return own.drop("__w", "__one", "__place", "__first", "__rest", "__all", "__left", "__quota", "__at", "run___left", "all___left")
