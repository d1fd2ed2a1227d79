"""Exact ranks over all rows, or within a few large groups, without a task that holds them all.

Equal values are counted first, so no tie crosses a partition. The distinct values are dealt out by range and
numbered within each part; the parts' totals, one row for each part and group, give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.lineage import cut


def positions(df: DataFrame, value: Column, groups: list[str] | None = None, descending: bool = False) -> DataFrame:
    """df -> groups, v (distinct), ahead (rows before), ties (rows at v), total (rows of the group)."""
    groups = groups or []
    order = F.desc("v") if descending else F.asc("v")
    counts = df.select(*groups, value.alias("v")).groupBy(*groups, "v").agg(F.count("*").alias("ties"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(counts.repartitionByRange(n, *groups, order).withColumn("part", F.spark_partition_id()), "ranked")
    sums = rows.groupBy(*groups, "part").agg(F.sum("ties").alias("here"))
    whole = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    sums = sums.withColumns({"before": F.sum("here").over(whole.orderBy("part")) - F.col("here"), "total": F.sum("here").over(whole)}).drop("here")
    running = F.sum("ties").over(W.partitionBy(*groups, "part").orderBy(order)) - F.col("ties")
    sums = sums.withColumnsRenamed({g: f"__of_{k}" for k, g in enumerate(groups)} | {"part": "__p"})
    same = F.col("part") == F.col("__p")
    for k, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"__of_{k}"))
    return rows.withColumn("run", running).join(F.broadcast(sums), same).select(*groups, "v", (F.col("before") + F.col("run")).alias("ahead"), "ties", "total")


def dealt(df: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """df in the order of groups, then order, over all parts, and kept; with __part, and __i ascending within a part."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartitionByRange(n, *groups, *order).sortWithinPartitions(*groups, *order)
    return cut(out.withColumns({"__part": F.spark_partition_id(), "__i": F.monotonically_increasing_id()}), "dealt")


def numbered(df: DataFrame, groups: list[str], order: list[Column], out: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """df with its place (from 1) in the order within a group; and for each of `sums` a running sum (run_) and the group's sum (all_).

    The order is one without ties. Rows are dealt by range; a part's counts and sums, one row for each part and group in
    it, give the offsets of the next.
    """
    rows = dealt(df, groups, order)
    here = rows.groupBy(*groups, "__part").agg(F.count("*").alias("__sum_"), *[F.sum(c).alias(f"__sum_{c}") for c in sums])
    whole = W.partitionBy(*groups)
    before = {f"__before_{c}": F.sum(f"__sum_{c}").over(whole.orderBy("__part")) - F.col(f"__sum_{c}") for c in ("", *sums)}
    here = here.withColumns(before | {f"all_{c}": F.sum(f"__sum_{c}").over(whole) for c in sums}).drop(*[f"__sum_{c}" for c in ("", *sums)])
    here = here.withColumnsRenamed({g: f"__of_{k}" for k, g in enumerate(groups)} | {"__part": "__p"})
    within = W.partitionBy(*groups, "__part").orderBy("__i")
    same = F.col("__part") == F.col("__p")
    for k, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"__of_{k}"))
    rows = rows.withColumns({out: F.row_number().over(within)} | {f"run_{c}": F.sum(c).over(within.rowsBetween(W.unboundedPreceding, 0)) for c in sums}).join(F.broadcast(here), same)  # parts and a few large groups
    rows = rows.withColumns({out: (F.col(out) + F.col("__before_")).cast("int")} | {f"run_{c}": F.col(f"run_{c}") + F.col(f"__before_{c}") for c in sums})
    return rows.drop("__part", "__i", "__p", *before, *[f"__of_{k}" for k in range(len(groups))])


def first_of(df: DataFrame, group: str, order: list[tuple[str, bool]], most: int, out: str = "place") -> DataFrame:
    """The first `most` rows of each group, with their place; `order` names columns and whether they fall, nulls are last.

    Only the columns of the order are numbered over all rows, by range. The key at place `most`, one row for each
    group, is broadcast; rows behind it go where they are read, and what is left is numbered in turn. So no
    task holds a group, and rows that aren't wanted aren't moved. df is read twice.
    """
    by = [F.desc_nulls_last(c) if falling else F.asc_nulls_last(c) for c, falling in order]
    keys = numbered(df.select(group, *[c for c, _ in order if c != group]), [group], by, "__at").where(F.col("__at") == most)
    ends = keys.select(F.col(group).alias("__g"), F.lit(True).alias("__cut"), *[F.col(c).alias(f"__end_{k}") for k, (c, _) in enumerate(order)])
    ahead, level = F.lit(False), F.lit(True)
    for k, (c, falling) in enumerate(order):
        a, b = F.col(c), F.col(f"__end_{k}")
        ahead |= level & a.isNotNull() & (b.isNull() | (a > b if falling else a < b))
        level &= a.eqNullSafe(b)
    near = df.join(F.broadcast(ends), F.col(group).eqNullSafe(F.col("__g")), "left").where(F.col("__cut").isNull() | ahead | level)
    return numbered(near.drop(*ends.columns), [group], by, out).where(F.col(out) <= most)


def filled_down(df: DataFrame, column: str, order: str) -> DataFrame:
    """df with the nulls of a column replaced by the last value above, in the order of another column."""
    rows = dealt(df, [], [F.asc(order)])
    above = W.partitionBy("__part").orderBy("__i").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__own", F.last(column, True).over(above))
    ends = rows.groupBy("__part").agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col("__i"))).alias("__end"))  # a row for each part
    ends = ends.withColumn("__above", F.last("__end", True).over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))).drop("__end")
    return rows.join(F.broadcast(ends), "__part", "left").withColumn(column, F.coalesce("__own", "__above")).drop("__own", "__above", "__part", "__i")


def quantiles(df: DataFrame, value: str, shares: dict[str, float], groups: list[str] | None = None) -> DataFrame:
    """groups, and for each name the exact quantile at that share of the known values, linear between two; no task holds them all."""
    groups = groups or []
    at = positions(df.where(F.col(value).isNotNull()), F.col(value).cast("double"), groups)

    def found(share: float) -> Column:
        place = (F.col("total") - 1) * F.lit(float(share))
        here = lambda i: F.max(F.when((F.col("ahead") <= i) & (i < F.col("ahead") + F.col("ties")), F.col("v")))
        low, high = here(F.floor(place)), here(F.ceil(place))
        return low + (high - low) * F.max(place - F.floor(place))

    return at.groupBy(*groups).agg(*[found(x).alias(name) for name, x in shares.items()])


def percentile(df: DataFrame, column: str, out: str, missing: float = 0.0) -> DataFrame:
    """df with the average-rank percentile (0 to 100, unrounded) of a column; null counts as `missing`."""
    value, df = F.coalesce(F.col(column), F.lit(missing)), cut(df, "to-rank")  # it is read twice
    at = positions(df, value)
    share = ((F.col("ahead") + F.col("ties")) - (F.col("ties") - 1) / 2) / F.col("total") * 100
    at = at.select(F.col("v").alias("__v"), share.alias(out))
    return df.withColumn("__v", value).join(at, "__v").drop("__v")


def rank_within(df: DataFrame, group: str, column: str, out: str) -> DataFrame:
    """df with the rank by a column, largest first, within a group; ties share the smallest rank, null comes last."""
    df = cut(df, "to-rank")  # it is read twice
    at = positions(df, F.col(column), [group], descending=True)
    at = at.select(F.col(group).alias("__g"), F.col("v").alias("__v"), (F.col("ahead") + 1).alias(out))
    return df.join(at, F.col(group).eqNullSafe(F.col("__g")) & F.col(column).eqNullSafe(F.col("__v"))).drop("__g", "__v")
