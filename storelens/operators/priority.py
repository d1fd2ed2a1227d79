"""Revenue tiers, potential, gaps and the summaries by tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import config as C
from ..functions import encode as E
from . import ranking


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def bucket(percentile: Column) -> Column:
    return F.when(percentile > 80, "A").when(percentile > 60, "B").when(percentile > 30, "C").otherwise("D")


def prioritised(df: DataFrame, value: str = C.VALUE) -> DataFrame:
    """df with vpo_percentile (two decimals) and priority_bucket, which goes by the percentile before rounding."""
    out = ranking.percentile(df, value, "__p")
    return out.withColumns({"vpo_percentile": F.bround("__p", 2), "priority_bucket": bucket(F.col("__p"))}).drop("__p")


def shares(df: DataFrame, column: str, places: int = 1) -> DataFrame:
    """value, n, pct of all rows."""
    counts = df.groupBy(col(column).alias(column)).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(whole)).select(column, "n", F.bround(F.col("n") * 100.0 / F.col("total"), places).alias("pct"))


def coverage(df: DataFrame, candidates: list[str], least: float = C.LEAST_COVERAGE) -> DataFrame:
    """feature, filled (share of rows with a value), kept."""
    names = [c for c in dict.fromkeys(candidates) if c in df.columns]
    share = df.agg(*[F.try_divide(F.count(col(c)) * 1.0, F.count("*")).cast("double").alias(c) for c in names])
    return share.unpivot([], [col(c) for c in names], "feature", "filled").withColumn("kept", F.coalesce(F.col("filled") >= least, F.lit(False)))


def select_features(df: DataFrame, candidates: list[str], least: float = C.LEAST_COVERAGE, at_least: int = 2) -> list[str]:
    """The features with enough values, in the order given; too few is an error."""
    kept = {r.feature for r in coverage(df, candidates, least).where("kept").collect()}
    out = [c for c in dict.fromkeys(candidates) if c in kept]
    if len(out) < at_least:
        raise ValueError(f"only {len(out)} features have enough values; {at_least} are needed")
    return out


def coerced(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: E.numeric(col(c)) for c in columns})


def coercion_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, lost: values that are no number."""
    lost = [F.count_if(col(c).isNotNull() & E.numeric(col(c)).isNull()).alias(c) for c in columns]
    return df.agg(*lost).unpivot([], [col(c) for c in columns], "column", "lost")


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """The exact median of each column that has a value: all columns in one job, by range."""
    long = df.unpivot([], [col(c).cast("double").alias(c) for c in columns], "column", "value")
    return {r.column: r.mid for r in ranking.quantiles(long, "value", {"mid": 0.5}, ["column"]).collect()}


def centres(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float, float]]:
    """Median, and mean and population deviation after nulls became the median, of each column that has a value; two passes."""
    mid = medians(df, columns)
    known = [c for c in columns if c in mid]
    if not known:
        return {}
    filled = {c: F.coalesce(col(c), F.lit(mid[c])) for c in known}
    row = df.agg(*[f(filled[c]).alias(f"{n}_{k}") for k, c in enumerate(known) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (mid[c], row[f"m_{k}"], row[f"s_{k}"]) for k, c in enumerate(known)}


def imputed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls become the column's exact median; a column without values goes."""
    mid = medians(df, columns)
    gone = [c for c in columns if c not in mid]
    return df.withColumns({c: F.coalesce(col(c), F.lit(mid[c])) for c in columns if c not in gone}).drop(*gone)


def standardised(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """df with z_<column>: imputed, less the mean, over the population deviation (1 if that is 0); and the new names."""
    found = centres(df, columns)
    out = df.withColumns({f"z_{c}": (F.coalesce(col(c), F.lit(mid)) - mean) / (dev or 1.0) for c, (mid, mean, dev) in found.items()})
    return out, [f"z_{c}" for c in found]


def gaps(df: DataFrame, predicted: str = "predicted_raw", value: str = C.VALUE) -> DataFrame:
    """df with the rounded prediction, the gap, its share, the upside flag and the priority tag."""
    out = df.withColumn("opportunity_gap", E.rounded(col(predicted) - F.coalesce(col(value), F.lit(0.0)), 2)).withColumn("predicted_potential_vpo", E.rounded(col(predicted), 2))
    pct = E.rounded(F.col("opportunity_gap") / F.nullif(F.col("predicted_potential_vpo"), F.lit(0.0)) * 100, 1)
    up = F.col("opportunity_gap") > 0
    return out.withColumns({"gap_pct_of_potential": pct, "has_upside": up, "priority": F.when(up, F.concat("priority_bucket", F.lit("+"))).otherwise(F.col("priority_bucket"))})


def gap_ranked(df: DataFrame) -> DataFrame:
    return ranking.rank_within(df, "priority_bucket", "opportunity_gap", "gap_rank_within_bucket")


def mean(name: str, places: int) -> Column:
    return F.bround(F.avg(col(name).cast("decimal(18,4)")).cast("double"), places)


def tier_summary(df: DataFrame) -> DataFrame:
    """For each tier there is: place in the fixed order, count, percent, mean of value, prediction and gap."""
    order = F.create_map(*(F.lit(x) for k, t in enumerate(C.TIERS) for x in (t, k)))
    out = df.groupBy("priority").agg(F.count("*").alias("n"), mean("VPO", 0).alias("avg_vpo"), mean("predicted_potential_vpo", 0).alias("avg_predicted"), mean("opportunity_gap", 0).alias("avg_gap"))
    whole = out.agg(F.sum("n").alias("total"))
    return out.join(F.broadcast(whole)).select("priority", order[F.col("priority")].alias("place"), "n", F.bround(F.col("n") * 100.0 / F.col("total"), 1).alias("pct"), "avg_vpo", "avg_predicted", "avg_gap")


def tier_modes(df: DataFrame, columns: list[str], group: str = "priority") -> DataFrame:
    """group, column, value: the commonest value of each column, ties by name."""
    names = [c for c in columns if c in df.columns]
    counts = df.unpivot([group], [col(c) for c in names], "column", "value").where("value IS NOT NULL").groupBy(group, "column", "value").agg(F.count("*").alias("n"))
    first = F.row_number().over(W.partitionBy(group, "column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("__n", first).where("__n = 1").select(group, "column", "value", "n")


def driver_correlation(df: DataFrame, features: list[str], value: str = C.VALUE, top: int = 5) -> DataFrame:
    """feature, r: Pearson correlation with the value over rows complete in all features, the largest by size. Constant columns have none."""
    rows = df.select(col(value).alias("__y"), *[col(c) for c in features]).dropna()

    def r(c: str) -> Column:
        x, y = col(c).cast("double"), F.col("__y").cast("double")
        varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))  # the merged deviation of a constant needn't be 0: n * (1 / n) isn't always 1
        return F.when(varies, F.bround(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), 4)).alias(c)  # all three from centred moments, which merge

    found = rows.agg(*[r(c) for c in features]).unpivot([], [col(c) for c in features], "feature", "r").where("r IS NOT NULL")
    return found.orderBy(F.desc(F.abs("r")), "feature").limit(top)
