"""Distinct counts by sketches that merge: small ones of the finest groups are kept, and any roll-up is a union of them.

HyperLogLog with 2^lg_k registers. The relative standard error is 1.04 / sqrt(2^lg_k) at most; `error` is four of these, which
holds for all but one in some ten thousand estimates, and is told with every count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C

LG_K = 12


def error(estimate: Column, lg_k: int = LG_K) -> Column:
    return estimate * F.lit(4 * 1.04 / 2 ** (lg_k / 2))


def sketched(df: DataFrame, by: list[str], column: str, lg_k: int = LG_K) -> DataFrame:
    """by, sketch of the distinct values of a column (as text; null isn't one)."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(F.col(f"`{column}`").cast("string"), F.lit(lg_k)).alias("sketch"))


def rolled_up(sketches: DataFrame, over: list[str], by: list[str]) -> DataFrame:
    """Sketches of groups -> of these, and of all unions over the columns of `over` (null there), apart by the columns of `by`; no row is read again."""
    out = sketches.cube(*over, *by).agg(F.hll_union_agg("sketch", F.lit(True)).alias("sketch"), F.grouping_id().alias("__level"))
    return out.where(F.col("__level").bitwiseAND(F.lit((1 << len(by)) - 1)) == 0).drop("__level")


def counted(sketches: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """The sketches' counts (near) with their error in place of the sketches."""
    near = F.hll_sketch_estimate("sketch")
    return sketches.withColumns({"near": near, "error": error(near, lg_k)}).drop("sketch")


def duplicate_ids(df: DataFrame, id_col: str = C.OUTLET_ID, lg_k: int = LG_K) -> DataFrame:
    """One row: rows less distinct ids by sketch (near), null ids count as duplicates; and its error."""
    distinct = F.hll_sketch_estimate(F.hll_sketch_agg(F.col(f"`{id_col}`").cast("string"), F.lit(lg_k)))
    return df.agg(F.count("*").alias("n"), distinct.alias("ids")).select((F.col("n") - F.col("ids")).alias("near"), error(F.col("ids"), lg_k).alias("error"))
