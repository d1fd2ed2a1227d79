"""Seven checks of an outlet table, a verdict, and a summary. What can be counted in one pass is counted in one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import config as C
from ..functions import encode as E


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def rounded(c: Column, places: int) -> Column:
    return F.bround(c.cast("double"), places)


def missing_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """One row: the check, whether it passes, the missing names in order."""
    missing = [c for c in required if c not in df.columns]
    return df.sparkSession.createDataFrame([("required_columns", not missing, ", ".join(missing))], "check string, pass boolean, missing string")


def null_percent(df: DataFrame, limit: float = C.NULL_PERCENT) -> DataFrame:
    """column, null_pct (one decimal), flagged (its rounded share is over the limit)."""
    share = [rounded(F.try_divide(F.count_if(col(c).isNull()) * 100.0, F.count("*")), 1).alias(c) for c in df.columns]
    long = df.agg(*share).unpivot([], [col(c) for c in df.columns], "column", "null_pct")
    return long.withColumn("flagged", F.coalesce(F.col("null_pct") > limit, F.lit(False)))


def duplicate_ids(df: DataFrame, id_col: str = C.OUTLET_ID) -> DataFrame:
    """rows less distinct ids; null ids count as duplicates. Passes if there are none, or no such column."""
    if id_col not in df.columns:
        return df.sparkSession.createDataFrame([(0, True)], "duplicates long, pass boolean")
    n = F.count("*") - F.count_distinct(col(id_col))
    return df.agg(n.alias("duplicates")).withColumn("pass", F.col("duplicates") == 0)


def outliers(df: DataFrame, value: str = C.VALUE, times: float = C.OUTLIER_TIMES) -> DataFrame:
    """Rows over `times` the mean of the known values: their number, share in percent, and whether that is under 1."""
    mean = df.agg(F.avg(col(value).cast("decimal(18,4)")).cast("double").alias("mean"))
    out = df.select(value).join(F.broadcast(mean))  # one row
    found = out.agg(F.count_if(col(value) > F.col("mean") * times).alias("outliers"), F.count("*").alias("n"))
    found = found.withColumn("pct", F.coalesce(rounded(F.try_divide(F.col("outliers") * 100.0, F.col("n")), 2), F.lit(0.0)))
    return found.select("outliers", "pct", (F.col("pct") < 1.0).alias("pass"))


def negatives(df: DataFrame, keywords: list[str]) -> DataFrame:
    """column, negatives: for columns whose capitals hold a keyword; text counts as the number that it is. No keyword: nothing is checked."""
    names = [c for c, kind in df.dtypes if any(k in c.upper() for k in keywords)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, negatives long")
    return df.agg(*[F.count_if(number(df, c) < 0).alias(c) for c in names]).unpivot([], [col(c) for c in names], "column", "negatives")


def number(df: DataFrame, name: str) -> Column:
    return E.numeric(col(name)) if dict(df.dtypes)[name] == "string" else col(name).try_cast("double")


def zero_share(df: DataFrame, value: str = C.VALUE) -> DataFrame:
    """Rows whose value is 0 or null: number, percent, and whether that is under 5."""
    out = df.agg(F.count_if(F.coalesce(col(value), F.lit(0.0)) == 0).alias("zeros"), F.count("*").alias("n"))
    out = out.withColumn("pct", F.coalesce(rounded(F.try_divide(F.col("zeros") * 100.0, F.col("n")), 2), F.lit(0.0)))
    return out.select("zeros", "pct", (F.col("pct") < 5.0).alias("pass"))


def coverage(df: DataFrame, columns: list[str] | None = None, top: int = 5) -> DataFrame:
    """column, value, n, place: the commonest values, ties by name."""
    names = [c for c in (columns or C.COVERAGE_COLUMNS) if c in df.columns]
    counts = df.unpivot([], [col(c) for c in names], "column", "value").where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= top)


def report(df: DataFrame, required: list[str], keywords: list[str] | None = None, value: str = C.VALUE, id_col: str = C.OUTLET_ID) -> DataFrame:
    """check, pass, position: all seven in their order. Two passes: one for all counts and the mean, one for the rows far over it."""
    names = [c for c in df.columns if any(k in c.upper() for k in keywords or [])]
    share = lambda n: F.coalesce(rounded(F.try_divide(n * 100.0, F.col("__rows")), 2), F.lit(0.0))
    counts = [F.count("*").alias("__rows"), *[F.count(col(c)).alias(f"__known_{k}") for k, c in enumerate(df.columns)]]
    counts += [F.count_distinct(col(id_col)).alias("__ids")] if id_col in df.columns else []
    counts += [F.count_if(number(df, c) < 0).alias(f"__low_{k}") for k, c in enumerate(names)]
    counts += [F.avg(col(value).cast("decimal(18,4)")).cast("double").alias("__mean"), F.count_if(F.coalesce(col(value), F.lit(0.0)) == 0).alias("__zeros")]
    found = df.agg(*counts)
    far = df.select(col(value).alias("__v")).join(F.broadcast(found.select(F.col("__mean").alias("__m")))).agg(F.count_if(F.col("__v") > F.col("__m") * C.OUTLIER_TIMES).alias("__far"))  # one row
    empty = [rounded(F.try_divide((F.col("__rows") - F.col(f"__known_{k}")) * 100.0, F.col("__rows")), 1) <= C.NULL_PERCENT for k in range(len(df.columns))]
    passes = {
        "required_columns": F.lit(all(c in df.columns for c in required)),
        "null_pct": F.forall(F.array(*[F.coalesce(x, F.lit(True)) for x in empty]), lambda x: x),
        "duplicate_ids": (F.col("__rows") == F.col("__ids")) if id_col in df.columns else F.lit(True),
        "vpo_outliers": share(F.col("__far")) < 1.0,
        "negative_sku": sum((F.col(f"__low_{k}") for k in range(len(names))), F.lit(0)) == 0,
        "zero_vpo": share(F.col("__zeros")) < 5.0,
        "coverage": F.lit(True),
    }
    lines = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(n).alias("check"), c.alias("pass")) for k, (n, c) in enumerate(passes.items())])
    return found.join(F.broadcast(far)).select(F.inline(lines))  # one row


def verdict(checks: DataFrame) -> DataFrame:
    """One row: whether all checks pass, and a line for each."""
    line = F.format_string("- %s: %s", F.col("check"), F.when(F.col("pass"), "PASS").otherwise("FAIL"))
    out = checks.agg(F.bool_and("pass").alias("passed"), F.sort_array(F.collect_list(F.struct("position", line.alias("line")))).alias("lines"))  # seven
    return out.select("passed", F.array_join(F.col("lines.line"), "\n").alias("text"))


def summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, columns, and which of the key columns there are."""
    have = ", ".join(k for k in keys if k in df.columns)
    return df.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), F.lit(have).alias("key_columns"))
