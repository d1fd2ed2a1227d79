"""Recency, frequency and monetary value of outlets from dated transactions, kept up to date batch by batch.

What is kept of an outlet is first and last date, count and sum, which merge; so a new batch is rolled up by itself and
history isn't read again. A state is a folder: each batch is a part of its own, named by the batch, and a manifest
lists the parts that count. A part is written first and the manifest after it, so a batch that fails half-way changes
nothing, and one that is given again is passed over. `compact` merges all parts into one.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranking
from .rollup import money

MERGED = {"first_date": F.min, "last_date": F.max, "frequency": F.sum, "monetary": F.sum}


def rolled_up(sales: DataFrame, id_col: str, date_col: str, value_col: str) -> DataFrame:
    """id, first_date, last_date, frequency (rows), monetary (decimal, 0 where all are null). Rows without an id or a date are left out."""
    own = sales.select(F.trim(F.col(id_col).cast("string")).alias("id"), F.col(date_col).cast("date").alias("d"), money(F.col(value_col)).alias("v")).dropna(subset=["id", "d"])
    value = F.coalesce(F.sum("v"), F.lit(0)).cast("decimal(28,4)")
    return own.groupBy("id").agg(F.min("d").alias("first_date"), F.max("d").alias("last_date"), F.count("*").alias("frequency"), value.alias("monetary"))


def merged(parts: DataFrame) -> DataFrame:
    """Roll-ups of disjoint sets of rows -> the roll-up of all."""
    return parts.groupBy("id").agg(*[f(c).cast(kind).alias(c) for (c, f), kind in zip(MERGED.items(), ("date", "date", "long", "decimal(28,4)"))])


SCHEMA = "id string, first_date date, last_date date, frequency long, monetary decimal(28,4)"


def _manifests(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the manifests that were written to their end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(x.getPath().getParent().getName()) for x in found or [])


def _parts(spark: SparkSession, folder: str) -> tuple[int, list[tuple[str, str]]]:
    """The newest manifest: its number (0: none), and batch and part of each batch that counts."""
    numbers = _manifests(spark, folder)
    if not numbers:
        return 0, []
    rows = spark.read.schema("batch string, part string").parquet(f"{folder}/manifest/{numbers[-1]}").collect()  # a row for each batch
    return numbers[-1], sorted((r.batch, r.part) for r in rows)


def _commit(spark: SparkSession, folder: str, number: int, parts: list[tuple[str, str]]) -> None:
    spark.createDataFrame(parts, "batch string, part string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/{number}")


def append(sales: DataFrame, folder: str, batch: str, id_col: str, date_col: str, value_col: str) -> bool:
    """Adds a batch of transactions to the state in a folder; False, and nothing is read, if that batch counts already. One writer at a time."""
    spark = sales.sparkSession
    number, parts = _parts(spark, folder)
    if any(b == batch for b, _ in parts):
        return False
    part = f"batch-{quote(batch, safe='')}"
    rolled_up(sales, id_col, date_col, value_col).write.mode("overwrite").parquet(f"{folder}/parts/{part}")
    _commit(spark, folder, number + 1, [*parts, (batch, part)])
    return True


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The roll-up of all batches of a state; no rows where there are none."""
    parts = sorted({p for _, p in _parts(spark, folder)[1]})
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    return merged(spark.read.schema(SCHEMA).parquet(*[f"{folder}/parts/{p}" for p in parts]))


def compact(spark: SparkSession, folder: str) -> None:
    """One part in place of all; the old ones stay until nothing reads them."""
    number, parts = _parts(spark, folder)
    if len({p for _, p in parts}) > 1:
        part = f"all-{number + 1}"
        current(spark, folder).write.mode("overwrite").parquet(f"{folder}/parts/{part}")
        _commit(spark, folder, number + 1, [(b, part) for b, _ in parts])


def scored(state: DataFrame, as_of: Column, classes: int = 5) -> DataFrame:
    """A state (kept) -> id, recency (days from the last date to `as_of`), frequency, monetary, and r, f, m: the class of each, `classes` for the best, equal values alike.

    The class of a value is its share of rows with a lesser one, in so many equal steps; counted by range.
    """
    out = state.select("id", F.datediff(as_of, "last_date").alias("recency"), "frequency", "monetary")
    for name, column, falling in (("r", "recency", True), ("f", "frequency", False), ("m", "monetary", False)):
        at = ranking.positions(out, F.col(column), descending=falling)
        step = (F.floor(F.col("ahead") * classes / F.col("total")) + 1).cast("int")
        out = out.join(at.select(F.col("v").alias(f"__{name}"), step.alias(name)), F.col(column) == F.col(f"__{name}")).drop(f"__{name}")
    return out
