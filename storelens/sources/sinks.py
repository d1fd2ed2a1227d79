"""Results as files: all segments, a folder for each segment, report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encode import safe_name


def all_segments(df: DataFrame, path: str, format: str = "csv") -> None:  # noqa: A002
    df.write.mode("overwrite").option("header", True).format(format).save(path)


def per_segment(df: DataFrame, path: str, format: str = "csv") -> None:  # noqa: A002
    """A folder for each cluster, named by its number and the label as a file name."""
    name = F.concat_ws("_", F.lit("segment"), F.col("cluster").cast("string"), safe_name(F.col("segment_label")))
    df.withColumn("segment", name).write.mode("overwrite").option("header", True).partitionBy("segment").format(format).save(path)


def report_tables(tables: dict[str, DataFrame], folder: str, run_id: str, format: str = "parquet") -> None:  # noqa: A002
    """Each table under folder/run_id/name; a run that is repeated replaces its own tables."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).format(format).save(f"{folder}/{run_id}/{name}")
