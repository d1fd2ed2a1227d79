"""Tables from files: outlets, sales, pack sizes, racks; clean headers and null words; samples; the newest snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.encode import NULL_TOKENS

SALES = T.StructType([*[T.StructField(c, T.StringType()) for c in ("CUST_UNIQ_ID_VAL", "BRND_NM", "SUB_BRND_NM", "FLVR_NM", "PPG_DESC")], T.StructField("NET_SALES", T.DoubleType())])
PACKS = T.StructType([T.StructField("row_no", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("brand", "ppg_raw", "height_cm", "width_cm", "depth_cm")]])


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def null_tokens(df: DataFrame, tokens: tuple[str, ...] = NULL_TOKENS) -> DataFrame:
    """Words for a missing value become null in every text column, in one pass."""
    texts = {c for c, kind in df.dtypes if kind == "string"}
    return df.select(*[F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`")).alias(c) if c in texts else F.col(f"`{c}`") for c in df.columns])


def read(spark: SparkSession, path: str, format: str = "csv", schema: T.StructType | str | None = None) -> DataFrame:  # noqa: A002
    """A CSV (with a header, quoted line breaks), Parquet or JSON table. CSV columns are text unless a schema is given, so ids keep leading zeros."""
    reader = spark.read.schema(schema) if schema else spark.read
    if format == "csv":
        reader = reader.options(header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    return reader.format(format).load(path)


def outlets(spark: SparkSession, path: str, format: str = "csv", schema: T.StructType | None = None) -> DataFrame:  # noqa: A002
    return null_tokens(strip_headers(read(spark, path, format, schema)))


def sku_sales(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:  # noqa: A002
    out = null_tokens(read(spark, path, format, SALES if format == "csv" else None))
    return out.withColumn("CUST_UNIQ_ID_VAL", F.trim(F.col("CUST_UNIQ_ID_VAL").cast("string")))


def systematic_sample(df: DataFrame, size: int, *order: str) -> DataFrame:
    """Every k-th row in an order, k = floor(n / size): at least `size` rows, under twice as many. The rows are numbered part by part, not in one task."""
    n = df.count()
    k = max(1, n // max(1, size))
    if k == 1:
        return df
    from ..plans.lineage import cut

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = cut(dealt.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "sample")
    held = dealt.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("low")).orderBy("__part").collect()  # a row for each part
    shift, before = [], 0
    for r in held:
        shift.append((r["__part"], before - r.low + 1))
        before += r.n
    moved = F.broadcast(df.sparkSession.createDataFrame(shift, "__part int, __shift long"))
    return dealt.join(moved, "__part").where((F.col("__at") + F.col("__shift")) % k == 0).select(*[F.col(f"`{c}`") for c in df.columns])


def latest(spark: SparkSession, folder: str, pattern: str, format: str = "csv") -> DataFrame:  # noqa: A002
    """The newest file of a name pattern under a folder, by the time of its last change; ties by path."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=pattern).load(folder).select("path", "modificationTime")
    newest = files.orderBy(F.desc("modificationTime"), "path").limit(1).collect()
    if not newest:
        raise FileNotFoundError(f"no {pattern} under {folder}")
    return read(spark, newest[0].path, format)
