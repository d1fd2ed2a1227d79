"""What the corpus operators share: reading tables, cutting lineage, numbering rows."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a batch between Spark and Python; texts are long, so batches are short.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Gives this package to Python workers that don't have it on their path, and keeps their batches small."""
    context = spark.sparkContext
    if spark.conf.get(BATCH, "10000") == "10000":  # unless a user has set it
        spark.conf.set(BATCH, "1000")
    if getattr(context, "_storelens_shipped", False):
        return
    top = Path(__file__).resolve().parents[2]
    path = Path(tempfile.mkdtemp(prefix="storelens-")) / "storelens.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((top / "storelens").rglob("*.py")):
            z.write(p, p.relative_to(top))
    context.addPyFile(str(path))
    context._storelens_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and all tasks run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="storelens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def keep(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the shared folder and read back: later jobs neither recompute it nor depend on an executor that may be lost."""
    path = f"{shared_dir(df.sparkSession)}/storelens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept = path
    return out


def discard(*kept: DataFrame) -> None:
    """Removes the files of kept tables that nothing will read again."""
    for df in kept:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._kept)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Powers of two: least and most bits of a map of keys.
MAP_BITS = (15, 27)


def perhaps_in(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of df whose keys stand in wanted, and a few others: no join moves the rest. A bitmap of the keys' hashes is broadcast, 8 bits for each key and 16 MB at most, beyond which more others stay."""
    bits = min(MAP_BITS[1], max(MAP_BITS[0], (8 * wanted.count()).bit_length()))
    place, bucket, held = fresh(df, "place", "bucket", "held")
    where = F.xxhash64(*keys).bitwiseAND(F.lit((1 << bits) - 1)) + 1
    maps = wanted.select(where.alias(place)).groupBy(F.bitmap_bucket_number(place).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias(held))
    near = df.withColumn(place, where).withColumn(bucket, F.bitmap_bucket_number(place)).join(F.broadcast(keep(maps, "maps")), bucket)
    at = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(held), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return near.where(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1).select(*[F.col(f"`{c}`") for c in df.columns])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores behind each as make them new to df."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranged(df: DataFrame, *keys: str) -> DataFrame:
    """df in the global order of keys, kept, with `pid` (its part) and `idx` (ascending within a part)."""
    out = df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    return keep(out.withColumns({"pid": F.spark_partition_id(), "idx": F.monotonically_increasing_id()}), "ranged")


def literal_map(pairs: dict) -> F.Column:
    """A map column of a small dict whose size the caller bounds."""
    return F.map_from_arrays(F.array(*map(F.lit, pairs)), F.array(*map(F.lit, pairs.values())))
