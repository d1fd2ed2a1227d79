"""Runs of a watched folder that count: a record for each batch, written after its last table.

The tables of a batch go to folder/tables/<name>/batch=<id>/attempt=<key>, under a key that is new at each attempt. Only
then is folder/commits/<id>.json renamed into place, with the batch, the attempt, its files and its tables. Readers
take the attempts that a record names, so a run that ends half-way is never seen, and the attempt after it, under
the same batch id, is whole. A batch that comes again after its record stands (Spark was lost before it noted the
batch itself) does nothing. One stream writes to a folder at a time, as Spark's checkpoint asks too.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "batch long, attempt string, state string, files array<string>, tables array<string>, error string"


def _path(spark: SparkSession, name: str):  # noqa: ANN202
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def note(spark: SparkSession, folder: str, name: str, record: dict) -> None:
    """The record as folder/commits/<name>.json: there as a whole or not at all."""
    new, fs = _path(spark, f"{folder}/commits/.{name}-{uuid.uuid4().hex}")
    stream = fs.create(new)
    stream.write(bytearray(json.dumps(record), "utf-8"))
    stream.close()
    target, _ = _path(spark, f"{folder}/commits/{name}.json")
    if not fs.rename(new, target):
        raise OSError(f"record {target} could not be put in place")


def committed(folder: str, make: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A `run` for `inbox`: the tables that `make` derives from a batch, and the record that makes them count.

    A failed attempt leaves a record of its own with the error, which counts for nothing, and raises.
    """

    def run(rows: DataFrame, batch: int) -> None:
        spark, attempt, written = rows.sparkSession, f"a{uuid.uuid4().hex}", []
        path, fs = _path(spark, f"{folder}/commits/{batch}.json")
        if fs.exists(path):
            return
        files = [r.f for r in rows.select(F.input_file_name().alias("f")).distinct().sort("f").collect()]  # one batch's
        record = {"batch": batch, "attempt": attempt, "files": files, "tables": written}
        try:
            for name, df in make(rows).items():
                df.write.parquet(f"{folder}/tables/{name}/batch={batch}/attempt={attempt}")
                written.append(name)
        except Exception as e:
            note(spark, folder, f"{batch}-{attempt}", record | {"state": "failed", "error": str(e)[:1000]})
            raise
        note(spark, folder, str(batch), record | {"state": "done"})

    return run


def records(spark: SparkSession, folder: str) -> DataFrame:
    """batch, attempt, state (done or failed), files, tables, error: a row for each attempt that came to an end."""
    return spark.read.schema(RECORD).json(f"{folder}/commits")


def results(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of table `name` of all runs that count, with their batch."""
    done = records(spark, folder).where("state = 'done'").select("attempt")
    rows = spark.read.parquet(f"{folder}/tables/{name}")
    return rows.join(done, "attempt", "left_semi").drop("attempt")
