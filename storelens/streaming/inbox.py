"""A folder that is watched: each new file is run once, in a micro-batch of its own unless told otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def inbox(
    spark: SparkSession, folder: str, schema: T.StructType, checkpoint: str, run: Callable[[DataFrame, int], None], archive: str | None = None,
    pattern: str = "[!~.]*.csv", once: bool = False, on_error: Callable[[int, Exception], None] | None = None, files: int = 1,
) -> StreamingQuery:
    """Runs `run(rows, batch_id)` on each file (or on as many at a time as `files` says). Names that begin with . or ~ are passed over.

    The checkpoint makes each file count once, over restarts too. A run that fails is told to `on_error`, and
    the next file goes on; without `on_error` it ends the stream. `once`: the files that are there now.
    `run` should write under its batch id, so that a repeated batch replaces its own results; `commits.committed` makes
    one whose results count as a whole.
    """
    reader = spark.readStream.schema(schema).options(header=True, pathGlobFilter=pattern, maxFilesPerTrigger=files)
    if archive:
        reader = reader.options(cleanSource="archive", sourceArchiveDir=archive)

    def each(rows: DataFrame, batch: int) -> None:
        try:
            run(rows, batch)
        except Exception as e:
            if on_error is None:
                raise
            on_error(batch, e)

    writer = reader.csv(folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()
