"""Incremental work on a growing folder: files that were done before, in this form and by these settings, are skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_SCHEMA = "path string, hash string, settings string"


def pending(files: DataFrame, journal: DataFrame, settings: str) -> DataFrame:
    """Files (path, content) without a row (path, hash, settings) in the journal, with their hash."""
    own = files.withColumn("hash", F.sha2("content", 256)).withColumn("settings", F.lit(settings))
    return own.join(journal.select("path", "hash", "settings"), ["path", "hash", "settings"], "left_anti")


def watch(spark: SparkSession, source: str, journal: str, checkpoint: str, settings: str, work: Callable[[DataFrame], None]) -> StreamingQuery:
    """Runs work on each batch of new or changed files under source, then notes them in the journal (a Parquet folder) and stops.

    A batch that failed is run again with the same files, so work should overwrite what it wrote for them.
    """
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(source)
    spark.createDataFrame([], _SCHEMA).write.mode("append").parquet(journal)

    def each(batch: DataFrame, _: int) -> None:
        todo = pending(batch, spark.read.schema(_SCHEMA).parquet(journal), settings)
        work(todo)
        todo.select("path", "hash", "settings").write.mode("append").parquet(journal)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
