"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.session import shared_folder

def sized(df: DataFrame, rows: int, rows_each: int = 20_000) -> DataFrame:
    """df in no more partitions than rows, a bound on how many it has, give reason for: rows_each at least, or eight for each core.

    That only unites partitions; a table whose rows are many is left as it is.
    """
    return df.coalesce(max(8 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // rows_each)))


def written(df: DataFrame, name: str, rows: int | None = None, rows_each: int = 20_000) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there, and a lost executor loses nothing.

    rows, a bound on df's rows, keeps small tables from lying in very many files. The files go when the driver's JVM exits, or
    earlier by drop().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = sized(df, rows, rows_each)
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def drop(table: DataFrame) -> None:
    """Deletes a table made by written() that nothing will read again."""
    spark = table.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._quarry_path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def slices(batch: pa.RecordBatch, chars: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """The texts of an Arrow batch, null as empty, in slices of about so many characters; a text is never cut."""
    first, held, size = 0, [], 0
    for k, x in enumerate(batch.column("text")):
        held.append(x.as_py() or "")
        size += len(held[-1])
        if size >= chars:
            yield first, held
            first, held, size = k + 1, [], 0
    if held:
        yield first, held
