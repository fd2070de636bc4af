"""Where queries find their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir. Documents that lie in a few splits, eight at most, are dealt out over the cores, since work on whole texts outweighs that."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return found.repartition(cores) if name == "documents" and found.rdd.getNumPartitions() < min(cores, 9) else found
