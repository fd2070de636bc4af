"""Results of whole texts beside the rows they come from, whatever columns those have."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.scratch import slices


def with_results(docs: DataFrame, found: Callable[[list[str]], list[pa.Array]], results: str) -> DataFrame:
    """A struct `kept` of each row of docs, and the result columns (a schema in DDL) that found gives for texts, null as empty."""
    names = [c.split()[0] for c in results.split(", ")]
    rows = docs.withColumn("text", F.col("text").cast("string")) if docs.schema["text"].dataType.simpleString() != "string" else docs
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("kept"))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("kept").field(place)
            parts = [found(own) for _, own in slices(pa.RecordBatch.from_arrays([text], ["text"]))]
            columns = [pa.concat_arrays([p[k] for p in parts]) for k in range(len(names))] if parts else []
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column("kept"), *columns], ["kept", *names])

    return rows.mapInArrow(run, T.StructType([rows.schema["kept"], *T.StructType.fromDDL(results).fields]))


def kept_fields(found: DataFrame, keep: tuple[str, ...], *results: str) -> DataFrame:
    """The columns keep of the rows and the results."""
    return found.select(*[F.col(f"kept.`{c}`") for c in keep], *results)
