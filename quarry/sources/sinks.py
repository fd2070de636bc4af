"""Corpus files bounded by size."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import ship


def chunked(docs: DataFrame, most_bytes: int, text: str = "text", marks: bool = True) -> DataFrame:
    """(chunk, value): documents as <bos>text<eos>, or without these marks, in chunks that start anew when the next line would pass most_bytes; a larger one stands alone.

    Chunks are filled within a partition, in its order, and numbered by partition; null texts are dropped.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            chunks = []
            for n in batch.column("n").to_pylist():
                if held and held + n > most_bytes:
                    chunk, held = chunk + 1, 0
                held += n
                chunks.append(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), batch.column("value")], ["chunk", "value"])

    value = F.concat(F.lit("<bos>"), F.col(text), F.lit("<eos>")) if marks else F.col(text)
    rows = docs.where(F.col(text).isNotNull()).select(value.alias("value")).select("value", (F.octet_length("value") + 1).cast("long").alias("n"))
    return rows.mapInArrow(run, "chunk long, value string")


def write_chunks(docs: DataFrame, path: str, most_bytes: int, text: str = "text") -> None:
    """Writes chunked() as text, a folder for each chunk, through Spark's commit protocol."""
    chunked(docs, most_bytes, text).write.partitionBy("chunk").text(path)


def token_shards(docs: DataFrame, most_bytes: int, begin: int | None = None, end: int | None = None, wide: bool = True, ids: str = "ids") -> DataFrame:
    """(shard, tokens, bytes, sha256, content): the ids (arrays) of documents as little-endian unsigned integers of 32 bits, or 16, one after the other.

    A shard begins anew when the next document would pass most_bytes; a larger one stands alone. Shards are filled within a partition, in
    its order, and numbered by partition. begin and end stand around each document, where given. An id that does not fit is an error.
    """
    ship(docs.sparkSession)
    kind, limit = ("<u4", 1 << 32) if wide else ("<u2", 1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size = TaskContext.get().partitionId() << 32, [], 0

        def row() -> pa.RecordBatch:
            content = b"".join(held)
            columns = [pa.array([x], pa.int64()) for x in (shard, len(content) // np.dtype(kind).itemsize, len(content))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([hashlib.sha256(content).hexdigest()]), pa.array([content], pa.binary())], ["shard", "tokens", "bytes", "sha256", "content"])

        for batch in batches:
            for x in batch.column("ids"):
                own = np.array([*([] if begin is None else [begin]), *x.as_py(), *([] if end is None else [end])], np.int64)
                if len(own) and not 0 <= own.min() <= own.max() < limit:
                    raise ValueError("an id does not fit the width of the shard")
                data = own.astype(kind).tobytes()
                if size and size + len(data) > most_bytes:
                    yield row()
                    shard, held, size = shard + 1, [], 0
                held.append(data)
                size += len(data)
        if size:
            yield row()

    return docs.where(F.col(ids).isNotNull()).select(F.col(ids).alias("ids")).mapInArrow(run, "shard long, tokens long, bytes long, sha256 string, content binary")


def shard_tokens(shards: DataFrame, wide: bool = True, rows: int = 1 << 16) -> DataFrame:
    """(shard, first, ids): the tokens of shards (shard, sha256, content) in arrays of at most so many. Content whose checksum is another is an error."""
    ship(shards.sparkSession)
    kind = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, digest, content in zip(*[batch.column(c) for c in ("shard", "sha256", "content")], strict=True):
                data = content.as_py()
                if hashlib.sha256(data).hexdigest() != digest.as_py():
                    raise ValueError(f"shard {shard.as_py()} is not what was written")
                ids = np.frombuffer(data, kind).astype(np.int64)
                for at in range(0, len(ids), rows):
                    yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()], pa.int64()), pa.array([at], pa.int64()), pa.array([ids[at : at + rows].tolist()], pa.list_(pa.int64()))], ["shard", "first", "ids"])

    return shards.select("shard", "sha256", "content").mapInArrow(run, "shard long, first long, ids array<long>")


def marked_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """(value): documents that are not empty between marks on lines of their own, a blank line after each."""
    own = docs.where(F.coalesce(F.col(text), F.lit("")) != "")
    return own.select(F.concat(F.lit("<bos>\n"), F.col(text), F.lit("\n<eos>\n\n")).alias("value"))


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line, nulls included, through Spark's commit protocol."""
    rows.write.option("ignoreNullFields", "false").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a head line; quotes inside a value are doubled."""
    rows.write.option("header", "true").option("escape", '"').option("quoteAll", "true").csv(path)


def cached(rows: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What work makes of rows, kept under path by a key of content and settings: made once, then read."""
    spark = rows.sparkSession
    place = f"{path.rstrip('/')}/key={key}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        work(rows).write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)
