"""Exact top-k search with vector approximations: bounds from quantised cells first, exact vectors in the order of their bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.scratch import written
from quarry.session import small_batches

_LARGEST = 1 << 28


def _scaled(embedding: Column, scale: int) -> Column:
    """scale * x of each component in double precision; null for a vector that takes no part."""
    values = F.transform(embedding.cast("array<double>"), lambda x: x * F.lit(float(scale)))
    fit = F.forall(embedding.cast("array<double>"), lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return F.when(fit, values)


def _packed(rows: DataFrame, width: int, per_row: int, kind: str) -> DataFrame:
    """Vectors in the order they lie, per_row to a row: (part, n, ids, data), with the data of kind in binaries, short vectors filled with zeros. ids are rows' numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, per_row):
                cut = batch.slice(at, per_row)
                data = np.zeros((cut.num_rows, width), np.int64)
                lengths = np.fromiter((len(x) for x in cut.column("v")), np.int64, cut.num_rows)
                data[np.arange(width) < lengths[:, None]] = cut.column("v").flatten().to_numpy()
                ids = cut.column("row").to_numpy().astype("<i8").tobytes()
                columns = [pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([ids], pa.binary()), pa.array([data.astype(kind).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "n", "ids", "data"])
                n += 1

    return rows.select("row", "v").mapInArrow(run, "part long, n long, ids binary, data binary")


def _cells(chunks: DataFrame, width: int, low: int, step: int) -> DataFrame:
    """The approximation file: the cell of each component, a byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [((np.frombuffer(x.as_py(), "<i8") - low) // step).astype(np.uint8).tobytes() for x in batch.column("data")]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("n"), batch.column("ids"), pa.array(data, pa.binary())], ["part", "n", "cand_ids", "cells"])

    return chunks.mapInArrow(run, "part long, n long, cand_ids binary, cells binary")


def _bounded(pairs: DataFrame, width: int, low: int, step: int, k: int) -> DataFrame:
    """(query, row, low, high): for each block of queries and chunk of cells, the candidates that may be among the k best of the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, kind, i=i, batch=batch: np.frombuffer(batch.column(c)[i].as_py(), kind)
                queries, ids, q = get("ids", "<i8"), get("cand_ids", "<i8"), get("data", "<i8").reshape(-1, width).astype(np.float64)
                least = low + step * get("cells", np.uint8).reshape(-1, width).astype(np.float64)
                slack = 1e-12 * np.abs(q).sum(axis=1) * max(abs(low), np.abs(least).max() + step)
                middle = q @ least.T
                bottom = middle + (np.minimum(q, 0).sum(axis=1) * (step - 1) - slack)[:, None]
                gap = np.abs(q).sum(axis=1) * (step - 1) + 2 * slack
                bottom[queries[:, None] == ids[None, :]] = -np.inf
                kth = np.partition(bottom, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(queries), -np.inf)
                row, column = np.nonzero((bottom + gap[:, None] >= kth[:, None]) & (bottom > -np.inf))
                found = bottom[row, column]
                columns = [pa.array(queries[row]), pa.array(ids[column]), pa.array(found), pa.array(found + gap[row])]
                yield pa.RecordBatch.from_arrays(columns, ["query", "row", "low", "high"])

    return pairs.mapInArrow(run, "query long, row long, low double, high double")


def _gridded(blocks: DataFrame, chunks: DataFrame, most: int = 64) -> DataFrame:
    """Every block beside every chunk: both are dealt to a side of a grid and copied along the other, so that either is copied `most` times at most."""
    down, across = (max(1, min(x.count(), most)) for x in (blocks, chunks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("part", "n"), F.lit(n)).cast("int")
    left = blocks.withColumn("i", own(down)).withColumn("j", every(across)).drop("part", "n")
    return left.join(chunks.withColumn("j", own(across)).withColumn("i", every(down)), ["i", "j"])


def _exact_best(queries: DataFrame, rows: DataFrame, k: int, block: int, scale: int) -> DataFrame:
    """(query, row, score, rest): exact products, as strings, of every query with the rows, the k best of each chunk and all equal to its k-th; for vectors too large for cells.

    Components are whole numbers of any size, so products are Python's.
    """

    def chunked(frame: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, part = 0, TaskContext.get().partitionId()
            for batch in batches:
                for at in range(0, batch.num_rows, block):
                    cut = batch.slice(at, block)
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([cut.column("row").to_pylist()]), pa.array([cut.column("raw").to_pylist()], pa.list_(pa.list_(pa.float64())))], ["part", "n", "ids", "raw"])
                    n += 1

        return frame.select("row", "raw").mapInArrow(run, "part long, n long, ids array<long>, raw array<array<double>>")

    whole = lambda x: math.floor(scale * x) if abs(x) < 1e300 else int(x) * scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, q_raw, ids, raw in zip(*[batch.column(c).to_pylist() for c in ("ids", "raw", "cand_ids", "cand_raw")], strict=True):
                vectors = [[whole(x) for x in v] for v in raw]
                for query, v in zip(asked, q_raw, strict=True):
                    own = [whole(x) for x in v]
                    found = sorted(((sum(a * b for a, b in zip(own, c, strict=False)), row) for row, c in zip(ids, vectors, strict=True) if row != query), reverse=True)
                    found = [x for x in found if x[0] >= found[min(k, len(found)) - 1][0]] if found else found
                    yield pa.RecordBatch.from_arrays([pa.array([query] * len(found), pa.int64()), pa.array([r for _, r in found], pa.int64()), pa.array([str(x) for x, _ in found], pa.string())], ["query", "row", "score"])

    chunks = chunked(rows).select("part", "n", F.col("ids").alias("cand_ids"), F.col("raw").alias("cand_raw"))
    return _gridded(chunked(queries), chunks).select("ids", "raw", "cand_ids", "cand_raw").mapInArrow(run, "query long, row long, score string")


def top_k(table: DataFrame, every: int = 50, k: int = 5, scale: int = 256, cells: int = 128, block: int = 512, chunk: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query vector with the vectors of all other rows.

    table has vec_id and embedding; other columns are not looked at. Components are floor(scale * x), queries the rows whose vec_id is
    divisible by every. Components are quantised to `cells` equal cells over the range that all vectors have. Blocks of queries meet
    chunks of cells, which gives each product a lower and an upper bound; a candidate goes when its upper bound is below the
    k-th lower bound of its query. Exact vectors are then read in the order of the upper bounds: 2k for each query, and after those
    all whose bound the k-th exact score does not exclude. Ties go to the smaller vec_id; a query with fewer candidates has fewer rows.

    Vectors that are null or hold a null or non-finite component take no part. A row is a candidate whatever its vec_id: of rows that
    repeat one each counts, and each is a query of its own; a null vec_id comes last among ties. Vectors with a component of 2^28 or
    more after scaling, for which cells and long products are no use, meet all others in exact whole numbers instead; a score
    beyond a long is the nearest long, but ranks as what it is. Vectors of different lengths are compared as if the shorter one
    ended in zeros; an empty vector is all zeros. An empty table gives no rows.
    """
    spark = table.sparkSession
    small_batches(spark, chunk)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("raw"), _scaled(F.col("embedding"), scale).alias("x")).where("x is not null")
    rows = rows.withColumn("large", F.exists("x", lambda x: F.abs(x) >= float(_LARGEST))).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows.select("row", "vec_id", F.when(F.col("large"), F.col("raw")).alias("raw"), F.when(~F.col("large"), F.transform("x", lambda x: F.floor(x).cast("long"))).alias("v")), "exact")
    exact, large = rows.where("v is not null").select("row", "vec_id", "v"), rows.where("v is null").select("row", "vec_id", "raw")
    range_ = exact.agg(F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v")), F.min(F.size("v")), F.count("*")).first()
    best = Window.partitionBy("query")
    order = (F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    found = None
    if range_[4]:
        width = max(range_[0], 1)
        low, high = range_[1] or 0, range_[2] or 0
        if range_[3] < width:
            low, high = min(low, 0), max(high, 0)
        step = (high - low) // min(cells, 256) + 1
        approximate = written(_cells(_packed(exact, width, chunk, "<i8"), width, low, step), "cells")
        queries = exact.where(F.col("vec_id") % every == 0)
        blocks = written(_packed(queries, width, block, "<i8"), "blocks")
        pairs = _gridded(blocks, approximate).select("ids", "data", "cand_ids", "cells")
        bounded = written(_bounded(pairs, width, low, step, k), "bounded")

        kth = bounded.select("query", "row", "low", F.row_number().over(best.orderBy(F.desc("low"), "row")).alias("r")).where(F.col("r") <= k)
        kth = kth.groupBy("query").agg(F.when(F.count("*") == k, F.min("low")).alias("kth"))
        alive = bounded.join(kth, "query").where(F.col("kth").isNull() | (F.col("high") >= F.col("kth"))).select("query", "row", "high")
        asked = queries.select(F.col("row").alias("query"), F.col("v").alias("q"))

        def read(pairs: DataFrame) -> DataFrame:
            n = F.least(F.size("q"), F.size("v"))
            products = F.zip_with(F.slice("q", 1, n), F.slice("v", 1, n), lambda a, b: a * b)
            both = pairs.join(exact, "row").join(asked, "query")
            return both.select("query", "row", "vec_id", F.aggregate(products, F.lit(0).cast("long"), lambda a, b: a + b).alias("score"))

        first = alive.select("query", "row", F.row_number().over(best.orderBy(F.desc("high"), "row")).alias("r")).where(F.col("r") <= 2 * k)
        seen = written(read(first), "seen")
        certain = seen.select("query", "score", F.row_number().over(best.orderBy(F.desc("score"), "row")).alias("r")).where(F.col("r") <= k)
        certain = certain.groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
        rest = alive.join(certain, "query").where(F.col("floor").isNull() | (F.col("high") >= F.col("floor"))).join(seen.select("query", "row"), ["query", "row"], "left_anti")
        found = seen.unionByName(read(rest.select("query", "row")))
    if large.isEmpty():
        found = found if found is not None else spark.createDataFrame([], "query long, row long, vec_id long, score long")
        ranked = found.select("query", F.row_number().over(best.orderBy(*order)).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
    else:
        ranked = _with_large(rows, found, every, k, scale)
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return ranked.join(asked, "query").select("query_id", "rank", "vec_id", "score")


def _with_large(rows: DataFrame, found: DataFrame | None, every: int, k: int, scale: int) -> DataFrame:
    """The ranked best of what cells found, and of the exact products in which a large vector has part."""
    raw = rows.withColumn("raw", F.coalesce("raw", F.transform("v", lambda x: x / F.lit(float(scale)))))  # whole numbers below 2^28 come back as they are
    large, queries = raw.where("v is null"), raw.where(F.col("vec_id") % every == 0)
    more = _exact_best(queries, large, k, 256, scale).unionByName(_exact_best(queries.where("v is null"), raw.where("v is not null"), k, 256, scale))
    more = more.join(rows.select("row", "vec_id"), "row").select("query", "row", "vec_id", "score")
    every_one = more if found is None else found.select("query", "row", "vec_id", F.col("score").cast("string").alias("score")).unionByName(more)
    digits = F.regexp_replace("score", "^-", "")
    size = F.when(F.startswith("score", F.lit("-")), -F.length(digits)).otherwise(F.length(digits))  # whole numbers as text: by sign and length, then digits
    down = F.when(size > 0, digits)
    up = F.when(size < 0, digits)
    order = Window.partitionBy("query").orderBy(F.desc(size), F.desc_nulls_last(down), F.asc_nulls_last(up), F.col("vec_id").asc_nulls_last(), "row")
    ranked = every_one.select("query", F.row_number().over(order).alias("rank"), "vec_id", "score", size.alias("size")).where(F.col("rank") <= k)
    edge = F.when(F.col("size") > 0, F.lit((1 << 63) - 1)).otherwise(F.lit(-(1 << 63)))
    return ranked.select("query", "rank", "vec_id", F.coalesce(F.expr("try_cast(score as bigint)"), edge).alias("score"))
