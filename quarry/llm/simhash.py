"""Near-duplicate documents by SimHash fingerprints and covering locality-sensitive hashing."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import connected_components
from quarry.llm.scratch import drop, written
from quarry.session import small_batches

BITS = 64


def fingerprint(text: bytes | None, words_each: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text, as a signed long: see near_duplicates()."""
    words = (text or b"").lower().split()  # bytes: only A-Z change, only x20 and x09-x0D divide
    if not words:
        return 0
    k = min(words_each, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(begins.tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words_each: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([fingerprint(x.as_py(), words_each) for x in batch.column("text")], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, words_each: int = 4) -> DataFrame:
    """(doc_id, fp) for each row of docs; a null text counts as an empty one."""
    small_batches(docs.sparkSession)
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return cut.mapInArrow(lambda batches: _fingerprints(batches, words_each), "doc_id long, fp long")


def covering_masks(radius: int, seed: int) -> list[int]:
    """2^(radius+1)-1 bit masks such that any two words that differ in at most radius bits agree under one of them.

    Each bit position gets a vector of radius+1 bits; the mask of a non-zero vector v keeps the positions whose vector has an
    odd inner product with v. At most radius differing positions leave some v orthogonal to all of theirs.
    """
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(BITS)]
    random.Random(seed).shuffle(vectors)
    return [sum(((v & m).bit_count() & 1) << i for i, m in enumerate(vectors)) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _forest(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    edges, rest, todo = [], points, []
    while len(rest):
        if not todo:
            todo, rest = [int(rest[0])], rest[1:]
            continue
        at = todo.pop()
        near = np.bitwise_count((rest ^ np.int64(at)).view(np.uint64)) <= radius
        if near.any():
            hit = rest[near].tolist()
            rest = rest[~near]
            todo += hit
            edges += [(at, x) for x in hit]
    return edges


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of each bucket; rows come sorted by bucket, and a bucket is bounded by the caller."""
    held = np.empty((0, 3), np.int64)

    def out(rows: np.ndarray) -> pa.RecordBatch:
        edges: list[tuple[int, int]] = []
        if len(rows):
            cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            for part in np.split(rows[:, 2], cuts):
                edges += _forest(part, radius)
        u, v = zip(*edges, strict=True) if edges else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate((held, np.stack([batch.column(c).to_numpy() for c in ("path", "key", "fp")], axis=1)))
        last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
        cut = last[-1] + 1 if len(last) else 0
        yield out(rows[:cut])
        held = rows[cut:]
    yield out(held)


def fingerprint_links(points: DataFrame, radius: int = 4, bucket_rows: int = 4096, rows: int | None = None) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints fp of points which differ in at most radius bits.

    Each level puts every fingerprint into the buckets of all covering masks. Buckets are first only counted, with their
    least and greatest member, so that a pair needs no second look and a large bucket is never gathered. Buckets of up to
    bucket_rows go to one worker each, which returns a spanning forest of the links. Larger ones are divided by a
    further set of covering masks over the bits still free; as these halve at each level and fingerprints are distinct, that ends.
    rows, about how many points there are, only decides over how many files small tables are spread.
    """
    level, keyed, edges = 0, points.select(F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("mask"), "fp"), None
    while True:
        masks = covering_masks(radius, seed=level)
        tables = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.lit(_signed(m)).cast("long").alias("m")) for t, m in enumerate(masks)])
        spread = keyed.select("path", "mask", "fp", F.explode(tables).alias("x")).select(
            (F.col("path") * len(masks) + F.col("x.t")).alias("path"), F.col("mask").bitwiseOR(F.col("x.m")).alias("mask"), "fp"
        ).withColumn("key", F.col("mask").bitwiseAND(F.col("fp")))
        counted = spread.groupBy("path", "key").agg(F.count("*").alias("n"), F.min("fp").alias("least"), F.max("fp").alias("most"))
        counted = written(counted.where("n > 1"), "buckets", rows)
        twos = counted.where("n = 2").where(_differing(F.col("least"), F.col("most")) <= radius).select(F.col("least").alias("u"), F.col("most").alias("v"))
        members = spread.join(counted.where(F.col("n").between(3, bucket_rows)).select("path", "key"), ["path", "key"]).select("path", "key", "fp")
        grouped = members.repartition("path", "key").sortWithinPartitions("path", "key")
        found = twos.unionByName(grouped.mapInArrow(lambda batches: _links(batches, radius), "u long, v long")).distinct()
        found = written(found, "links", rows)
        edges = found if edges is None else edges.unionByName(found)
        hot = counted.where(F.col("n") > bucket_rows).select("path", "key")
        if hot.isEmpty():
            return edges
        keyed, level = written(spread.join(hot, ["path", "key"]).select("path", "mask", "fp"), "hot"), level + 1


def near_duplicates(docs: DataFrame, radius: int = 4, words_each: int = 4, bucket_rows: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text; other columns are not looked at).

    A text is lower-cased in A-Z and cut at x20 and x09-x0D; its shingles of words_each words, repeats included, are hashed by
    XXH64 with seed 42, and a fingerprint bit is set if it is set in over half of the hashes. A text of fewer words has one
    shingle, an empty or null one none and the fingerprint zero. Fingerprints link if at most radius bits differ; component_id is
    the smallest doc_id that links reach. Equal texts, repeated rows included, share a fingerprint and are handled as one; a null
    doc_id keeps its row and is the smallest only where its component has no other. An empty table gives no rows.
    """
    marked = fingerprints(docs, words_each)
    count = docs.count()
    marked = written(marked, "fingerprints", count)
    points = written(marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "points", count)
    labels = connected_components(fingerprint_links(points, radius, bucket_rows, count), count).withColumnRenamed("node", "fp")
    rooted = written(points.join(labels, "fp", "left").select("fp", "doc_id", F.coalesce("component", "fp").alias("root")), "rooted", count)
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    drop(points)
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return marked.join(named, "fp").select("doc_id", text.alias("fingerprint"), "component_id")
