"""Exact and near deduplication by keys, shingles and MinHash bands."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.session import shared_folder


def exact(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order, and how many there are: an aggregation that combines before its shuffle, so a hot key is no burden."""
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]), 256)
    first = rows.select(digest.alias("_key"), *order).groupBy("_key")
    return first.agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("copies")).select("_first.*", "copies")


def shingled(docs: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, shingle) for the distinct word shingles of the lower-case text."""
    return docs.select("doc_id", F.explode(F.array_distinct(tx.ngrams(tx.words(F.lower("text")), n))).alias("shingle"))


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, h, key): the distinct shingles as hashes in order, and a digest of them."""
    own = docs.select("doc_id", F.sort_array(F.transform(F.array_distinct(tx.ngrams(tx.words(F.lower(F.coalesce("text", F.lit("")))), n)), lambda g: F.xxhash64(g))).alias("h"))
    return own.withColumn("key", F.sha2(F.array_join(F.transform("h", lambda x: x.cast("string")), ",").cast("binary"), 256))


def equal_sets(docs: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, representative, key): documents of equal shingle sets belong to the least doc_id among them."""
    own = _sets(docs, n).select("doc_id", "key")
    return own.join(own.groupBy("key").agg(F.min("doc_id").alias("representative")), "key").select("doc_id", "representative", "key")


def jaccard_pairs(docs: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """(i, j, jaccard) for all pairs of different shingle sets that reach the threshold, exactly, by prefix filtering; a set is named by its least doc_id.

    Documents of equal sets are one, so copies make no pairs; equal_sets() tells which they are. Of two sets whose Jaccard is t or more, each has
    one of the other's shingles among its rarest (1-t)*size+1. Only those are joined, and only pairs whose sizes allow it are verified.
    """
    sets = _sets(docs, n).groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.any_value("h").alias("h")).select("doc_id", F.explode("h").alias("h"))
    frequency = sets.groupBy("h").agg(F.count("*").alias("df"))
    ranked = sets.join(frequency.where("df > 1"), "h", "left").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "h"))).alias("s"))
    ranked = ranked.withColumn("size", F.size("s"))
    prefix = ranked.select("doc_id", "size", F.explode(F.slice("s", 1, F.col("size") - F.ceil(F.col("size") * threshold).cast("int") + 1)).alias("x")).select("doc_id", "size", "x.h", "x.df").where("df > 1")
    a, b = (prefix.select(F.col("doc_id").alias(i), F.col("size").alias(f"{i}_size"), "h") for i in "ij")
    fits = (F.col("i") < F.col("j")) & (F.least("i_size", "j_size") >= F.greatest("i_size", "j_size") * threshold)
    pairs = a.join(b, "h").where(fits).select("i", "j").distinct()
    held = ranked.select("doc_id", F.transform("s", lambda x: x["h"]).alias("s"))
    both = pairs.join(held.select(F.col("doc_id").alias("i"), F.col("s").alias("p")), "i").join(held.select(F.col("doc_id").alias("j"), F.col("s").alias("q")), "j")
    common = F.size(F.array_intersect("p", "q"))
    jaccard = common / (F.size("p") + F.size("q") - common)
    return both.select("i", "j", jaccard.alias("jaccard")).where(F.col("jaccard") >= threshold).withColumn("jaccard", F.round("jaccard", 6))


def signatures(docs: DataFrame, permutations: int = 117, n: int = 5) -> DataFrame:
    """(doc_id, signature): the least hash of the shingles under each of many seeds; a text without words has the largest value throughout."""
    grams = F.array_distinct(tx.ngrams(tx.words(F.lower("text")), n))
    own = docs.select("doc_id", F.transform(grams, lambda s: F.xxhash64(s)).alias("h"))
    least = lambda seed: F.coalesce(F.array_min(F.transform("h", lambda x: F.xxhash64(x, F.lit(seed)))), F.lit((1 << 63) - 1))
    return own.select("doc_id", F.array(*[least(k) for k in range(permutations)]).alias("signature"))


def greedy_near(docs: DataFrame, bands: int = 9, rows: int = 13, n: int = 5) -> DataFrame:
    """(doc_id, kept): in the order of doc_id a document is kept unless a kept earlier one shares a band; no similarity is verified.

    That is the first maximal independent set of the collision graph. In each round an undecided document goes if it shares a bucket with
    a kept smaller one, and stays if no undecided smaller one is in any of its buckets; both come from least values of buckets,
    so no pairs are made. Rounds are written to the shared folder; the smallest undecided document is always decided.
    """
    band = F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band")
    keyed = signatures(docs, bands * rows, n).select("doc_id", "signature", band).select("doc_id", "band", F.xxhash64(F.slice("signature", F.col("band") * rows + 1, rows)).alias("key"))
    buckets = _table(keyed, "buckets")
    state = _table(docs.select("doc_id").distinct().withColumn("state", F.lit(0)), "state")  # 0 undecided, 1 kept, 2 gone
    while not state.where("state = 0").isEmpty():
        known = buckets.join(state, "doc_id").where("state < 2")
        firsts = known.groupBy("band", "key").agg(F.min(F.when(F.col("state") == 1, F.col("doc_id"))).alias("kept"), F.min(F.when(F.col("state") == 0, F.col("doc_id"))).alias("open"))
        seen = buckets.join(state.where("state = 0").select("doc_id"), "doc_id").join(firsts, ["band", "key"])
        verdict = seen.groupBy("doc_id").agg(F.max(F.col("kept") < F.col("doc_id")).alias("gone"), F.min(F.coalesce(F.col("open") >= F.col("doc_id"), F.lit(True))).alias("free"))
        new = F.when(F.col("gone"), 2).when(F.col("free"), 1).otherwise(0)
        state = _table(state.join(verdict, "doc_id", "left").select("doc_id", F.when(F.col("state") == 0, new).otherwise(F.col("state")).alias("state")), "state")
    return state.select("doc_id", (F.col("state") == 1).alias("kept"))


def shared_passages(docs: DataFrame, items: DataFrame, n: int = 13, most_rows: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, shared): how many distinct n-word passages a document shares with a benchmark item.

    Passages meet by a hash and are then compared word by word. If the items have no more than most_rows passages, they go to all tasks, so that
    no passage of a document is shuffled; else both sides are.
    """

    def cut(rows: DataFrame, name: str) -> DataFrame:
        own = rows.select(name, tx.words(F.lower("text")).alias("w")).where(F.size("w") >= n)
        return own.select(name, F.explode(F.array_distinct(tx.ngrams(F.col("w"), n))).alias("x")).withColumn("h", F.xxhash64("x"))

    asked = cut(items, "item_id").withColumnRenamed("x", "y")
    few = asked.limit(most_rows + 1).count() <= most_rows
    met = cut(docs, "doc_id").join(F.broadcast(asked) if few else asked, "h").where("x = y")
    return met.groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


def _table(df: DataFrame, name: str) -> DataFrame:
    """A written table in the folder that all executors share."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
