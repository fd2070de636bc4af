"""Filters as objects, gates by scores and entities that others found, pages as documents, whole shuffles, and encoding by a library's file."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import repair
from quarry.operators.cleaning import without_law_references
from quarry.operators.training import first_difference
from quarry.session import ship, small_batches

#: Marks of entities by their labels: fixed values.
ENTITY_MARKS = {
    "PERSON": "<PERSONA>", "LOCATION": "<LUOGO>", "EMAIL_ADDRESS": "<EMAIL>", "PHONE_NUMBER": "<TELEFONO>", "IBAN_CODE": "<IBAN>", "CREDIT_CARD": "<CC>",
    "IP_ADDRESS": "<IP>", "IT_FISCAL_CODE": "<CF>", "IT_VAT_CODE": "<PIVA>", "DATE_TIME": "<DATA>",
}


@dataclass(frozen=True)
class Filter:
    """A named step of a chain: why a text is rejected (null: it is not), and what becomes of one that is kept. Both make column expressions, so a chain is one plan."""

    name: str
    reason: Callable[[Column], Column] = lambda text: F.lit(None).cast("string")
    rewrite: Callable[[Column], Column] = lambda text: text


def chained(docs: DataFrame, filters: list[Filter]) -> DataFrame:
    """(doc_id, text, filter, reason, kept): each text goes through the filters in order, rewritten by those before, until one rejects it. Null texts count as empty."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("filter"), F.lit(None).cast("string").alias("reason"))
    for step in filters:
        open_ = F.col("filter").isNull()
        own = own.withColumn("_why", F.when(open_, step.reason(F.col("text"))))
        kept = open_ & F.col("_why").isNull()
        own = own.select(
            "doc_id", F.when(kept, step.rewrite(F.col("text"))).otherwise(F.col("text")).alias("text"), F.when(F.col("_why").isNotNull(), step.name).otherwise(F.col("filter")).alias("filter"), F.coalesce("reason", "_why").alias("reason")
        )
    return own.withColumn("kept", F.col("filter").isNull())


def unigram_perplexity(docs: DataFrame, smooth: float = 1.0) -> DataFrame:
    """(doc_id, perplexity): of each text's words in lower case by how often all texts have them, one more each; null for a text without words.

    A stand-in where no language model is at hand; scores of a real one come as a column of their own.
    """
    words = docs.select("doc_id", F.explode(tx.words(F.lower("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("c"))
    counts = words.groupBy("w").agg(F.sum("c").alias("n"))
    total = counts.agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
    bits = -F.log((F.col("n") + smooth) / (F.col("all") + F.col("kinds") * smooth))
    rated = words.join(counts, "w").crossJoin(F.broadcast(total)).groupBy("doc_id").agg(F.exp(F.sum(F.col("c") * bits) / F.sum("c")).alias("perplexity"))  # one row
    return docs.select("doc_id").join(rated, "doc_id", "left")


def perplexity_gate(perplexity: Column, low: float = 5.0, high: float = 1500.0) -> Column:
    """Why a text does not pass a gate by its perplexity, or null; one without a score passes, as the gate is then off."""
    return F.when(perplexity < low, "low_perplexity").when(perplexity > high, "high_perplexity")


def entities_redacted(docs: DataFrame, entities: DataFrame, least: float = 0.4) -> DataFrame:
    """(doc_id, text): entities (doc_id, start, end, label, score) that score enough replaced by their marks; of overlapping ones the first, then the longer. Positions count code points.

    Entities come from whatever finds them; a text of which none are known stays as it is. A label without a mark is not replaced.
    """
    marks = F.create_map(*[F.lit(x) for pair in ENTITY_MARKS.items() for x in pair])
    known = entities.where((F.col("score") >= least) & (F.col("end") > F.col("start"))).withColumn("mark", F.try_element_at(marks, F.col("label"))).where("mark is not null")
    held = known.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", (-F.col("end")).alias("e"), "mark"))).alias("spans"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, x["start"].cast("int") - acc["at"])
        return F.when(x["start"] >= acc["at"], F.struct((-x["e"]).cast("int").alias("at"), F.concat(acc["out"], gap, x["mark"]).alias("out"))).otherwise(acc)

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    joined = docs.select("doc_id", "text").join(held, "doc_id", "left")
    return joined.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.aggregate("spans", start, step, rest)).alias("text"))


def paged_documents(pages: DataFrame) -> DataFrame:
    """(path, text) of documents that come as pages (path, page, text), as PDF readers give them: pages that are tables go, then running heads and feet and references.

    Pages are joined in their order by blank lines; a document without a page left is none.
    """
    sound = pages.where(~repair.is_garbage(F.col("text"))).withColumn("text", without_law_references(F.col("text")))
    plain = repair.without_furniture(sound.select("path", "page", "text"), "path", "page", "text")
    whole = plain.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"))
    return whole.select("path", tx.stripped(F.array_join(F.transform("p", lambda x: x["text"]), "\n\n")).alias("text")).where("text <> ''")


def shuffled(rows: DataFrame, key: str, seed: int, buckets: int = 1024) -> DataFrame:
    """rows with place, from 0, in a seeded order of all: that of the MD5 of seed and key.

    Places before a row are those of the digest's buckets before its own, and a running number inside the bucket, so no task has all rows.
    """
    digest = F.md5(F.concat_ws(":", F.lit(f"shuffle {seed}"), F.col(key).cast("string")))
    own = rows.withColumns({"_d": digest, "_b": F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * buckets / (1 << 32))})
    totals = own.groupBy("_b").agg(F.count("*").alias("n"))
    before = totals.select("_b", (F.sum("n").over(Window.orderBy("_b")) - F.col("n")).alias("_n"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_d", key)) - 1
    return own.withColumn("_i", inside).join(F.broadcast(before), "_b").withColumn("place", (F.col("_n") + F.col("_i")).cast("long")).drop("_d", "_b", "_n", "_i")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, back): the ids of whole texts by a file of the tokenizers library, without special tokens, and what they decode to. Null texts are empty."""
    small_batches(docs.sparkSession)
    ship(docs.sparkSession)
    ready: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in ready:
            from tokenizers import Tokenizer

            ready[path] = Tokenizer.from_file(path)
            ready[path].encode_special_tokens = True
        own = ready[path]
        for batch in batches:
            ids = [own.encode(x.as_py() or "", add_special_tokens=False).ids for x in batch.column("text")]
            back = own.decode_batch(ids, skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], ["doc_id", "ids", "back"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, back string")


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, lost): where a text first differs from what its ids decode to, null where it does not."""
    found = encoded(docs, path).select("doc_id", "back")
    both = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(found, "doc_id")
    return both.select("doc_id", F.when(F.col("text") != F.col("back"), first_difference(F.col("text"), F.col("back"))).alias("lost"))
