"""The training-data queries by name, over whole tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import byte_bpe, embeddings, language, licenses, packing, secrets, simhash, toxicity, urls, vafile


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of documents that link at 4 or fewer bits; see simhash.near_duplicates() for nulls, ties, repeats and empty tables."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 4096 ids; see packing.packed() for nulls, ties, repeats and empty tables."""
    return packed_documents(_table(spark, sf_dir, "documents"))


def packed_documents(docs: DataFrame) -> DataFrame:
    """The pieces of packed sequences, with a checksum in place of their ids."""
    pieces = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and their decoding, as digests; see byte_bpe.encoded() for nulls, repeats and empty tables."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = byte_bpe.decoded(byte_bpe.encoded(_table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return rows.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all embeddings at cosine 0.95 or more; see embeddings.near_duplicates() for nulls, ties, repeats and empty tables."""
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def _remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by a model of those not held out; a null doc_id is not held out and not learned from. See language.judged()."""
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs, F.coalesce(_remainder(5) != 0, F.lit(False)))
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out")
    return language.predicted(docs, model).select("doc_id", held_out, "lang_pred", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document by a model of those not held out; a null doc_id is not held out. See toxicity.judged()."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, F.coalesce(_remainder(3) != 1, F.lit(False)))
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out")
    return toxicity.scored(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document; see secrets.scanned() for nulls, repeats and empty tables."""
    found = secrets.spans(_table(spark, sf_dir, "documents"))
    of = lambda k: F.filter("base", lambda x: x["k"] == k)  # noqa: E731  (a second argument of the inner lambda, even with a default, would be the place in the array)
    counts = [F.size(of(k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(secrets.BASE)]
    return found.select("doc_id", *counts, F.sha2(secrets.listed("base").cast("binary"), 256).alias("base_sha256"), secrets.listed("spans").alias("spans"))


#: The rules of the query, as host and path: fixed values.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page by URL_RULES; see urls.judged() for nulls, ties, repeats and empty tables."""
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("host", "path", "action"), rule, strict=True)]) for rule in URL_RULES])))
    return urls.judged(_table(spark, sf_dir, "pages"), rules)


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for each 50th vector; see vafile.top_k() for nulls, ties, repeats and empty tables."""
    return vafile.top_k(_table(spark, sf_dir, "embeddings"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, with `source/doc_id` as its path: a source is a directory, so one licence file in it licenses what else it holds (basis `inherited`). See licenses.scanned()."""
    docs = _table(spark, sf_dir, "documents")
    return licenses.scanned(docs.withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over all documents, as packed pieces."""
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf_dir)


_OP8_SQL = """
with cut as (
  select page_id, case when position('://' in url) > 0 then substring(url, position('://' in url) + 3) end as tail from pages
), parts as (
  select page_id,
    coalesce(translate(regexp_extract(tail, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(tail, '^[^/?#]*([^?#]*)', 1), '') as path
  from cut
), rules(h, p, action) as (
  values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best as (
  select host, path, arg_max(h || p, length(h || p) * 1000 + length(h)) as rule, arg_max(action, length(h || p) * 1000 + length(h)) as action
  from (select distinct host, path from parts) d join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
  group by host, path
)
select page_id, parts.host, parts.path, rule, coalesce(action, 'allow') as verdict
from parts left join best on parts.host = best.host and parts.path = best.path
"""

_OP9_SQL = """
with v as (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.n as q, q.vec_id as query_id, c.n as c, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on q.n <> c.n where q.vec_id % 50 = 0
), ranked as (
  select query_id, row_number() over (partition by q order by score desc, vec_id nulls last, c) as rank, vec_id, score from scored
)
select query_id, rank::integer as rank, vec_id, score from ranked where rank <= 5
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_packing,
        op3_byte_bpe,
        op4_embedding_near_dedup,
        op5_secret_scans,
        op6_language_id,
        op7_toxicity,
        op8_url_filters,
        op9_exact_top_k,
        op10_license_scans,
        pipeline,
    )
}
ORACLES: dict[str, str] = {"op8_url_filters": _OP8_SQL, "op9_exact_top_k": _OP9_SQL}
