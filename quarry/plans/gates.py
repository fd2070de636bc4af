"""Queries of filter objects, gates, pages, shuffles and encoding, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import gates
from quarry.plans.corpus import _W
from quarry.plans.sets import query
from quarry.plans.tables import table

#: A chain of three filters, the second of which rewrites what the third sees.
STEPS = [
    gates.Filter("length", lambda t: F.when(F.length(t) < 200, "short")),
    gates.Filter("digits", rewrite=lambda t: F.regexp_replace(t, "[0-9]+", "#")),
    gates.Filter("marks", lambda t: F.when(F.regexp_count(t, F.lit("#")) > 3, "many_numbers")),
]


@query(
    "with d as (select doc_id, coalesce(text, '') as t from documents), r as (select doc_id, t, regexp_replace(t, '[0-9]+', '#', 'g') as s from d), v as (select *, case when length(t) < 200 then 'length' when length(s) - length(replace(s, '#', '')) > 3 then 'marks' end as filter from r) "
    "select doc_id, md5(case when filter = 'length' then t else s end) as digest, filter, case filter when 'length' then 'short' when 'marks' then 'many_numbers' end as reason, filter is null as kept from v"
)
def filter_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gates.chained(table(spark, sf_dir, "documents"), STEPS)
    return found.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "filter", "reason", "kept")


_PERPLEXITY = (
    "with w as (select doc_id, unnest(" + _W.format("lower(text)") + ") as w from documents), c as (select doc_id, w, count(*) as c from w group by all), n as (select w, sum(c) as n from c group by w), t as (select sum(n) as s, count(*) as k from n), "
    "p as (select doc_id, exp(sum(c * -ln((n + 1) / (s + k))) / sum(c)) as perplexity from c join n using (w), t group by doc_id), g as (select doc_id, perplexity from documents left join p using (doc_id)) "
)


@query(_PERPLEXITY + "select doc_id, round(perplexity, 4) as perplexity, case when perplexity < 5 then 'low_perplexity' when perplexity > 1500 then 'high_perplexity' end as reason from g")
def perplexity_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gates.unigram_perplexity(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.round("perplexity", 4).alias("perplexity"), gates.perplexity_gate(F.col("perplexity")).alias("reason"))


@query(
    "select doc_id, case when doc_id % 4 = 3 or text is null then text else substring(text, 1, 5) || '<PERSONA>' || substring(text, 13, 8) || case when doc_id % 2 = 0 then '<DATA>' || substring(text, 26) else substring(text, 21) end end as text from documents where length(text) > 40"
)
def entity_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities at fixed places, one overlapping, one of a low score, one of an unknown label; every fourth text has none."""
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 40)
    each = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(n).alias("label"), F.lit(s).alias("score")) for a, b, n, s in ((5, 12, "PERSON", 0.9), (8, 14, "LOCATION", 0.9), (30, 34, "PERSON", 0.1), (35, 38, "OTHER", 0.9))])
    date = F.array(F.struct(F.lit(20).alias("start"), F.lit(25).alias("end"), F.lit("DATE_TIME").alias("label"), F.lit(0.5).alias("score")))
    found = docs.where("doc_id % 4 <> 3").select("doc_id", F.explode(F.when(F.col("doc_id") % 2 == 0, F.concat(each, date)).otherwise(each)).alias("x"))
    return gates.entities_redacted(docs, found.select("doc_id", "x.*"))


@query()
def paged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of their source under a running head; every third page is a table of codes and goes."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x20-\x7e\n]", "e")
    table_page = F.repeat(F.lit("an..35 n1 9x HER/1/2- "), 12)
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("page"), F.when(F.col("doc_id") % 3 == 0, table_page).otherwise(F.concat(F.lit("Head 7\n"), text)).alias("text"))
    return gates.paged_documents(pages).select("path", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("select doc_id, row_number() over (order by md5('shuffle 9:' || doc_id), doc_id) - 1 as place from documents")
def global_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 9)


@query("select doc_id, null::bigint as lost from documents")
def round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text comes back from its ids, as a byte-level vocabulary loses nothing."""
    import public_tokenizers

    found = gates.round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", F.col("lost").cast("long").alias("lost"))


@query("select event_type, count(*) as n, sum((props->>'k')::bigint)::bigint as total, count(*) filter (props->>'k' is null) as without from events group by event_type")
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures on a JSON column, read as a variant."""
    value = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").select("event_type", value.alias("k")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.count_if(F.col("k").isNull()).alias("without"))
