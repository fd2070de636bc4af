"""Queries of metrics, mixtures and line repair, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import cleaning, metrics
from quarry.plans.sets import query
from quarry.plans.tables import table
from quarry.sources import files


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.round(c, 6).alias(c) for c in df.columns if c not in keep])


@query(
    "with r as (select case when event_id % 15 < 12 then event_id % 15 + 1 end as rank from events) select count(*) as n, "
    + "".join(f"round(avg(case when rank <= {k} then 1.0 else 0.0 end), 6) as recall_{k}, " for k in (1, 5, 10))
    + "round(avg(case when rank <= 10 then 1.0 / rank else 0.0 end), 6) as mrr, round(avg(case when rank <= 10 then 1.0 / log2(rank + 1) else 0.0 end), 6) as ndcg from r"
)
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.col("event_id") % 15
    return _rounded(metrics.retrieval(table(spark, sf_dir, "events").select(F.when(place < 12, place + 1).alias("rank"))), "n")


@query("""
with c as (select event_type, (event_id * 37 % 1000) / 1000.0::double as confidence, user_id % 3 = 0 as correct from events),
b as (select event_type, confidence, correct from c union all select null, confidence, correct from c),
e as (select event_type, greatest(ceil(confidence * 15), 1) as bin, sum(confidence) as sure, sum(correct::int) as hits, count(*) as n from b group by all),
s as (select event_type, sum(n)::bigint as cases, sum(hits) / sum(n) as accuracy, sum(abs(sure - hits)) / sum(n) as ece, (sum(sure) - sum(hits)) / sum(n) as signed_gap from e group by event_type),
t as (select event_type, confidence, count(*) as n, sum((not correct)::int) as w from b group by all),
u as (select *, coalesce(sum(n) over p, 0) as n0, coalesce(sum(w) over p, 0) as w0 from t window p as (partition by event_type order by confidence desc rows between unbounded preceding and 1 preceding)),
k as (select event_type, w0, w, n0, n, unnest(generate_series(1, n)) as i from u),
a as (select event_type, avg((w0 + w * i / n) / (n0 + i)) as aurc from k group by event_type)
select s.event_type, cases, round(accuracy, 6) as accuracy, round(ece, 6) as ece, round(signed_gap, 6) as signed_gap, round(aurc, 6) as aurc from s join a on s.event_type is not distinct from a.event_type
""")
def decision_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") * 37 % 1000 / 1000).alias("confidence"), (F.col("user_id") % 3 == 0).alias("correct"))
    return _rounded(metrics.decisions(cases, "event_type"), "event_type", "cases")


@query(
    "select event_id, round((value - m) / (s + 1e-4), 6) as advantage from (select event_id, value, avg(value) over p as m, stddev_samp(value) over p as s, min(value) over p as lo, max(value) over p as hi from events window p as (partition by user_id)) where lo < hi"
)
def group_advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = metrics.advantages(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "user_id", "value")
    return own.select("event_id", F.round("advantage", 6).alias("advantage"))


@query("""
with w as (select coalesce(source, '') as source, count(*) as n from documents group by 1), r as (select source, n / sum(n) over () * 10000 as raw from w),
q as (select source, raw, floor(raw)::bigint as q from r)
select source, (q + case when row_number() over (order by round(raw - q, 9) desc, source) <= 10000 - sum(q) over () then 1 else 0 end)::bigint as quota from q
""")
def mixture_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = table(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    return metrics.quotas(weights, "source", "n")


@query("""
with d as (select doc_id, md5('7:' || doc_id::varchar) as h, coalesce(n_chars, 0) as n from documents),
b as (select doc_id, n, ('0x' || substring(h, 1, 8))::bigint % 1024 as bucket, h from d)
select doc_id from (select doc_id, sum(n) over (order by bucket, h) - n as earlier from b) where earlier < 200000
""")
def volume_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.volume_capped(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars"), "doc_id", "n_chars", 200_000, seed=7).select("doc_id")


@query(
    "select doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: len(regexp_replace(x, '[ \\t\\r]', '', 'g')) = 0 or "
    "len(regexp_extract_all(x, '[\\x{100}-\\x{2FF}]')) <= 0.25 * len(replace(trim(x, ' \t\r'), ' ', ''))), chr(10)) as text from documents"
)
def sound_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.without_corrupted_lines(F.col("text")).alias("text"))
