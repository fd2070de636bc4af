"""Queries over conversations, embeddings, tokens, events and the star tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import chat, tokens
from quarry.plans.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


_TOKENS = "greatest(1, length(text) // 4)"
_CONV = "with c as (select conv_id, list({'role': role, 'content': coalesce(text, '')} order by turn) as m from conversations group by conv_id) "


@query(
    _CONV + "select conv_id, list_filter([case when m[1].role <> 'system' then 'no_system_start' end, case when not list_contains(list_transform(m, lambda x: x.role), 'assistant') then 'no_assistant' end, "
    "case when len(list_filter(m, lambda x: x.role in ('user', 'tool'))) = 0 then 'no_input' end, case when m[-1].role <> 'assistant' then 'no_assistant_end' end, "
    "case when len(list_filter(m, lambda x: x.content = '')) > 0 then 'empty_message' end], lambda x: x is not null) as issues from c"
)
def chat_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.gathered(table(spark, sf_dir, "conversations")).select("conv_id", chat.issues().alias("issues"))


@query(
    _CONV + "select substring(sha256(array_to_string(list_transform(list_filter(m, lambda x: x.role <> 'system'), lambda x: x.role || ':' || substring(x.content, 1, 200) || '|'), '')), 1, 16) as id, "
    "min(conv_id) as conv_id, count(*) as copies from c group by 1"
)
def chat_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chat.gathered(table(spark, sf_dir, "conversations")).select("conv_id", chat.identity().alias("id"))
    return own.groupBy("id").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))


@query(
    f"select count(*) as n, sum(t)::bigint as tokens, sum(n)::bigint as turns, round(avg(t), 6) as mean, median(t) as median, round(stddev_pop(t), 6) as sd, min(t)::bigint as least, max(t)::bigint as most "
    f"from (select conv_id, sum({_TOKENS}) as t, count(*) as n from conversations group by conv_id)"
)
def chat_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(chat.tokens(F.col("text"))).alias("t"), F.count("*").alias("n"))
    return by.agg(F.count("*").alias("n"), F.sum("t").alias("tokens"), F.sum("n").alias("turns"), F.round(F.avg("t"), 6).alias("mean"), F.median("t").alias("median"), F.round(F.stddev_pop("t"), 6).alias("sd"), F.min("t").alias("least"), F.max("t").alias("most"))


@query(f"select role, count(*) as turns, sum({_TOKENS})::bigint as tokens, round_even(sum({_TOKENS}) / sum(sum({_TOKENS})) over (), 4) as share from conversations group by role")
def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.sum(chat.tokens(F.col("text"))).alias("tokens"))
    return by.withColumn("share", F.bround(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()), 4))


_TERMS = "with t as (select role, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) as term from conversations), c as (select role, term, count(*) as c from t group by all) "


@query(
    _TERMS + ", s as (select role, term, round(c / sum(c) over (partition by role) * (ln((1 + (select count(distinct role) from c)) / (1 + count(*) over (partition by term))) + 1), 6) as score from c) "
    "select role, term, score, rank from (select *, row_number() over (partition by role order by score desc, term) as rank from s) where rank <= 20"
)
def role_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.tfidf(table(spark, sf_dir, "conversations"))


@query(_TERMS + "select role, round(count(distinct term) / sqrt(sum(c)), 4) as diversity from c group by role")
def role_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = chat.role_words(table(spark, sf_dir, "conversations")).groupBy("role", "term").agg(F.count("*").alias("c"))
    return by.groupBy("role").agg(F.round(F.count("*") / F.sqrt(F.sum("c")), 4).alias("diversity"))


@query(
    f"with v as (select conv_id, sum({_TOKENS})::double as t from conversations group by conv_id), r as (select min(t) as lo, max(t) as hi from v), "
    "b as (select least(floor((t - lo) / greatest((hi - lo) / 10, 1)), 9)::bigint as bin from v, r where hi > lo) select bin, count(*) as n from b group by bin"
)
def token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(chat.tokens(F.col("text"))).cast("double").alias("t"))
    r = v.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    step = F.greatest((F.col("hi") - F.col("lo")) / 10, F.lit(1.0))
    bins = v.join(F.broadcast(r)).where("hi > lo").select(F.least(F.floor((F.col("t") - F.col("lo")) / step), F.lit(9)).cast("long").alias("bin"))
    return bins.groupBy("bin").agg(F.count("*").alias("n"))


@query("select turns, count(*) as n from (select conv_id, count(*) as turns from conversations group by conv_id) group by turns")
def turn_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns")).groupBy("turns").agg(F.count("*").alias("n"))


@query("select substring(text, 1, 80) as prompt, count(*) as n from conversations where role = 'system' group by 1 order by n desc, prompt limit 15")
def system_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").where("role = 'system'").groupBy(F.substring("text", 1, 80).alias("prompt")).agg(F.count("*").alias("n"))
    return own.orderBy(F.desc("n"), "prompt").limit(15)


@query(
    "select count(*) as components, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as sd, round(min(x), 6) as least, round(max(x), 6) as most, sum(case when x is null or not isfinite(x) then 1 else 0 end)::bigint as bad, "
    "(select count(*) from embeddings) as vectors, (select count(*) from embeddings where len(list_filter(embedding, lambda x: x <> 0)) = 0) as zeros from (select unnest(embedding)::double as x from embeddings)"
)
def embedding_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("e"))
    x = rows.select(F.explode("e").alias("x"))
    bad = F.count_if(F.col("x").isNull() | F.isnan("x") | (F.abs("x") == float("inf")))
    of_components = x.agg(F.count("*").alias("components"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("sd"), F.round(F.min("x"), 6).alias("least"), F.round(F.max("x"), 6).alias("most"), bad.alias("bad"))
    of_rows = rows.agg(F.count("*").alias("vectors"), F.count_if(~F.exists("e", lambda y: F.coalesce(y != 0, F.lit(False)))).alias("zeros"))
    return of_components.crossJoin(of_rows)  # single rows


@query(
    "select ix, round(sum(x * w) / sum(w), 6) as mean from (select unnest(embedding)::double as x, unnest(generate_series(1, len(embedding))) as ix, (label + 1)::double as w from embeddings) group by ix"
)
def weighted_mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("i", "x"), (F.col("label") + 1.0).alias("w"))
    mean = F.round(F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w"), 6)
    return own.groupBy((F.col("i") + 1).cast("long").alias("ix")).agg(mean.alias("mean"))


_SEG = f"with d as (select doc_id, {_TOKENS} as n from documents) "


@query(
    _SEG + ", j as (select doc_id, n, unnest(generate_series(0, case when n <= 257 then 0 else ceil((n - 1) / 256)::bigint - 1 end)) * 256 as start from d) "
    "select doc_id, start, least(257, n - start) as length from j where least(257, n - start) >= 2"
)
def segments_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", tokens.estimated(F.col("text")).alias("n_tokens"))
    return tokens.segments(docs, 256).select("doc_id", "start", "length")


@query(_SEG + "select doc_id, greatest(0, n - 257) as start, least(257, n - greatest(0, n - 257)) as length from d where least(257, n) >= 2")
def segments_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", tokens.estimated(F.col("text")).alias("n_tokens"))
    return tokens.segments(docs, 256, "end").select("doc_id", "start", "length")


@query(
    "with g as (select user_id, date_trunc('hour', ts) as hour, count(*) as n, sum(value) as v from events group by all) select user_id, hour, n, round(v, 6) as v from g"
)
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("v"))


@query(
    "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all"
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return own.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
