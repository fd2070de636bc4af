"""Queries of training rows from conversations, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import chat, tokens, training
from quarry.plans.sets import query
from quarry.plans.tables import table


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with their turns as (role, content, train); every seventh turn is not learned."""
    item = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content"), (F.col("turn") % 7 != 5).alias("train"))
    held = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("m"))
    return held.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), x["train"].alias("train"))).alias("messages"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("conv_id", training.labelled(F.col("messages"), tokens.code_points).alias("pairs"))


_CODES = "list_transform(list_filter(string_split({}, ''), lambda c: c <> ''), lambda c: unicode(c))"
_LABELLED = (
    "with turns as (select *, row_number() over (partition by conv_id order by turn desc) = 1 as final, role = 'assistant' and turn % 7 <> 5 as learned, coalesce(text, '') as content from conversations), "
    "parts as (select conv_id, turn, "
    f"list_concat(list_concat({_CODES.format(repr('<|im_start|>'))}, {_CODES.format('role || chr(10)')}), list_concat(list_concat({_CODES.format('content')}, {_CODES.format(repr('<|im_end|>'))}), case when final then [] else [10] end)) as ids, "
    "length(role) + 13 as before, length(content) + 10 as own, learned from turns), "
    "marked as (select conv_id, turn, ids, list_transform(ids, lambda x, i: case when learned and i > before and i <= before + own then x else -100 end) as labels from parts), "
    "pairs as (select conv_id, flatten(list(ids order by turn)) as ids, flatten(list(labels order by turn)) as labels from marked group by conv_id) "
)
_SAMPLES = _LABELLED + (
    ", n as (select conv_id, ids, labels, len(ids) - 1 as n, greatest(0, len(ids) - 1 - 600) as cut from pairs), "
    "samples as (select * from (select conv_id, list_slice(ids, cut + 1, n)::int[] as input_ids, list_slice(labels, cut + 2, n + 1)::int[] as labels from n where n >= 4) where len(list_filter(labels, lambda x: x <> -100)) > 0) "
)


@query(_LABELLED + "select conv_id, ids::int[] as ids, labels::int[] as labels from pairs")
def loss_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda c: F.transform("pairs", lambda x: x[c])
    return _pairs(spark, sf_dir).select("conv_id", pick("token").alias("ids"), pick("label").alias("labels"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.samples(_pairs(spark, sf_dir), 600)


@query(_SAMPLES + "select * from samples")
def training_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir)


@query(_LABELLED + "select conv_id, len(ids) - 1 as n from pairs where len(ids) - 1 between 4 and 3000 and len(list_filter(list_slice(labels, 2, len(labels)), lambda x: x <> -100)) > 0")
def training_samples_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.samples(_pairs(spark, sf_dir), 3000, "drop").select("conv_id", F.size("input_ids").alias("n"))


@query(
    _SAMPLES + ", c as (select len(labels) as n, len(list_filter(labels, lambda x: x <> -100)) as learned from samples) "
    "select count(*) as samples, sum(n)::bigint as tokens, sum(learned)::bigint as learned, round(sum(learned) / sum(n), 6) as share, count(*) filter (learned * 10 < n) as sparse from c"
)
def mask_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.mask_statistics(_samples(spark, sf_dir))


_PLACED = _LABELLED + (
    ", lengths as (select conv_id, len(ids) as n, md5('order 3:' || conv_id) as h from pairs), ranked as (select *, row_number() over (order by h, conv_id) - 1 as r from lengths), "
    "placed as (select conv_id, n, (r // 32) * 32 + row_number() over (partition by r // 32 order by n desc, r) - 1 as place from ranked) "
)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).select("conv_id", F.size("pairs").alias("n"))
    return training.length_grouped(rows, "conv_id", "n", 32, 3)


@query(_PLACED + "select conv_id, n, place from placed")
def length_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir)


_BATCHES = _PLACED.replace("with turns", "with recursive turns", 1) + (
    ", w as (select conv_id, n, place, place // 64 as grp, ((n + 127) // 128) * 128 as width, row_number() over (partition by place // 64 order by place) as k from placed), "
    "run as (select distinct grp, 0::bigint as k, 0::bigint as batch, 0::bigint as wide, 0::bigint as held, null::bigint as conv_id from w union all "
    "select grp, k, batch + case when full_ then 1 else 0 end, case when full_ then width else greatest(wide, width) end, case when full_ then 1 else held + 1 end, conv_id from ("
    "select w.grp, w.k, run.batch, run.wide, run.held, w.width, w.conv_id, run.held > 0 and greatest(run.wide, w.width) * (run.held + 1) > 65536 as full_ from run join w on w.grp = run.grp and w.k = run.k + 1)) "
)


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.budget_batches(_placed(spark, sf_dir), "n", "place", 65_536, 128, 64)


@query(_BATCHES + "select conv_id, grp as \"group\", batch from run where k > 0")
def token_budget_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir).select("conv_id", "group", "batch")


@query(
    _SAMPLES + ", b as (select *, conv_id // 8 as batch, max(len(input_ids)) over (partition by conv_id // 8) as longest from samples), p as (select *, ((longest + 63) // 64) * 64 as width from b) "
    "select conv_id, batch, width::int as width, list_concat(input_ids, list_transform(range(width - len(input_ids)), lambda x: 0))::int[] as input_ids, list_concat(labels, list_transform(range(width - len(labels)), lambda x: -100))::int[] as labels from p"
)
def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir).withColumn("batch", F.floor(F.col("conv_id") / 8))
    return training.collated(rows, ("batch",), 64).select("conv_id", "batch", "width", "input_ids", "labels")


@query("select conv_id, turn, ('0x' || substring(md5('split 5:' || conv_id), 1, 12))::bigint::double / 281474976710656 < 0.1 as val from conversations")
def case_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.held_out(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", 0.1, 5)


@query("select doc_id, row_number() over (order by doc_id desc) <= greatest(1, floor(count(*) over () * 0.1)) as val from documents")
def tail_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.tail_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.1)


_PAIRS = (
    "with t as (select conv_id, turn, role, text as prompt, lead(role) over w as next, lead(text) over w as response from conversations window w as (partition by conv_id order by turn)), "
    "p as (select conv_id, turn, trim(coalesce(prompt, ''), ' \n\t\r') as prompt, trim(coalesce(response, ''), ' \n\t\r') as response from t where role = 'user' and next = 'assistant') "
)


def _turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.usable_pairs(training.turn_pairs(table(spark, sf_dir, "conversations")))


@query(_PAIRS + "select * from p where prompt <> '' and length(response) >= 10")
def usable_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turn_pairs(spark, sf_dir)


@query(_PAIRS + "select md5(lower(prompt || '|' || response)) as key, min({'conv_id': conv_id, 'turn': turn}).conv_id as conv_id, min({'conv_id': conv_id, 'turn': turn}).turn as turn, count(*) as copies from p where prompt <> '' and length(response) >= 10 group by 1")
def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.distinct_pairs(_turn_pairs(spark, sf_dir), ["conv_id", "turn"])


@query(
    "with c as (select conv_id, md5(array_to_string(list_filter(list(case when role in ('user', 'assistant') then lower(trim(coalesce(text, ''), ' \n\t\r')) end order by turn), lambda x: x is not null), '|')) as key from conversations group by conv_id), "
    "u as (select key, conv_id, 0 as origin from c where conv_id % 3 = 0 union all select key, conv_id, 1 from c) "
    "select key, min({'origin': origin, 'conv_id': conv_id}).conv_id as conv_id, min({'origin': origin, 'conv_id': conv_id}).origin as origin from u group by key"
)
def merged_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third conversation as a dataset of its own before all of them: where both have a dialogue, its row wins."""
    own = chat.gathered(table(spark, sf_dir, "conversations")).select("conv_id", training.dialogue_key(F.col("messages")).alias("key"))
    return training.merged_datasets([own.where("conv_id % 3 = 0"), own], "key", "conv_id")


@query(_PAIRS + "select conv_id, turn from p where length(prompt) <= 200 and length(response) <= 900 and prompt <> '' and length(response) >= 10")
def fitting_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides of a prompt of up to 200 and a response of up to 900 code points."""
    short = training.fitting_pairs(_turn_pairs(spark, sf_dir), tokens.code_points, 200, ("prompt",))
    return training.fitting_pairs(short, tokens.code_points, 900, ("response",)).select("conv_id", "turn")


@query(
    "with g as (select user_id, floor(value) as answer, min(event_id) as event_id from events where value >= 10 group by all) select user_id, answer::bigint as answer, event_id, rank::int as rank from (select *, row_number() over (partition by user_id order by event_id) as rank from g) where rank <= 2"
)
def rejection_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = table(spark, sf_dir, "events").select("user_id", F.floor("value").alias("answer"), "event_id", "value")
    return training.winners(tries, "user_id", "answer", "value", "event_id", 10.0)


_BATCH = "with r as (select vec_id, vec_id // 16 as batch, label, embedding from embeddings where vec_id < 1600), p as (select a.batch, a.vec_id as i, b.vec_id as j, a.label <> b.label as allowed, a.embedding as x, b.embedding as y from r a join r b on a.batch = b.batch) "


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 16).alias("batch"), "label", F.col("embedding").cast("array<double>").alias("x"))


@query(_BATCH.replace(" where vec_id < 1600", "") + "select batch, i, j, coalesce(allowed, true) as allowed from p where i <> j")
def foreign_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.foreign(_vectors(spark, sf_dir), "batch", "vec_id", "label")


@query(
    _BATCH.replace(" where vec_id < 1600", "") + ", s as (select batch, i, j, list_sum(list_transform(list_zip(x, list_concat(list_slice(y, 2, len(y)), [y[1]])), lambda z: z[1]::double * z[2]::double)) as score from p where i = j or coalesce(allowed, true)), "
    "b as (select batch, i, arg_max(j, {'s': round(score, 9), 'j': -j}) as found from s group by all) select count(*) as queries, round(avg(case when found = i then 1.0 else 0.0 end), 6) as accuracy from b"
)
def in_batch_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the vectors, answers the same ones turned by one place."""
    rows = _vectors(spark, sf_dir)
    allowed = training.foreign(rows, "batch", "vec_id", "label").unionByName(rows.select("batch", F.col("vec_id").alias("i"), F.col("vec_id").alias("j"), F.lit(True).alias("allowed")))
    turned = F.concat(F.slice("x", 2, F.size("x") - 1), F.slice("x", 1, 1))
    both = allowed.join(rows.select(F.col("vec_id").alias("i"), F.col("x").alias("p")), "i").join(rows.select(F.col("vec_id").alias("j"), turned.alias("q")), "j")
    score = F.aggregate(F.zip_with("p", "q", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return training.in_batch_accuracy(both.select("batch", "i", "j", "allowed", F.round(score, 9).alias("score")))
