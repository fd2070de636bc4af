"""Queries of token windows, packing and mixtures, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import metrics, tokens
from quarry.plans.sets import query
from quarry.plans.tables import table

_SIZE = 1024


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 4096).alias("shard_ix"), tokens.estimated(F.col("text")).alias("n_tokens"))
    return tokens.packed(tokens.segments(docs, _SIZE).drop("n_tokens"), _SIZE + 1)


#: One piece a step, in the order of best fit: the rooms of a shard's windows are a list.
_FIT = """
with recursive d as (select doc_id, doc_id // 4096 as shard_ix, greatest(1, length(text) // 4) as n from documents),
p as (
  select *, row_number() over (partition by shard_ix order by length desc, doc_id, start) as k from (
    select doc_id, shard_ix, j * 1024 as start, least(1025, n - j * 1024) as length
    from (select *, unnest(range(case when n <= 1025 then 1 else ((n - 1) + 1023) // 1024 end)) as j from d)
  ) where length >= 2
), fit as (
  select distinct shard_ix, 0::bigint as k, []::bigint[] as rooms, 0::bigint as slot, null::bigint as doc_id, null::bigint as start, null::bigint as length from p
  union all
  select shard_ix, k, case when slot > len(rooms) then list_append(rooms, 1025 - length) else list_transform(rooms, lambda x, i: case when i = slot then x - length else x end) end, slot, doc_id, start, length
  from (
    select p.shard_ix, p.k, f.rooms, p.doc_id, p.start, p.length,
      coalesce(list_position(f.rooms, list_min(list_filter(f.rooms, lambda x: x >= p.length))), len(f.rooms) + 1)::bigint as slot
    from fit f join p on p.shard_ix = f.shard_ix and p.k = f.k + 1
  )
)
"""


@query(_FIT + "select doc_id, start, length, shard_ix, slot - 1 as window_ix from fit where k > 0")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).select("doc_id", "start", "length", "shard_ix", "window_ix")


@query(
    _FIT + ", w as (select shard_ix, slot, sum(length) as held from fit where k > 0 group by all), x as (select count(*) as windows, sum(held) as held from w), "
    "y as (select count(*) as docs, sum(n) as tokens, count(*) filter (n > 1025) as cut from d), z as (select coalesce(sum(length - 1) filter (start > 0), 0) as away from fit where k > 0) "
    "select docs, windows, round(cut / docs, 6) as cut_share, round((windows * 1025 - held) / (windows * 1025), 6) as padding_share, round(away / tokens, 6) as no_start_share from x, y, z"
)
def packing_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", tokens.estimated(F.col("text")).alias("n_tokens"))
    return tokens.packing_statistics(_pieces(spark, sf_dir), docs, _SIZE)


def _steps(x: str) -> str:
    """One pass of the permutation in SQL: shift and mask are columns of the row."""
    for factor, addend in tokens.round_keys(7):
        x = f"list_transform([({x} * {factor} + {addend}) & mask], lambda y: xor(y, y >> fold))[1]"
    return x


@query(
    "with w as (select doc_id as i, (select max(doc_id) + 1 from documents) as n from documents), b as (select *, case when n <= 2 then 1 else length(ltrim(bin(n - 1), '0')) end as bits from w), "
    f"m as (select i, n, (1::bigint << bits) - 1 as mask, ((bits + 1) // 2)::int as fold from b), p as (select i, n, list_reduce(range(2, 65), lambda x, k: case when x < n then x else {_steps('x')} end, {_steps('i')}) as position from m) "
    "select i as window_ix, position from p"
)
def permuted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("window_ix"))
    last = docs.agg(F.max("window_ix")).first()[0]
    return tokens.permutation(docs, "window_ix", 1 if last is None else last + 1, 7)


def _quotas(spark: SparkSession, sf_dir: str, block: int) -> DataFrame:
    weights = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.sum("n_chars").cast("double").alias("weight"))
    return metrics.quotas(weights, "name", "weight", block)


_QUOTAS = """
with w as (select source as name, sum(n_chars)::double as weight from documents group by 1),
raw as (select name, weight / sum(weight) over () * 1000 as raw from w),
f as (select name, raw, floor(raw) as q from raw),
quotas as (select name, (q + case when row_number() over (order by round(raw - q, 9) desc, name) <= 1000 - sum(q) over () then 1 else 0 end)::bigint as quota from f),
block as (select row_number() over (order by (k * 2 - 1) / (quota * 2), name) - 1 as position, name, k - 1 as local from (select *, unnest(range(1, quota + 1)) as k from quotas))
"""


@query(_QUOTAS + "select * from block")
def mixture_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.interleaved(_quotas(spark, sf_dir, 1000))


@query(_QUOTAS + "select event_id as k, name, 5 + ((event_id - 0) // 1000) * quota + local as sample from events join block on event_id % 1000 = position join quotas using (name)")
def sample_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotas = _quotas(spark, sf_dir, 1000)
    bases = quotas.select("name", F.lit(5).cast("long").alias("base"))
    return tokens.located(table(spark, sf_dir, "events").select(F.col("event_id").alias("k")), tokens.interleaved(quotas), quotas, bases, 1000)


@query(_QUOTAS + "select name, quota * 2 + count(block.name) as base from quotas left join block using (name) where position is null or position < 345 group by name, quota")
def mixture_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotas = _quotas(spark, sf_dir, 1000)
    return tokens.given(quotas, quotas.select("name", F.lit(0).cast("long").alias("base")), tokens.interleaved(quotas), 1000, 2345)


_POINTS = "with t as (select {id}, list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: unicode(c)) as tokens from {table}) "


def _points(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return table(spark, sf_dir, name).select(key, tokens.code_points(F.col("text")).alias("tokens"))


@query(_POINTS.format(id="item_id", table="benchmark") + "select item_id, j::int as window_ix, list_slice(tokens, j * 64 + 1, j * 64 + 65) as ids from (select *, unnest(range((len(tokens) - 1) // 64)) as j from t)")
def consecutive_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.windows(_points(spark, sf_dir, "benchmark", "item_id"), 64)


@query(
    _POINTS.format(id="item_id", table="benchmark")
    + "select item_id, list_slice(ids, 1, len(ids) - 1) as inputs, list_slice(ids, 2, len(ids)) as targets, list_transform(range(1, len(ids) + 1), lambda k: len(list_filter(list_slice(ids, 1, k), lambda x: x = 32)))::int[] as documents from (select item_id, list_slice(tokens, 1, 65) as ids from t where len(tokens) >= 65)"
)
def causal_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs, targets, and the number of the document at each position, a blank standing for the mark that begins one."""
    first = tokens.windows(_points(spark, sf_dir, "benchmark", "item_id"), 64).where("window_ix = 0")
    inputs, targets = tokens.shifted(F.col("ids"))
    return first.select("item_id", inputs.alias("inputs"), targets.alias("targets"), tokens.document_numbers(F.col("ids"), 32).alias("documents"))


_ASSEMBLED = """
with d as (select item_id as doc_id, list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: unicode(c)) as tokens from benchmark),
p as (select doc_id, doc_id // 4 as window_ix, 0 as start, list_slice(tokens, 1, 40) as ids from d where len(tokens) >= 2),
w as (select window_ix, flatten(list(ids order by doc_id)) as flat, flatten(list(list_transform(ids, lambda x: r) order by doc_id)) as part, count(*) as n from (select *, row_number() over (partition by window_ix order by doc_id) - 1 as r from p) group by window_ix),
f as (select window_ix, list_concat(flat, list_transform(range(161 - len(flat)), lambda x: 0)) as ids, list_concat(part, list_transform(range(161 - len(part)), lambda x: n)) as segment, n from w)
select 0::bigint as shard_ix, window_ix, ids::int[] as ids, segment::int[] as segment, list_transform(range(1, 161), lambda t: case when segment[t] = segment[t + 1] and segment[t] < n then ids[t + 1] else -100 end)::int[] as labels from f
"""


@query(_ASSEMBLED)
def window_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _points(spark, sf_dir, "benchmark", "item_id").where(F.size("tokens") >= 2)
    pieces = docs.select(F.col("item_id").alias("doc_id"), F.lit(0).cast("long").alias("shard_ix"), F.floor(F.col("item_id") / 4).alias("window_ix"), F.lit(0).alias("start"), F.slice("tokens", 1, 40).alias("ids"))
    return tokens.assembled(pieces, 160, 0)


def _shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 64).alias("shard_ix")).agg(F.sum(tokens.estimated(F.col("text"))).alias("n_tokens"))


_SHARDS = """
with s as (select doc_id // 64 as shard_ix, sum(greatest(1, length(text) // 4))::bigint as n_tokens from documents group by 1),
c as (select *, sum((n_tokens - 1) // 256) over (order by shard_ix)::bigint as last from s), r as (select shard_ix, (n_tokens - 1) // 256 as windows, last, last - (n_tokens - 1) // 256 as first from c)
"""


@query(_SHARDS + "select event_id, shard_ix, p - first as window_in_shard from (select event_id, event_id * 7 % (select max(last) from r) as p from events) join r on p >= first and p < last")
def window_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows counted over all shards, each found in its shard by cumulative counts."""
    ranges = tokens.cumulative(_shards(spark, sf_dir).withColumn("windows", F.floor((F.col("n_tokens") - 1) / 256)), "windows", "shard_ix")
    total = ranges.agg(F.max("last")).first()[0]
    events = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 7 % total).alias("position"))
    return tokens.placed(events, ranges).select("event_id", "shard_ix", "window_in_shard")


@query(_SHARDS + "select shard_ix, windows, first, last from r")
def cumulative_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.cumulative(_shards(spark, sf_dir).withColumn("windows", F.floor((F.col("n_tokens") - 1) / 256)), "windows", "shard_ix").select("shard_ix", "windows", "first", "last")


def _uniform(name: str) -> str:
    return f"(('0x' || substring(md5('{name} 3:' || event_id), 1, 12))::bigint::double / 281474976710656)"


@query(
    "with s as (select doc_id // 64 as shard_ix, sum(greatest(1, length(text) // 4))::bigint as n_tokens from documents group by 1), r as (select *, sum(n_tokens) over (order by shard_ix)::bigint as last from s where n_tokens > 257), "
    f"k as (select event_id as k, floor({_uniform('shard')} * (select max(last) from r))::bigint as p, {_uniform('offset')} as u from events) "
    "select k, shard_ix, floor(u * (n_tokens - 257))::bigint as \"offset\" from k join r on p < last and p >= last - n_tokens"
)
def random_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.random_windows(table(spark, sf_dir, "events").select(F.col("event_id").alias("k")), _shards(spark, sf_dir), 256, 3)


@query(
    "with s as (select distinct doc_id // 64 as shard_ix from documents), n as (select count(*) as n from s) select shard_ix, case when row_number() over (order by shard_ix desc) <= case when n > 1 then greatest(1, round_even(n * 0.2, 0)::int) else 0 end then 'val' else 'train' end as split from s, n"
)
def split_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.split_of(_shards(spark, sf_dir).select("shard_ix"), "shard_ix", share=0.2)


@query(
    "select source, doc_id, ix::int as ix, (ix % 3)::int as rank, ((ix // 3) // 4)::int as batch_ix from (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 as ix from documents) where ix < 30"
)
def validation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.validation_plan(table(spark, sf_dir, "documents").select("source", "doc_id"), "doc_id", 30, 3, 4, "source")


@query("select doc_id, i::int as slice, substring(text, i * 4000 + 1, 4000) as text from (select doc_id, text, unnest(range(case when length(text) > 0 then (length(text) - 1) // 4000 + 1 else 0 end)) as i from documents)")
def text_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tokens.text_slices(F.col("text"), 4000)).alias("slice", "text"))


@query(
    "with s as (select source, sum(n_chars)::bigint as size from documents group by 1) select source, size, least(size, greatest(1, floor(size / sum(size) over () * 100000 / 1000 + 0.5)) * 1000)::bigint as budget from s"
)
def sampling_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.shares(table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("size")), "size", 100_000, 1000)


def _snapshots(spark: SparkSession, sf_dir: str) -> Column:
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("snapshot"), "embedding")


@query(
    "with w as (select label as snapshot, avg(x) as x, i as ix from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as i from embeddings) group by label, i), "
    "j as (select *, dense_rank() over (order by snapshot) as j, (select count(distinct label) from embeddings) as n from w) select ix::int as ix, round(sum(x * (sqrt(j / n) - sqrt((j - 1) / n))), 6) as value from j group by ix"
)
def merged_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted mean, element by element, of the mean vectors of all labels, as if each were a snapshot, with falling weights."""
    each = _snapshots(spark, sf_dir).select("snapshot", F.posexplode(F.col("embedding").cast("array<double>")).alias("ix", "x")).groupBy("snapshot", "ix").agg(F.avg("x").alias("x"))
    order = [r.snapshot for r in each.select("snapshot").distinct().orderBy("snapshot").collect()]  # a row for each snapshot
    weight = F.create_map(*[F.lit(x) for s, w in zip(order, tokens.merge_weights(len(order), "1sqrt"), strict=True) for x in (s, w)])
    return each.groupBy("ix").agg(F.round(F.sum(F.col("x") * F.element_at(weight, F.col("snapshot"))), 6).alias("value"))
