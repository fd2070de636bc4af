"""Queries of corpus, chat, vocabulary, decision and run figures, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import analytics as an
from quarry.operators import tokens
from quarry.plans.sets import query
from quarry.plans.tables import table


def _matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which two in three begin with a block of metadata."""
    head = F.concat(F.lit("---\ntitle: Regulation "), F.col("doc_id").cast("string"), F.lit("\nlang : "), F.coalesce("lang", F.lit("")), F.lit("\ntitle: Text "), (F.col("doc_id") % 7).cast("string"), F.lit("\n---\n"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.when(F.col("doc_id") % 3 < 2, head).otherwise(""), F.coalesce("text", F.lit(""))).alias("text"))


_MATTER = """
with d as (select doc_id, source, case when doc_id % 3 < 2 then '---' || chr(10) || 'title: Regulation ' || doc_id || chr(10) || 'lang : ' || coalesce(lang, '') || chr(10) || 'title: Text ' || doc_id % 7 || chr(10) || '---' || chr(10) else '' end || coalesce(text, '') as text, lang from documents),
m as (select doc_id, source, length(text) as chars, case when doc_id % 3 < 2 then 'Text ' || doc_id % 7 end as title, lang, length(regexp_extract(text, '^---\\s*\\n(?s:.*?)\\n---\\s*\\n')) as metadata from d)
"""


@query(_MATTER + "select doc_id, metadata, title, case when doc_id % 3 < 2 then coalesce(lang, '') end as lang from m")
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, chars = an.front_matter(F.col("text"))
    own = _matter(spark, sf_dir).select("doc_id", found.alias("m"), chars.alias("metadata"))
    return own.select("doc_id", "metadata", F.try_element_at("m", F.lit("title")).alias("title"), F.try_element_at("m", F.lit("lang")).alias("lang"))


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, chars = an.front_matter(F.col("text"))
    docs = _matter(spark, sf_dir).select("doc_id", "source", F.length("text").alias("chars"), chars.alias("metadata"), F.try_element_at(found, F.lit("title")).alias("title"))
    return an.source_profile(docs)


_PROFILE = _MATTER + """, s as (select source, count(*) as docs, sum(chars)::bigint as chars, sum(metadata)::bigint as metadata, sum(chars - metadata)::bigint as content, sum(greatest(1, (chars - metadata) // 4))::bigint as tokens,
  list_slice(list(coalesce(title, '') order by doc_id), 1, 5) as titles from m group by source),
profile as (select *, round(docs / sum(docs) over () * 100, 4) as doc_share, round(tokens / sum(tokens) over () * 100, 4) as token_share, round(metadata / greatest(chars, 1) * 100, 4) as metadata_share from s)
"""


@query(_PROFILE + "select * from profile")
def source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir)


@query(
    _PROFILE + ", t as (select sum(tokens) as t, sum(chars) as c, sum(metadata) as m from profile), q as (select *, case when source = 'src1' then 'chat' when source = 'src2' then 'legal' else source end as name from profile) "
    "select 'metadata' as finding, null as source, round(m / greatest(c, 1) * 100, 4) as value from t where m * 100 > 5 * greatest(c, 1) "
    "union all select 'little_chat', name, round(tokens / t * 100, 4) from q, t where name = 'chat' and tokens / t * 100 < 10 "
    "union all select 'dominant', name, round(tokens / t * 100, 4) from q, t where tokens / t * 100 > 70 "
    "union all select 'legal', null, round(l / t * 100, 4) from t, (select sum(case when name = 'legal' then tokens else 0 end + len(list_filter(titles, lambda x: regexp_matches(lower(x), 'regulation|regolamento|directive|direttiva|legal'))) * (tokens // docs)) as l from q) where l > t * 0.15"
)
def corpus_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as if one source were chat and one legal texts."""
    name = F.when(F.col("source") == "src1", "chat").when(F.col("source") == "src2", "legal").otherwise(F.col("source"))
    return an.imbalance(_profile(spark, sf_dir).withColumn("source", name))


def _names(words: str) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words.split()) + ")"


_WORDS = "with w as (select role, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) as w from conversations) "
_RATIOS = _WORDS + ", ratios as (select role, " + ", ".join(f"round_even(count(*) filter (w in {_names(x)}) / count(*), 4) as {k}_ratio" for k, x in an.LEXICONS.items()) + " from w group by role) "


@query(_RATIOS + "select * from ratios")
def lexicon_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.lexicon_ratios(table(spark, sf_dir, "conversations").select("role", "text"))


@query(
    "with t as (select regexp_extract_all(lower(text), '[a-z]{2,}') as w from conversations), g as (select list_slice(w, i, i + 2) as g from (select w, unnest(range(1, len(w) - 1)) as i from t where len(w) >= 3)), "
    f"c as (select g, count(*) as n from g group by g) select array_to_string(g, ' ') as gram, n from c where len(list_filter(g, lambda x: x not in {_names(an.STOP_WORDS)})) > 0 order by n desc, gram limit 15"
)
def trigram_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.hotspots(table(spark, sf_dir, "conversations").select("text"))


@query(
    _RATIOS + ", s as (select role, sum(greatest(1, length(text) // 4)) / sum(sum(greatest(1, length(text) // 4))) over () as share from conversations group by role), d as (select role, count(distinct w) / sqrt(count(*)) as diversity from w group by role), "
    "f as (select 'positive' as finding, role, positive_ratio / negative_ratio as value from ratios where positive_ratio > 0 and negative_ratio > 0 and positive_ratio / negative_ratio > 3 "
    "union all select 'negative', role, positive_ratio / negative_ratio from ratios where positive_ratio > 0 and negative_ratio > 0 and positive_ratio / negative_ratio < 0.5 "
    "union all select 'hedging', role, hedging_ratio from ratios where hedging_ratio > 0.02 union all select 'authority', role, authority_ratio from ratios where authority_ratio > 0.02 "
    "union all select 'dominance', arg_max(role, share), max(share) from s having count(*) >= 2 and max(share) > 0.75 "
    "union all select 'diversity', arg_min(role, diversity), min(diversity) / max(diversity) from d having count(*) >= 2 and max(diversity) > 0 and min(diversity) / max(diversity) < 0.7) select finding, role, round(value, 6) as value from f"
)
def bias_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("role", "text")
    sums = turns.groupBy("role").agg(F.sum(tokens.estimated(F.col("text"))).alias("n"))
    whole = sums.agg(F.sum("n").alias("t"))
    shares = sums.crossJoin(F.broadcast(whole)).select("role", (F.col("n") / F.col("t")).alias("share"))  # one row
    words = turns.select("role", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("w")).groupBy("role", "w").agg(F.count("*").alias("n"))
    diversity = words.groupBy("role").agg((F.count("*") / F.sqrt(F.sum("n"))).alias("diversity"))
    return an.bias_findings(an.lexicon_ratios(turns), shares, diversity)


_EMITTED = "with t as (select text, list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: unicode(c)) as tokens from documents where text is not null), c as (select token, count(*) as n from (select unnest(tokens) as token from t) group by token) "


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("text", tokens.code_points(F.col("text")).alias("tokens"))


@query(_EMITTED + "select token, n from c")
def emission_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.emission_counts(_coded(spark, sf_dir))


@query(_EMITTED + "select sum(len(tokens))::bigint as tokens, round(sum(strlen(text)) / sum(len(tokens)), 6) as bytes_per_token, round(sum(length(text)) / sum(len(tokens)), 6) as chars_per_token, round((select count(*) from c) / 1000, 6) as used_share from t")
def tokenizer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.tokenizer_quality(_coded(spark, sf_dir), 1000)


_GONE = _EMITTED + ", r as (select v.token::int as token, coalesce(n, 0) as n from (select unnest(range(300)) as token) v left join c on v.token = c.token where v.token >= 32 and coalesce(n, 0) < (select sum(n) from c) * 0.00005) "


def _residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.range(300).select(F.col("id").cast("int").alias("token"))
    return an.residues(ids, an.emission_counts(_coded(spark, sf_dir)), ids.where("token < 32"))


@query(_GONE + "select token, n from r")
def token_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _residues(spark, sf_dir)


@query(
    _GONE + ", m as (select unnest(range(400)) as rank) select rank, chr((rank % 26 + 97)::int) as \"left\", chr((rank % 23 + 97)::int) as \"right\" from m where (rank * 7 % 300) not in (select token from r)"
)
def pruned_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges of two letters, without those whose token is hardly given out; the token of a merge follows from its rank."""
    letter = lambda n: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.col("rank").cast("int") % n + 1, F.lit(1))
    merges = spark.range(400).select(F.col("id").alias("rank")).select("rank", letter(26).alias("left"), letter(23).alias("right"))
    made = merges.select((F.col("rank") * 7 % 300).cast("int").alias("token"), "rank")
    gone = made.join(_residues(spark, sf_dir), "token").select("rank")
    names = merges.join(gone, "rank").select(F.concat("left", "right").alias("token"))
    return an.pruned_merges(merges, names)


@query(
    "with d as (select doc_id, case when doc_id % 4 = 0 then 'source: wiki wiki_id: 12' || chr(10) || '---' || chr(10) || text when doc_id % 4 = 1 then 'timestamp: 2020 language: it categories:  ' || text else text end as t from documents) select doc_id, "
    "list_concat(list_concat(list_concat(regexp_extract_all(t, 'source:\\s*\\w+'), regexp_extract_all(t, 'wiki_id:\\s*\\d+')), list_concat(regexp_extract_all(t, 'timestamp:\\s*\\d{4}'), regexp_extract_all(t, 'language:\\s*\\w{2}'))), list_concat(regexp_extract_all(t, 'categories:\\s*'), regexp_extract_all(t, '(?m)^---\\s*$'))) as leaks from d where t is not null"
)
def metadata_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    put = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("source: wiki wiki_id: 12\n---\n"), text)).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("timestamp: 2020 language: it categories:  "), text)).otherwise(text)
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", an.leaks(put).alias("leaks"))


@query(
    "with d as (select doc_id, case when doc_id % 9 = 0 then upper(text) else text end as t from documents where text is not null), w as (select *, list_filter(regexp_split_to_array(t, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+'), lambda x: x <> '') as w from d) "
    f"select doc_id, len(list_filter(w, lambda x: lower(x) in {_names(' '.join(an.ITALIAN))})) > 0 as italian_words, regexp_matches(t, '[.!?;:]') as punctuation, not (upper(t) = t and lower(t) <> t) and len(w) > 3 as casing, len(list_filter(w, lambda x: length(x) > 3)) > len(w) * 0.3 as content_words from w"
)
def italian_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.when(F.col("doc_id") % 9 == 0, tx.simple_upper(F.col("text"))).otherwise(F.col("text")).alias("text"))
    return own.select("doc_id", *an.italian_marks(F.col("text")))


_SUSPECT_WORDS = "with d as (select doc_id, list_filter(regexp_split_to_array(text, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+'), lambda x: x <> '') as w from documents), e as (select doc_id, w, unnest(w) as raw, generate_subscripts(w, 1) - 1 as place from d), t as (select *, trim(raw, '" + an.EDGES.replace("'", "''") + "') as word from e) "


@query(
    _SUSPECT_WORDS + ", k as (select lower(word) as word from t group by 1 having count(distinct doc_id) >= 3) select doc_id, place::int as place, word, array_to_string(list_slice(w, greatest(place - 3, 0) + 1, place + 4), ' ') as context from t "
    "where regexp_matches(word, '^\\p{L}{5,29}$') and not regexp_matches(word, '^(?:[A-ZÀ-Ú]{2,}|[A-ZÀ-Ú][a-zà-ú]+)$') and lower(word) not in (select word from k)"
)
def suspicious_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that fewer than three documents hold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = docs.select("doc_id", F.explode(tx.words(F.col("text"))).alias("w")).select("doc_id", F.lower(F.btrim("w", F.lit(an.EDGES))).alias("word")).distinct()
    return an.suspects(docs, words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 3").select("word"))


@query("select doc_id, " + ", ".join(f"(length(t) - length(replace(t, '{c}', '')))::int as n_{ord(c):x}" for c in an.ACCENTED) + ", len(regexp_extract_all(t, '\\p{M}'))::int as combining, least(10, len(regexp_extract_all(t, '[\\p{L}\\p{N}\\p{M}_]{3,}  [\\p{L}\\p{N}\\p{M}_]{3,}')))::int as gaps from (select doc_id, case when doc_id % 5 = 0 then replace(replace(text, 'é', ' '), 'è', 'e' || chr(768)) else text end as t from documents where text is not null)")
def accent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = F.replace(F.replace(F.col("text"), F.lit("\u00e9"), F.lit(" ")), F.lit("\u00e8"), F.lit("e\u0300"))
    own = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.when(F.col("doc_id") % 5 == 0, damaged).otherwise(F.col("text")).alias("text"))
    return own.select("doc_id", *an.accents(F.col("text")))


_RANKS = (
    "with v as (select vec_id, list_transform(embedding, lambda x: x::double) as x from embeddings), q as (select vec_id as query, vec_id + 1 as gold, x from v where vec_id % 50 = 0), g as (select query, gold, q.x, round(list_inner_product(q.x, v.x), 9) as own from q join v on v.vec_id = gold), "
    "r as (select query, count(*) filter (round(list_inner_product(g.x, v.x), 9) > own or (round(list_inner_product(g.x, v.x), 9) = own and vec_id < gold)) + 1 as rank from g, v group by query) "
)


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    return an.ranked_among_all(vectors, vectors.where("id % 50 = 0").select(F.col("id").alias("query"), (F.col("id") + 1).alias("gold"), "x"))


@query(_RANKS + "select query, rank from r")
def gold_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(spark, sf_dir)


@query(_RANKS + "select count(*) as queries, round(avg((rank <= 1)::int), 6) as recall_1, round(avg((rank <= 5)::int), 6) as recall_5, round(avg(1 / rank), 6) as mrr from r")
def full_rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.rank_metrics(_ranks(spark, sf_dir))


#: Shares of three options, and shares given for them, from the number of an event; kinds in turn.
_P = "list_transform([1 + event_id % 7, 1 + event_id % 5, 1 + event_id % 11], lambda x: x / (3 + event_id % 7 + event_id % 5 + event_id % 11)::double)"
_T = "case when event_id % 4 = 0 then null else map(['a', 'b', 'z'], [(event_id % 3)::double, (event_id % 2)::double, 1.0::double]) end"
_DECIDED = (
    f"with e as (select event_id, ['choice', 'score', 'noul'][event_id % 3 + 1] as kind, {_P} as p, ['a', 'b', 'c'] as keys, case when event_id % 5 = 0 then 'q' else ['a', 'b', 'c'][event_id % 3 + 1] end as label, {_T} as given from events), "
    "r as (select *, list_transform(keys, lambda k: case when given is not null then coalesce(given[k], 0.0) else (k = label)::int::double end) as raw from e), "
    "d as (select event_id, kind, p, label, case when list_sum(raw) > 0 then list_transform(raw, lambda x: x / list_sum(raw)) else list_transform(raw, lambda x: 1.0::double / 3) end as target from r) "
)


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    whole = (3 + i % 7 + i % 5 + i % 11).cast("double")
    p = F.array(*[(1 + i % n) / whole for n in (7, 5, 11)])
    keys = F.array(*[F.lit(k) for k in "abc"])
    kind = F.element_at(F.array(F.lit("choice"), F.lit("score"), F.lit("noul")), (i % 3 + 1).cast("int"))
    label = F.when(i % 5 == 0, "q").otherwise(F.element_at(keys, (i % 3 + 1).cast("int")))
    given = F.when(i % 4 != 0, F.map_from_arrays(F.array(F.lit("a"), F.lit("b"), F.lit("z")), F.array((i % 3).cast("double"), (i % 2).cast("double"), F.lit(1.0))))
    return table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), p.alias("p"), label.alias("label"), an.targets(given, keys, label).alias("target"))


def _rounded(c: Column) -> Column:
    return F.transform(c, lambda x: F.round(x, 9))


@query(_DECIDED + "select event_id, list_transform(target, lambda x: round(x, 9)) as target, (list_position(target, list_max(target)) - 1)::int as label_ix from d")
def decision_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("event_id", _rounded(F.col("target")).alias("target"), an.first_best(F.col("target")).alias("label_ix"))


@query(
    _DECIDED + "select event_id, round(case kind when 'choice' then (list_max(p) - 1/3) / (1 - 1/3) when 'score' then greatest(0, 1 - list_sum(list_transform(p, lambda x, i: x * abs(i - 1 - (p[2] + 2 * p[3])))) / (2/3)) else abs(2 * p[2] - 1) end, 9) as confidence from d"
)
def decision_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("event_id", F.round(an.confidence(F.col("kind"), F.col("p")), 9).alias("confidence"))


@query(
    _DECIDED + ", l as (select kind, -list_sum(list_transform(p, lambda x, i: target[i] * ln(greatest(x, 1e-12)))) as l, list_sum(list_transform(p, lambda x, i: (x - target[i]) ** 2)) as b from d) "
    "select kind, count(*) as cases, round(avg(l), 6) as log_loss, round(avg(b), 6) as brier from l group by grouping sets ((kind), ())"
)
def probability_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.losses(_decided(spark, sf_dir), "kind")


@query(
    "with o0 as (select event_id // 3 as case_, 'q' as question, ['choice', 'score', 'noul'][(event_id // 3) % 3 + 1] as kind, case (event_id // 3) % 3 when 1 then (event_id * 7 % 13 - 4)::varchar when 2 then ['true', 'false', 'x'][event_id % 3 + 1] else 'k' || event_id % 5 end as key, event_id % 3 as place from events), o as (select *, case kind when 'score' then key::int when 'noul' then (key <> 'false')::int else 0 end as n from o0) "
    "select case_ as \"case\", any_value(question) as question, any_value(kind) as kind, list(key order by n, place) as keys from o group by case_"
)
def ordered_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    case = F.floor(i / 3)
    names = lambda xs, at: F.element_at(F.array(*[F.lit(x) for x in xs]), (at + 1).cast("int"))
    key = F.when(case % 3 == 1, (i * 7 % 13 - 4).cast("string")).when(case % 3 == 2, names(("true", "false", "x"), i % 3)).otherwise(F.concat(F.lit("k"), (i % 5).cast("string")))
    options = table(spark, sf_dir, "events").select(case.alias("case"), F.lit("q").alias("question"), names(("choice", "score", "noul"), case % 3).alias("kind"), key.alias("key"), (i % 3).alias("place"))
    return an.options_ordered(options)


@query("select event_id, list_transform(list_sort(list_transform(['a', 'b', 'c', 'd'], lambda k: {'h': md5('6:' || event_id || ':' || k), 'k': k})), lambda x: x.k) as keys from events")
def shuffled_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array(*[F.lit(k) for k in "abcd"])
    return table(spark, sf_dir, "events").select("event_id", an.options_shuffled(keys, F.col("event_id"), 6).alias("keys"))


@query()
def fitted_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The temperature that makes the shares of _decided(), as logits three times too sharp, fit their targets best."""
    cases = _decided(spark, sf_dir).select(F.transform("p", lambda x: F.log(x) * 3).alias("logits"), "target")
    return spark.range(1).select(F.round(F.lit(an.best_temperature(cases)), 4).alias("temperature"))


@query("with o as (select event_id // 10 as problem, event_type <> 'error' as compiled, value > 2 as passed from events), p as (select problem, bool_or(compiled) as c, bool_and(compiled and passed) as p from o group by 1) select count(*) as problems, round(avg(c::int), 6) as compiled, round(avg(p::int), 6) as passed from p")
def program_pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 10).alias("problem"), (F.col("event_type") != "error").alias("compiled"), (F.col("value") > 2).alias("passed"))
    return an.pass_rates(outcomes)


@query(
    "select event_id, case event_id % 4 when 0 then event_id % 8 = 0 when 1 then event_id % 12 <> 5 when 2 then event_id % 3 = 0 else event_id % 5 <> 3 end as equal from events"
)
def typed_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as programs would display numbers of events, some of them wrong: whether they are is known by how they were made."""
    i = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("Float", "Int", "String", "List[Float]")]), (i % 4 + 1).cast("int"))
    text = lambda x: x.cast("string")
    got = (
        F.when(i % 4 == 0, F.array(F.concat(F.lit(" p"), text(F.when(i % 8 == 0, i + 0.0005).otherwise(i + 0.01 + i / 1000)))))
        .when(i % 4 == 1, F.array(F.concat(F.lit("y"), text(F.when(i % 12 == 5, i + 1).otherwise(i)))))
        .when(i % 4 == 2, F.array(F.concat(F.lit("  a "), F.when(i % 3 == 0, "").otherwise("b"))))
        .otherwise(F.array(text(F.when(i % 5 == 3, i + 1 + i / 100).otherwise(i + 0.0009)), F.lit("1.5"), F.lit("9")))
    )
    want = F.when(i % 4 == 0, F.array(text(-i))).when(i % 4 == 1, F.array(text(-i))).when(i % 4 == 2, F.array(F.lit("a"))).otherwise(F.array(text(i), F.lit("1.5")))
    return table(spark, sf_dir, "events").select("event_id", an.typed_equal(kind, got, want).alias("equal"))


_ENERGY = (
    "with s as (select user_id, ts, value as power, case when user_id % 2 = 0 then event_id::double * 3 end as counter from events), a as (select *, lag(power) over w as p, lag(epoch_us(ts)) over w as t from s window w as (partition by user_id order by ts)) "
    "select user_id, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 6) as seconds, round(case when user_id % 2 = 0 then arg_max(counter, ts) - arg_min(counter, ts) else coalesce(sum((power + p) / 2 * (epoch_us(ts) / 1e6 - t / 1e6)), 0) end, 6) as joules, case when user_id % 2 = 0 then 'counter' else 'power' end as source from a group by user_id"
)


@query(_ENERGY.replace("round(case when user_id % 2", "round(case when user_id % 2").replace(", 6) as joules", ", 0) as joules"))
def energy_by_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select("user_id", "ts", F.col("value").alias("power"), F.when(F.col("user_id") % 2 == 0, F.col("event_id").cast("double") * 3).alias("counter"))
    return an.energy(own, "user_id", "ts", "power", "counter").withColumn("joules", F.round("joules", 0))


_FILES = "select *, case page_id % 4 when 0 then url || '/a.XML' when 1 then url || '/b.tar.gz' when 2 then url || '/c.' else url || '/d' end as path from pages"


@query(f"select lower(regexp_extract(string_split(path, '/')[-1], '\\.([A-Za-z0-9]+)$', 1)) as extension, count(*) as files from ({_FILES}) group by 1")
def extension_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.element_at(F.array(*[F.lit(x) for x in ("/a.XML", "/b.tar.gz", "/c.", "/d")]), (F.col("page_id") % 4 + 1).cast("int"))
    return an.extension_counts(table(spark, sf_dir, "pages").select(F.concat("url", tail).alias("path")), "path")


@query(
    "with r as (select event_type as variant, user_id as seed, avg(value) as value from events group by all), d as (select a.variant as \"left\", b.variant as \"right\", a.value - b.value as d from r a join r b using (seed) where a.variant < b.variant) "
    "select \"left\", \"right\", count(*) as n, round(avg(d), 6) as mean, round(stddev_samp(d), 6) as sd, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) as t, count(*) filter (d > 0) as positive from d group by all"
)
def paired_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of a user's events of two types; values are added in the order in which they lie in the files, as event_id may be null, come twice or run otherwise."""
    place = F.struct("_metadata.file_path", "_metadata.row_index").alias("place")
    own = table(spark, sf_dir, "events").select(F.col("event_type").alias("variant"), F.col("user_id").alias("seed"), "value", place)
    return an.paired_variants(an.ordered_means(own, ("variant", "seed"), "value", "place"))


@query("with f as (select user_id, min(event_id) as o from events group by 1) select user_id, row_number() over (order by o) - 1 as ix from f")
def first_seen_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.first_seen(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


@query(
    "with e as (select label::varchar as name, vec_id, i, embedding[i]::double as a, embedding[i]::double * 1.1 + 0.01 * (vec_id % 3) as b from (select *, unnest(range(1, len(embedding) + 1)) as i from embeddings)) "
    "select name, count(*) as n, round(sqrt(sum((a - b) ** 2)) / sqrt(sum(a * a)), 6) as relative, round(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) as cosine from e group by name"
)
def parameter_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label as the parameters of a layer, and the same a little changed."""
    own = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("name"), "vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    own = own.select("name", (F.col("vec_id") * 10_000 + F.col("i")).alias("ix"), "x", "vec_id")
    return an.drift(own, own.withColumn("x", F.col("x") * 1.1 + 0.01 * (F.col("vec_id") % 3)))


_SNAPSHOTS = "with s as (select o_orderkey as name, o_orderkey * 1000 as tokens, o_orderkey % 5 = 0 as terminal from orders where o_orderkey < 400), n as (select * from s where not terminal or tokens = (select max(tokens) from s)) "


@query(
    "with s as (select event_id as name, event_id * 1000 as tokens, event_id % 5 = 0 as terminal from events where event_id < 400), n as (select * from s where not terminal or tokens = (select max(tokens) from s)), w as (select * from n where tokens >= 20000 and tokens <= 380000), "
    "x as (select * from w where tokens > (select max(tokens) from w) - 50000) select name, tokens, terminal, (row_number() over (order by tokens, name) - 1)::int as place from (select * from x order by tokens desc, name desc limit 30)"
)
def snapshot_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first events as snapshots of a run: a window of 50,000 tokens, and of that the last 30."""
    own = table(spark, sf_dir, "events").where("event_id < 400").select(F.col("event_id").alias("name"), (F.col("event_id") * 1000).alias("tokens"), (F.col("event_id") % 5 == 0).alias("terminal"))
    return an.snapshot_window(own, window=50_000, last=30, start=20_000, end=380_000)


@query("select event_id, user_id, before from (select event_id, user_id, lag(user_id) over (order by event_id) as before from events where event_id < 400) where before is not null and user_id <= before")
def out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.out_of_order(table(spark, sf_dir, "events").where("event_id < 400").select("event_id", "user_id"), "event_id", "user_id")


@query("select count(distinct coalesce(lang, chr(0))) as lang, count(distinct coalesce(source, chr(0))) as source from documents")
def source_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.identity(table(spark, sf_dir, "documents"), ("lang", "source"))


_HALF = "('0x' || substring(h, {}, 12))::bigint::hugeint"


@query(
    "with p as (select doc_id // 64 as shard_ix, sha256(doc_id || ':' || n_chars) as h from documents), s as (select shard_ix, count(*) as rows, " + ", ".join(f"sum({_HALF.format(1 + 12 * k)}) as s{k}" for k in range(4)) + " from p group by 1) "
    "select shard_ix, rows, sha256(" + " || ':' || ".join(f"s{k}::varchar" for k in range(4)) + ") as digest from s"
)
def index_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 64).alias("shard_ix"), "doc_id", "n_chars")
    return an.index_digest(own, "shard_ix", ("doc_id", "n_chars"))


@query("select source as folder, case when source < 'src2' then 7 else 0 end::bigint as base from documents group by source")
def carried_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that go on where they stood, and those whose content is new, which begin again."""
    new = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("folder")).agg(F.lit(5).alias("seed"), F.max("n_chars").alias("content"))
    old = new.withColumn("base", F.lit(7).cast("long")).withColumn("content", F.when(F.col("folder") < "src2", F.col("content")).otherwise(F.lit(-1).cast("long")))
    return an.carried(old, new, ("seed",))


@query("select distinct user_id from events where event_type = 'click' intersect select user_id from events where event_type = 'error'")
def users_of_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events")
    return own.where("event_type = 'click'").select("user_id").intersect(own.where("event_type = 'error'").select("user_id"))


@query("select user_id, floor(value)::bigint as v from events where event_type = 'click' except all select user_id, floor(value)::bigint from events where event_type = 'error'")
def clicks_without_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select("event_type", "user_id", F.floor("value").alias("v"))
    return own.where("event_type = 'click'").drop("event_type").exceptAll(own.where("event_type = 'error'").drop("event_type"))


@query("select user_id, value from events where event_type = 'click' union all by name select value, user_id from events where event_type = 'error'")
def joined_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events")
    return own.where("event_type = 'click'").select("user_id", "value").unionByName(own.where("event_type = 'error'").select("value", "user_id"))


@query("select d.doc_id, toxic, d.source from documents d join labels using (doc_id) where toxic is not null")
def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded outcomes beside what they are of; what has none is left out."""
    labels = table(spark, sf_dir, "labels").where("toxic is not null").select("doc_id", "toxic")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id").select("doc_id", "toxic", "source")
